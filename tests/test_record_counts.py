"""Counted records between two places: few shuffles, brute-force counts."""

import random

from zygospark.operators.ordering import SLICE, records_between
from zygospark.schema import CALLS
from zygospark.session import small_table


def test_counts_and_shuffles(spark):
    rnd = random.Random(5)
    places = [(rnd.choice("kl"), rnd.choice("12"), rnd.choice([7, SLICE, SLICE - 1, rnd.randrange(9 * SLICE)])) for _ in range(600)]
    rows = [(k, i, c, None, p, p, None, None, None, [], "AA", None, "het", None, None, None, False) for i, (k, c, p) in enumerate(places)]
    asked = [(i, rnd.choice("klm"), rnd.choice("12"), lo, lo + rnd.choice([-5, 0, 1, 2, SLICE, 20 * SLICE])) for i, lo in enumerate(rnd.choices(range(10 * SLICE), k=300))]
    ranges = small_table(spark, asked, "id bigint, kit string, chrom string, lo bigint, hi bigint")
    out = records_between(small_table(spark, rows, CALLS), ranges)
    want = {i: sum(k == a and c == b and lo < p < hi for a, b, p in places) for i, k, c, lo, hi in asked}
    assert {r.id: r.n for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1
