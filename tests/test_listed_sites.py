"""Sites of a listing: A's records are judged once, B's records come back after the cap."""

import pytest

from zygospark.operators import compare
from zygospark.plans import answers
from zygospark.plans import derived as D
from zygospark.session import small_table

CALLS = """kit string, src_ord long, chrom string, contig_ord int, pos long, `end` long, rsid string, rs_num long, ref string, alt array<string>,
genotype string, gt string, zygosity string, filter string, quality float, depth long, ref_block boolean"""


def call(kit, n, chrom, pos, ref, genotype, rsid=None, end=None):
    zygosity = "het" if len(set(genotype)) > 1 else "hom_alt"
    return (kit, n, chrom, int(chrom), pos, end or pos, rsid, None, ref, [], genotype, "0/1", zygosity, "PASS", 9.0, n, False)


ROWS = [
    call("k3", 1, "1", 100, "A", "AC", "rs1"), call("k2", 2, "1", 100, "A", "CC", "rs2"), call("k3", 3, "1", 100, "A", "AG"),  # met, and a later record
    call("k3", 4, "1", 50, "T", "TG"),  # k3 alone: k2 is silent, so the reference
    call("k2", 5, "2", 70, "G", "GA"),  # k2 alone: k3 says nothing of it, k1's lifted call disagrees
    call("k1", 6, "1", 5, None, "CC"), call("k1", 7, "2", 3000, None, "TT"),  # GRCh37; lifted by 200 and by a turned block
]
BLOCKS = [("GRCh37", "GRCh38", 1, "1", 0, 3000, "1", 95, 10000, False, 1.0), ("GRCh37", "GRCh38", 2, "2", 2900, 3100, "2", 9831, 10000, True, 1.0)]


@pytest.mark.parametrize("cap", [50, None])
def test_every_kind_of_site_is_listed(spark, cap):
    calls = spark.createDataFrame(ROWS, CALLS)
    blocks = spark.createDataFrame(
        BLOCKS, "from_build string, to_build string, blk long, t_chrom string, t_start long, t_end long, q_chrom string, q_start long, q_size long, q_neg boolean, score double"
    )
    pairs = small_table(spark, [("k3", "k2"), ("k2", "k3"), ("k2", "k1")], "a string, b string")
    got = compare.discordant_sites(calls, D.kits(spark), pairs, blocks, max_discordant=cap)
    rows = sorted((r.a, r.b, r.n, r.chrom, r.pos, r.rsid, r.call_a.genotype, r.source_a, r.call_b.genotype, r.source_b, r.call_b.ref, r.lifted_from_b and r.lifted_from_b.pos) for r in got.collect())
    seen, implied = "observed", "inferred_ref"
    assert rows == [
        ("k2", "k1", 1, "2", 70, None, "GA", seen, "AA", seen, None, 3000),
        ("k2", "k3", 1, "1", 100, "rs2", "CC", seen, "AG", seen, "A", None),
        ("k2", "k3", 2, "1", 50, None, "TT", implied, "TG", seen, "T", None),
        ("k3", "k2", 1, "1", 50, None, "TG", seen, "TT", implied, "T", None),
        ("k3", "k2", 2, "1", 100, "rs1", "AC", seen, "CC", seen, "A", None),
        ("k3", "k2", 3, "1", 100, None, "AG", seen, "AA", implied, "A", None),
    ]


def test_records_are_judged_once(spark, monkeypatch):
    """Records beyond the first of a place are read back, not filtered, enriched and judged again."""
    sf = "/root/testdata/sf0.001"
    given = []
    picks = compare._picks
    monkeypatch.setattr(compare, "_picks", lambda a, b, a_rows, plan: given.append(a_rows) or picks(a, b, a_rows, plan))
    compare.discordant_sites(D.stored_calls(spark, sf), D.kits(spark), answers.pair_table(spark, answers.SAME_BUILD), coords=D.rsid_coords(spark, sf))
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert "Scan" in plan and "Join" not in plan and "Union" not in plan
