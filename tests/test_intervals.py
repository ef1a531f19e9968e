"""Brute-force models of the interval joins on random data."""

import random

from zygospark.operators.liftover import lift_all, lift_best
from zygospark.operators.lookup import spanning_hits
from zygospark.operators.ordering import page, rank_rows
from zygospark.schema import CALLS, CHAIN_BLOCKS
from zygospark.session import small_table
from zygospark.sources.text import line_numbers, read_lines, running, source_order


def test_liftover_against_scan(spark):
    rnd = random.Random(3)
    blocks = []
    for i in range(120):
        start = rnd.randrange(0, 60000)
        blocks.append(("A", "B", i, rnd.choice("12"), start, start + rnd.choice([1, 7, 900, 20000]), "9", rnd.randrange(10**6), 10**8,
                       rnd.random() < 0.4, float(rnd.randrange(6))))
    points = [(i, rnd.choice("123"), rnd.randrange(0, 80000)) for i in range(1500)] + [(1500 + i, b[3], b[4] + 1) for i, b in enumerate(blocks)]
    p = small_table(spark, points, "pid bigint, chrom string, pos bigint")
    c = small_table(spark, blocks, CHAIN_BLOCKS)

    def hits(chrom, pos):
        x = max(pos - 1, 0)
        out = []
        for b in blocks:
            if b[3] == chrom and b[4] <= x < b[5]:
                q = b[7] + x - b[4]
                out.append(((b[10], b[4], b[2]), (b[6], (b[8] - 1 - q if b[9] else q) + 1, b[9])))
        return [h for _, h in sorted(out, reverse=True)]

    for width in (64, 1 << 14):
        best = {r.pid: r for r in lift_best(p, c, "A", "B", width).collect()}
        every = {}
        for r in lift_all(p, c, "A", "B", width).collect():
            every.setdefault(r.pid, []).append(((r.score, r.t_start, r.blk), (r.lifted_chrom, r.lifted_pos, r.reverse)))
        assert len(best) == len(points)
        for pid, chrom, pos in points:
            want = hits(chrom, pos)
            got = best[pid]
            assert (got.lifted_chrom, got.lifted_pos, got.reverse) == (want[0] if want else (None, None, None))
            assert [h for _, h in sorted(every.get(pid, []), reverse=True)] == want


def test_spanning_against_scan(spark):
    """Nearest of the 64 records before the place that reaches it, on one contig."""
    rnd = random.Random(8)
    rows = []
    for o in range(900):
        pos = rnd.randrange(1, 3000) if o % 3 else 1500  # a crowded place
        end = pos + rnd.choice([0, 0, 0, 3, 40, 900, 70000])
        rows.append((rnd.choice("kl"), o, rnd.choice("12"), None, pos, end, None, None, None, [], "AA", None, "hom_ref", None, None, None, False))
    calls = small_table(spark, rows, CALLS)
    sites = [(i, rnd.choice("kl"), rnd.choice("123"), rnd.randrange(1, 4000)) for i in range(400)]
    s = small_table(spark, sites, "sid bigint, kit string, chrom string, pos bigint")

    def model(kit, chrom, pos, limit):
        before = sorted(((r[4], r[5], r[1]) for r in rows if r[0] == kit and r[2] == chrom and r[4] < pos), reverse=True)
        return next((k[2] for k in before[:limit] if k[1] >= pos), None)

    for limit in (64, 3, None):
        got = {r.sid: r.call.src_ord for r in spanning_hits(calls, s, limit, small=limit == 64).collect()}
        assert got == {i: m for i, k, c, p in sites if (m := model(k, c, p, limit)) is not None}


def test_running_totals_and_numbers(spark, tmp_path):
    rnd = random.Random(2)
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{'h' if rnd.random() < 0.05 else ''}{i}\n" for i in range(800)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        lines = read_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
        from pyspark.sql import functions as F

        head = F.col("value").startswith("h")
        out = running(line_numbers(lines), sums={"n": F.lit(1), "h": head.cast("int")}, carry={"last": F.when(head, F.col("value"))})
        rows = out.withColumn("o", source_order(spark)).orderBy("file", "o").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    for name in ("a", "b"):
        mine = [r for r in rows if r.file.endswith("/" + name)]
        text = (tmp_path / name).read_text().split()
        assert [r.value for r in mine] == text and [r.line_no for r in mine] == list(range(800))
        last, h = None, 0
        for i, r in enumerate(mine):
            if text[i].startswith("h"):
                last, h = text[i], h + 1
            assert (r.n, r.h, r.last) == (i + 1, h, last)


def test_rank_and_page(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([5, rnd.randrange(100)]), i) for i in range(2000)]
    df = small_table(spark, rows, "k bigint, i bigint")
    want = sorted(rows)
    got = {(r.k, r.i): r.row_no for r in rank_rows(df, ["k", "i"]).collect()}
    assert [got[r] for r in want] == list(range(2000))
    assert [(r.k, r.i) for r in page(df, ["k", "i"], 7, 9).collect()] == want[7:16]
    assert [(r.k, r.i) for r in page(df, ["k", "i"], 1990).collect()] == want[1990:]
