import random

from pyspark.sql import functions as F

from zygospark.operators import export


def test_long_regions_meet_sums_of_cells(spark):
    """A long region is met by sums of cells; only its two ends meet calls, and totals are those of the scan."""
    rng = random.Random(5)
    top = 5 << 32
    places = [rng.choice([rng.randrange(1, 1 << 16), rng.randrange(1, 1 << 22), rng.randrange(1, top)]) for _ in range(1500)]
    rows = [(rng.choice("12"), p, p + rng.randrange(300), i, rng.choice(["het", "hom_ref"])) for i, p in enumerate(places)]
    calls = spark.createDataFrame(rows, "chrom string, pos long, end long, src_ord long, zygosity string")
    ends = [(0, top), (1, 1 << 62), (1 << 14, (1 << 20) - 1), ((1 << 20) - 1, 1 << 26), (5, 4), (places[0], places[0])]
    ends += [(a, a + rng.choice([0, 100, 40_000, 1 << 21, 1 << 27, 1 << 33])) for a in rng.choices(places, k=60)]
    regions = spark.createDataFrame([(i, rng.choice("123"), a, b) for i, (a, b) in enumerate(ends)], "region_no long, chrom string, start long, end long")
    got = {r[0]: tuple(r)[1:] for r in export.region_totals(calls, regions).select("region_no", "calls", "orders", "first_pos", "last_end", "het").collect()}
    want = {}
    for i, chrom, a, b in regions.collect():
        inside = [r for r in rows if r[0] == chrom and a <= r[1] <= b]
        if inside:
            want[i] = (len(inside), sum(r[3] for r in inside), min(r[1] for r in inside), max(r[2] for r in inside), sum(r[4] == "het" for r in inside))
    assert got == want
    partly, whole = export._cover(F.lit(1).cast("long"), F.lit(1 << 34).cast("long"))
    sizes = spark.range(1).select(F.size(partly), F.size(whole)).first()
    assert sizes[0] <= 2 and sizes[1] <= 3 * 126 + 4
