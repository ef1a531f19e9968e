"""The JVM compiles no method above 8,000 bytes: a row's expression that is longer runs interpreted."""

from pyspark.sql import functions as F

from zygospark.operators import compare
from zygospark.plans import answers
from zygospark.plans import derived as D
from zygospark.sources import array

COMPILED = 8000


def longest_method(df) -> int:
    """Bytes of the longest method generated for a plan without shuffles."""
    found = df._jdf.queryExecution().debug().codegenToSeq()
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


def test_array_lines_are_compiled(spark):
    value = F.concat(F.lit("rs"), F.col("id").cast("string"), F.lit("\t1\t100\tAG"))
    lines = spark.range(20).select(F.lit("f").alias("file"), F.col("id").alias("ord"), value.alias("value"))
    assert longest_method(array.array_lines(lines, "23andme", F.col("ord"))) < COMPILED


def test_blanks_and_quotes_around_fields(spark):
    rows = ['"RsId" ,x,y,z', ' "rs5" , "1","100" ,"ag"', "rs6\t chrX \t+7\tA", "\trsid\t5\tAA", '"" rsid,1,2,AA']
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(rows)], "file string, ord long, value string")
    got = array.array_lines(lines, "ftdna", F.col("ord")).orderBy("src_ord").select("titled", "rsid", "chrom", "pos", "genotype", "rs_num").collect()
    assert [tuple(r) for r in got] == [
        (True, "RsId", "X", None, "Z", None), (False, "rs5", "1", 100, "AG", 5), (False, "rs6", "X", 7, "A", 6),
        (False, None, "rsid", 5, "AA", None), (False, " rsid", "1", 2, "AA", None),
    ]


def test_judged_calls_are_compiled(spark):
    """Predicates on an enriched reference must not build the answer of the place again at each mention."""
    sf = "/root/testdata/sf0.001"
    kits, pairs = D.kits(spark), answers.pair_table(spark, answers.ALL_PAIRS)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = compare._a_rows(D.stored_calls(spark, sf), kits, compare.describe_pairs(pairs, kits), D.rsid_coords(spark, sf), None, None)
        assert longest_method(rows) < COMPILED
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
