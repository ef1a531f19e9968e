from pyspark.sql import functions as F

from zygospark.operators import rsids


def test_rows_without_a_place_are_spread(spark):
    """Points without a place match nothing, and a shuffled join does not send them all to one task."""
    points = spark.range(400).select(F.col("id"), F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("long").alias("pos"), F.lit("GRCh38").alias("build"))
    points = points.unionByName(spark.createDataFrame([(400, "1", 7, "GRCh38")], points.schema))
    coords = spark.createDataFrame(
        [("GRCh38", 5, "rs5", "1", 1, 7, "A", ["C"], "dbsnp")],
        "build string, rs_num long, rsid string, chrom string, contig_ord int, pos long, ref string, alt array<string>, source string",
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = rsids.name_positions(points, coords).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: r.named.rsid for r in out if r.named} == {400: "rs5"} and len(out) == 401
    tasks = [r.task for r in out]
    assert max(tasks.count(t) for t in set(tasks)) < 150
