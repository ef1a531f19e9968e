import re

from pyspark.sql import functions as F

from zygospark.sources import fastq
from zygospark.sources.text import line_numbers


def shown(df, capsys):
    capsys.readouterr()
    df.explain(mode="formatted")
    return capsys.readouterr().out


def few_bytes(spark):
    """Lines that a generator made: their estimated size stays that of the rows they came from."""
    reads = spark.range(40).select(
        F.col("id").alias("read"), F.explode(F.array(F.lit(1), F.lit(2))).alias("side")
    )
    record = F.array(F.concat_ws("/", F.col("read").cast("string"), F.col("side").cast("string")), F.lit("ACGT"), F.lit("+"), F.lit("IIII"))
    rows = reads.select("read", "side", F.posexplode(record).alias("i", "value"))
    at = F.col("read") * 4 + F.col("i")
    return rows.select(
        F.concat(F.lit("/d/NA_S1_L001_R"), F.col("side").cast("string"), F.lit("_001.fastq.gz")).alias("file"),
        F.floor(at / 10).alias("block"), at.alias("ord"), "value",
    )


def test_lines_are_never_broadcast(spark, capsys):
    lines = few_bytes(spark)
    for limit in (None, 10):
        out = fastq.read_pairs(lines, fastq.lane_manifest(lines.select("file")), limit)
        plan = shown(out, capsys)
        sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert sent and not [x for x in sent if "value#" in x]
        got = sorted((r.pair, r.r1_name, r.r2_name, r.problem) for r in out.collect())
        assert got == [(i, f"{i}/1", f"{i}/2", None) for i in range(limit or 40)]


def test_many_blocks_are_joined_by_a_shuffle_that_builds_on_them(spark, capsys, monkeypatch):
    from zygospark.sources import text

    monkeypatch.setattr(text, "is_small", lambda df: False)
    out = line_numbers(few_bytes(spark))
    plan = shown(out, capsys)
    assert "ShuffledHashJoin" in plan and "BroadcastExchange" not in plan
    assert sorted(r.line_no for r in out.filter("file like '%R1%'").collect()) == list(range(160))
