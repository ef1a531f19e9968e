"""Paired FASTQ files: lane pairing and read pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.functions.common import int_div
from zygospark.functions.naming import lane_of, mate_name
from zygospark.sources.files import read_heads
from zygospark.sources.text import line_numbers, read_lines


def lane_manifest(files: DataFrame) -> DataFrame:
    """(lane, sample, r1, r2, problem) from a `file` column; unpaired files carry a problem.

    Lanes without an `_L00n` token are numbered in file order.
    """
    named = files.select("file", F.regexp_extract("file", r"([^/]*)$", 1).alias("name")).distinct()
    ones = named.withColumn("mate", mate_name("name")).filter("mate is not null")
    pairs = ones.alias("a").join(named.alias("b"), F.col("a.mate") == F.col("b.name")).select(
        F.col("a.file").alias("r1"), F.col("b.file").alias("r2"), lane_of(F.col("a.name")).alias("l")
    )
    number = F.row_number().over(W.orderBy("r1"))  # one row per file pair, not per read
    lanes = pairs.select(
        F.coalesce(F.col("l.lane"), F.format_string("L%03d", number)).alias("lane"),
        F.col("l.sample").alias("sample"),
        "r1",
        "r2",
        F.lit(None).cast("string").alias("problem"),
    )
    used = pairs.select(F.explode(F.array("r1", "r2")).alias("file"))
    lonely = named.join(used, "file", "left_anti").select(
        F.lit(None).cast("string").alias("lane"),
        F.lit(None).cast("string").alias("sample"),
        F.col("file").alias("r1"),
        F.lit(None).cast("string").alias("r2"),
        F.lit("no mate file").alias("problem"),
    )
    return lanes.unionByName(lonely)


def read_pairs(lines: DataFrame, lanes: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """(lane, sample, pair, r1_name, r1_seq, r1_qual, r2_name, r2_seq, r2_qual, problem).

    A read whose mate is missing comes back alone, with a problem.

    Four lines make a record.  Lanes reach the lines with the offsets of their
    blocks, so no line is dealt by its file.  Both mates meet in one shuffle on
    (lane, pair); with `max_pairs` the lines beyond it are dropped before that shuffle.
    """
    sides = lanes.filter("problem is null").select(
        "lane", "sample", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("r1").alias("file")),
                                            F.struct(F.lit(2).alias("side"), F.col("r2").alias("file")))).alias("x")
    ).select("lane", "sample", "x.side", "x.file")
    text = line_numbers(lines, facts=sides)
    text = text.withColumn("pair", int_div("line_no", 4)).withColumn("part", F.col("line_no") % 4)
    text = text.filter("part <> 2")
    if max_pairs is not None:
        text = text.filter(F.col("pair") < max_pairs)

    def pick(side: int, part: int):
        return F.max(F.when((F.col("side") == side) & (F.col("part") == part), F.col("value")))

    out = text.groupBy("lane", "sample", "pair").agg(
        *[
            pick(side, part).alias(f"r{side}_{name}")
            for side in (1, 2)
            for part, name in ((0, "name"), (1, "seq"), (3, "qual"))
        ]
    )
    lost = F.when(F.col("r2_name").isNull(), "no R2 read").when(F.col("r1_name").isNull(), "no R1 read")
    return out.withColumn("problem", lost)


def read_fastq_pairs(spark: SparkSession, paths: list[str], max_pairs: int | None = None) -> DataFrame:
    heads = read_heads(spark, paths)
    lines = read_lines(spark, paths, heads)
    lanes = lane_manifest(heads.select("file").distinct())  # file names, without a scan of the reads
    lonely = [r.r1 for r in lanes.filter("problem is not null").select("r1").limit(5).collect()]
    if lonely:
        raise ValueError(f"cannot pair with an R2 file: {', '.join(lonely)}")
    return read_pairs(lines, lanes, max_pairs)
