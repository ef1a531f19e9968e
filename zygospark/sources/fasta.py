"""FASTA text to fixed-size reference chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospark.functions.common import int_div
from zygospark.functions.naming import normalize_chrom
from zygospark.sources.text import read_lines, running

CHUNK = 1024


def reference_chunks(lines: DataFrame, build: Column | str, chunk: int = CHUNK) -> DataFrame:
    """(build, chrom, chunk, seq) of FASTA lines, chunk k holding bases [k*C, (k+1)*C).

    Contig names and base offsets are running values over file blocks, so a
    chromosome is never assembled as one string; each line is cut at chunk
    borders and a chunk gathers at most C bases.
    """
    title = F.col("value").startswith(">")
    text = lines.withColumn("value", F.regexp_replace("value", r"\s+$", ""))
    text = text.filter("value != ''").select(
        "file",
        "block",
        "ord",
        F.when(title, normalize_chrom(F.regexp_extract("value", r"^>\s*(\S*)", 1))).alias("name"),
        F.when(~title, F.upper("value")).alias("bases"),
    )
    text = running(text, sums={"upto": F.coalesce(F.length("bases"), F.lit(0))})
    text = running(text, carry={"at": F.when(F.col("name").isNotNull(), F.struct("name", "upto"))})
    first = F.col("upto") - F.length("bases") - F.col("at.upto")
    pieces = text.filter("bases is not null and at is not null").select(
        F.col("at.name").alias("chrom"), first.alias("start"), "bases"
    )
    last = F.col("start") + F.length("bases") - 1
    pieces = pieces.withColumn("chunk", F.explode(F.sequence(int_div("start", chunk), int_div(last, chunk))))
    cut = F.greatest(F.col("chunk") * chunk - F.col("start"), F.lit(0))
    room = (F.col("chunk") + 1) * chunk - (F.col("start") + cut)
    pieces = pieces.select(
        "chrom",
        "chunk",
        (F.col("start") + cut).alias("start"),
        F.substring(F.col("bases"), (cut + 1).cast("int"), room.cast("int")).alias("bases"),
    )
    whole = pieces.groupBy("chrom", "chunk").agg(F.sort_array(F.collect_list(F.struct("start", "bases"))).alias("p"))
    return whole.select(
        (F.lit(build) if isinstance(build, str) else build).alias("build"),
        "chrom",
        "chunk",
        F.array_join(F.col("p.bases"), "").alias("seq"),
    )


def read_fasta(spark: SparkSession, path: str, build: str, chunk: int = CHUNK) -> DataFrame:
    return reference_chunks(read_lines(spark, path), build, chunk)
