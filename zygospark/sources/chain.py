"""UCSC chain text to gapless alignment blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospark.functions.naming import normalize_chrom
from zygospark.sources.text import read_lines, running, source_order


def _number(c):
    return F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))


def chain_rows(lines: DataFrame) -> DataFrame:
    """Block rows of chain lines with a `problem` column for malformed input.

    Offsets inside a chain are differences of running totals over the file: the
    total at a block minus the total at the chain's header line.
    """
    text = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    text = text.withColumn("f", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"))
    f = [F.get("f", F.lit(i)) for i in range(12)]
    head = f[0] == "chain"
    n = F.size("f")
    size, dt, dq = _number(f[0]), _number(f[1]), _number(f[2])
    gap = ~head & (n >= 3)
    header = F.struct(
        normalize_chrom(f[2]).alias("t_chrom"),
        _number(f[5]).alias("t0"),
        normalize_chrom(f[7]).alias("q_chrom"),
        _number(f[10]).alias("q0"),
        _number(f[8]).alias("q_size"),
        (f[9] == "-").alias("q_neg"),
        f[1].try_cast("double").alias("score"),
    )
    problem = (
        F.when(head & (n < 12), F.lit("short chain header"))
        .when(head & (f[4] != "+"), F.lit("tStrand must be +"))
        .when(head & (header.t0.isNull() | header.q0.isNull() | header.q_size.isNull() | header.score.isNull()), F.lit("bad chain header"))
        .when(~head & (size.isNull() | (gap & (dt.isNull() | dq.isNull()))), F.lit("bad block line"))
    )
    text = text.select(
        "file",
        "block",
        "ord",
        "value",
        head.alias("head"),
        F.when(head, header).alias("header"),
        size.alias("size"),
        (~head & (n < 3)).alias("closes"),
        F.when(gap, size + dt).otherwise(F.lit(0)).alias("dt"),
        F.when(gap, size + dq).otherwise(F.lit(0)).alias("dq"),
        problem.alias("problem"),
    )
    t = running(
        text,
        sums={"t": F.col("dt"), "q": F.col("dq"), "chain_no": F.col("head").cast("bigint"), "closed": F.col("closes").cast("bigint")},
    )
    t = running(
        t,
        carry={"at": F.when(F.col("head"), F.struct("header", F.col("t").alias("t"), F.col("q").alias("q"), F.col("closed").alias("closed")))},
    )
    # A chain ends at its first one-number line; anything after it needs a new header.
    dangling = F.col("at").isNull() | ((F.col("closed") - F.col("at.closed") - F.col("closes").cast("bigint")) > 0)
    t_start = F.col("at.header.t0") + F.col("t") - F.col("dt") - F.col("at.t")
    return t.filter(~F.col("head") | F.col("problem").isNotNull()).select(
        "file",
        "block",
        "ord",
        "chain_no",
        F.coalesce("problem", F.when(~F.col("head") & dangling, F.lit("block line outside a chain"))).alias("problem"),
        "value",
        F.col("at.header.t_chrom").alias("t_chrom"),
        t_start.alias("t_start"),
        (t_start + F.col("size")).alias("t_end"),
        F.col("at.header.q_chrom").alias("q_chrom"),
        (F.col("at.header.q0") + F.col("q") - F.col("dq") - F.col("at.q")).alias("q_start"),
        F.col("at.header.q_size").alias("q_size"),
        F.col("at.header.q_neg").alias("q_neg"),
        F.col("at.header.score").alias("score"),
    )


def read_chain(spark: SparkSession, path: str, from_build: str, to_build: str) -> DataFrame:
    """Chain blocks of one file; malformed input raises."""
    rows = chain_rows(read_lines(spark, path))
    bad = rows.filter("problem is not null").select("problem", "value").limit(1).collect()
    if bad:
        raise ValueError(f"malformed chain: {bad[0].problem}: {bad[0].value}")
    return rows.select(
        F.lit(from_build).alias("from_build"),
        F.lit(to_build).alias("to_build"),
        source_order(spark).alias("blk"),
        "t_chrom",
        "t_start",
        "t_end",
        "q_chrom",
        "q_start",
        "q_size",
        "q_neg",
        "score",
    )
