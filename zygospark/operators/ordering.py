"""Genome order, contig numbering, exact row ranks and paging without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.functions.common import int_div
from zygospark.functions.naming import contig_ord
from zygospark.schema import PRIMARY_CHROMS
from zygospark.session import written

COORDINATE_ORDER = ["contig_ord", "pos", "end", "src_ord"]
TOP_K_ROWS = 100_000
SLICE = 1 << 10  # positions per slice of the record counter


def with_contig_order(calls: DataFrame, by: str = "kit") -> DataFrame:
    """Number the other contigs of each kit after MT, in first-seen order.

    Only one row per (kit, contig) is ranked; primary contigs keep their number.
    """
    columns = calls.columns
    seen = (
        calls.filter(contig_ord("chrom").isNull())
        .groupBy(by, "chrom")
        .agg(F.min("src_ord").alias("_seen"))
        .withColumn("_n", (F.row_number().over(W.partitionBy(by).orderBy("_seen", "chrom")) + len(PRIMARY_CHROMS)).cast("int"))
    )
    seen = written(seen)  # a bounded list of names; its file size lets the join broadcast it
    out = calls.drop("contig_ord").join(seen.select(by, "chrom", "_n"), [by, "chrom"], "left")
    return out.withColumn("contig_ord", F.coalesce(contig_ord("chrom"), F.col("_n"))).select(*columns)


def rank_rows(df: DataFrame, order: list[str | Column], name: str = "row_no") -> DataFrame:
    """Exact 0-based rank in a total order: range sort, then one offset per partition.

    The sorted rows are written out so that the ranks and the partition sizes
    come from the same materialised data even when executors are lost.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"))
    ranked = ranged.join(F.broadcast(offsets), "_part")  # bounded by the number of partitions
    return ranked.withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def page(df: DataFrame, order: list[str | Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows [offset, offset + limit) of a total order.

    Small pages use a per-partition top-k; deep or open-ended pages use exact
    ranks, because a plain offset would move everything into one task.
    """
    if offset == 0 and limit is None:
        return df.orderBy(*order)
    if limit is not None and offset + limit <= TOP_K_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    ranked = rank_rows(df, order)
    keep = F.col("row_no") >= offset
    if limit is not None:
        keep = keep & (F.col("row_no") < offset + limit)
    return ranked.filter(keep).orderBy("row_no").drop("row_no")


def records_between(calls: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, n): records of (kit, chrom) with lo < pos < hi for each range row.

    Every slice of 1024 positions becomes one row: the records before it, and the
    running count at each of its positions.  A range meets the slices of its two
    ends in joins, so no window and no group grows with the data.
    """
    at = ranges.select("id", "kit", "chrom", (F.col("lo") + 1).alias("first"), F.col("hi").alias("last"))
    at = at.withColumns({"s_first": int_div("first", SLICE), "s_last": int_div("last", SLICE)})
    asked = at.select("kit", "chrom", F.explode(F.array_distinct(F.array("s_first", "s_last"))).alias("slice")).distinct()
    counted = calls.groupBy("kit", "chrom", int_div("pos", SLICE).alias("slice"), "pos").agg(F.count("*").alias("n"))
    held = counted.groupBy("kit", "chrom", "slice").agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("held")
    )
    ahead = W.partitionBy("kit", "chrom").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = held.join(asked, ["kit", "chrom", "slice"], "full").select(
        "kit", "chrom", "slice", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("pre"),
        F.coalesce("held", F.array().cast("array<struct<pos:bigint,n:bigint>>")).alias("held"),
    )
    slices = written(slices)  # read for either end

    def before(rows: DataFrame, end: str) -> DataFrame:
        s = slices.withColumnRenamed("slice", f"s_{end}")
        inside = F.aggregate("held", F.lit(0).cast("bigint"), lambda n, h: n + F.when(h.pos < F.col(end), h.n).otherwise(0))
        return rows.join(s, ["kit", "chrom", f"s_{end}"]).withColumn(f"n_{end}", F.col("pre") + inside).drop("pre", "held")

    both = before(before(at, "first"), "last")
    return both.groupBy("id").agg(F.greatest(F.sum(F.col("n_last") - F.col("n_first")), F.lit(0)).alias("n"))
