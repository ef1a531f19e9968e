"""Batch jobs on VCF record tables (chrom, pos, id, ref, alt array, qual, filter, info, gt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospark.functions.common import parse_decimal
from zygospark.functions.genotype import info_get

# Soft filter thresholds and label.
MIN_QUAL, MIN_DEPTH, LOW_QUAL = 20.0, 5.0, "LowQual"


def soft_filter(records: DataFrame, qual: str = "qual", info: str = "info", flt: str = "filter") -> DataFrame:
    """Set FILTER to LowQual where QUAL < 20 or INFO/DP < 5, else PASS; a missing value is not low."""
    depth = parse_decimal(info_get(info, "DP"))
    low = F.coalesce(F.col(qual) < MIN_QUAL, F.lit(False)) | F.coalesce(depth < MIN_DEPTH, F.lit(False))
    return records.withColumn(flt, F.when(low, F.lit(LOW_QUAL)).otherwise(F.lit("PASS")))


def pass_only(records: DataFrame, flt: str = "filter") -> DataFrame:
    return records.filter(F.col(flt) == "PASS")


def split_multiallelic(records: DataFrame) -> DataFrame:
    """One row per ALT allele (alt becomes text, alt_no its 1-based number).

    In the GT, the row's own allele becomes 1 and every other allele becomes 0;
    missing alleles stay missing and phasing marks are kept.  Single-ALT rows
    pass with their GT untouched.
    """
    rows = records.select(
        *[c for c in records.columns if c not in ("alt", "gt")],
        F.size("alt").alias("_n"),
        F.posexplode("alt").alias("_i", "alt"),
        "gt",
    )
    own = (F.col("_i") + 1).cast("string")
    # Tokens are digits or dots between phase marks: mark the own allele, zero the
    # others, then turn the mark into 1.
    marked = F.regexp_replace(F.col("gt"), F.concat(F.lit(r"(?<![0-9])"), own, F.lit(r"(?![0-9])")), F.lit("@"))
    gt = F.regexp_replace(F.regexp_replace(marked, "[0-9]+", "0"), "@", "1")
    return rows.select(
        *[c for c in records.columns if c not in ("alt", "gt")],
        own.cast("int").alias("alt_no"),
        "alt",
        F.when(F.col("_n") == 1, F.col("gt")).otherwise(gt).alias("gt"),
    )
