"""Import-time policies of a kit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zygospark.functions.common import as_col
from zygospark.functions.naming import parse_build
from zygospark.schema import ABSENT_MEANS_REF, EXPLICIT, UNKNOWN_BUILD, UNKNOWN_CALLS


def ref_calls_policy(assay, source_format, fastq_derived=None, override=None) -> Column:
    """What an absent site means; an explicit override wins."""
    derived = F.lit(False) if fastq_derived is None else as_col(fastq_derived)
    asked = F.lit(None).cast("string") if override is None else as_col(override)
    rule = (
        F.when((as_col(assay) == "array") | (as_col(source_format) == "gvcf"), F.lit(EXPLICIT))
        .when(derived, F.lit(UNKNOWN_CALLS))
        .when(as_col(assay) == "wgs", F.lit(ABSENT_MEANS_REF))
        .otherwise(F.lit(UNKNOWN_CALLS))
    )
    return F.coalesce(asked, rule)


def build_policy(detected, evidence, override=None) -> Column:
    """struct(build, evidence, warning) after an optional user override."""
    d, e = as_col(detected), as_col(evidence)
    o = F.lit(None).cast("string") if override is None else parse_build(override)
    clash = o.isNotNull() & (o != d)
    text = F.concat(F.lit("build overridden: file indicates "), d, F.lit(", the caller says "), o)
    return F.struct(
        F.coalesce(o, d).alias("build"),
        F.when(clash, F.lit("assumed")).otherwise(e).alias("evidence"),
        F.when(clash & (d != UNKNOWN_BUILD), text).alias("warning"),
    )


def has_rsids(records, rsid_records) -> Column:
    return (as_col(records) > 0) & (as_col(rsid_records) * 2 >= as_col(records))
