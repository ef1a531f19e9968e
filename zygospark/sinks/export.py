"""Export files: VCF text, TSV / CSV / JSON rows, JSON documents."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zygospark.operators import export as E
from zygospark.operators.ordering import COORDINATE_ORDER, rank_rows
from zygospark.session import small_table, written

SCHEMA_LABEL = "zygospark/v1"


def write_vcf(calls: DataFrame, path: str, build: str, kit: str, source_format: str, sample: str) -> int:
    """VCF text parts whose concatenation in name order is the file; the header sorts first.

    Calls with a `region_no` keep the order of the regions.  Returns how many calls
    have no VCF form (array codes for insertions and deletions) and were left out.
    """
    regions = F.col("region_no") if "region_no" in calls.columns else F.lit(0)
    place = F.struct(regions.cast("int").alias("r"), *[F.col(c) for c in COORDINATE_ORDER])
    # Lines are made once; the count, the sort's sample and the sort read them from here.
    lines = written(E.vcf_lines(calls, build).select("chrom", place.alias("place"), "line"))
    skipped = lines.filter("line is null").count()
    body = lines.filter("line is not null").select(F.lit(1).alias("part"), F.lit(0).alias("at"), "place", "line")
    head = E.vcf_header_lines(lines.select("chrom", F.col("place.r").alias("region_no"), *[F.col(f"place.{c}").alias(c) for c in COORDINATE_ORDER]), build, kit, source_format, sample)
    fields = [F.col(f"first.{c}") for c in COORDINATE_ORDER]
    head = head.select(F.lit(0).alias("part"), "at", F.struct(F.col("first.region_no").alias("r"), *fields).alias("place"), "line")
    order = ["part", "at", "place"]
    head.unionByName(body).orderBy(*order).select("line").write.text(path)
    return skipped


def skipped_note(skipped: int) -> str | None:
    """What an export tells of the calls that it left out."""
    return f"{skipped} insertion or deletion codes of the array have no VCF form and were left out" if skipped else None


def _cell(c: Column, kind: T.DataType, null: str, precision: int | None) -> Column:
    """One text cell: arrays comma-joined, structs as k=v pairs, fixed decimals when asked."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(c.cast("array<string>"), ",", null)
    if isinstance(kind, T.StructType):
        pairs = [F.concat(F.lit(f"{f.name}="), _cell(c.getField(f.name), f.dataType, null, precision)) for f in kind]
        return F.when(c.isNull(), F.lit(null)).otherwise(F.concat_ws(";", *pairs))
    text = c.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = E.number_text(c) if precision is None else F.format_string(f"%.{precision}f", c.cast("double"))
        text = F.when(c.isNotNull(), text)
    return F.coalesce(text, F.lit(null))


def text_rows(df: DataFrame, columns: list[str] | None = None, null: str = "", precision: int | None = None) -> DataFrame:
    """All columns as text cells; `precision` None keeps exact numbers."""
    names = columns or df.columns
    return df.select(*[_cell(F.col(n), df.schema[n].dataType, null, precision).alias(n) for n in names])


def write_rows(
    df: DataFrame,
    path: str,
    fmt: str = "tsv",
    columns: list[str] | None = None,
    sep: str | None = None,
    header: bool = True,
    null: str = "",
    precision: int | None = None,
) -> None:
    """tsv, csv, jsonl or json (one document) files of a result."""
    if fmt in ("tsv", "csv"):
        out = text_rows(df, columns, null, precision)
        out.write.option("sep", sep or ("\t" if fmt == "tsv" else ",")).option("header", header).option("emptyValue", "").csv(path)
    elif fmt == "jsonl":
        df.select(*(columns or df.columns)).write.option("ignoreNullFields", "false").json(path)
    elif fmt == "json":
        write_document(df.select(*(columns or df.columns)), path, "genotypes")
    else:
        raise ValueError(f"unknown output format '{fmt}' (tsv, csv, json, jsonl)")


def document_lines(
    df: DataFrame, kind: str, warnings: list[str] | None = None, order: list[str] | None = None, columns: list[str] | None = None
) -> DataFrame:
    """(n, line): a JSON document with schema label, kind, count, data and warnings, a line for each row.

    Line 0 opens the document and the last one closes it; every row's line but the
    first begins with a comma.  Rows are numbered over a range sort, so no part of
    the document is put together in one place.  Without `order`, rows stay as they come.
    """
    keys = order or ["_at"]
    rows = df.select(F.struct(*(columns or df.columns)).alias("_row"), *([F.col(c) for c in order] if order else [F.monotonically_increasing_id().alias("_at")]))
    ranked = rank_rows(rows, keys)
    count = ranked.count()
    comma = F.when(F.col("row_no") > 0, F.lit(",")).otherwise(F.lit(""))
    body = ranked.select((F.col("row_no") + 1).alias("n"), F.concat(comma, F.to_json("_row", {"ignoreNullFields": "false"})).alias("line"))
    head = {"schema": SCHEMA_LABEL, "kind": kind, "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "count": count}
    frame = [(0, json.dumps(head, separators=(",", ":"))[:-1] + ',"data":['), (count + 1, f'],"warnings":{json.dumps(warnings or [])}}}')]
    return body.unionByName(small_table(df.sparkSession, frame, "n bigint, line string"))


def write_document(df: DataFrame, path: str, kind: str, warnings: list[str] | None = None, order: list[str] | None = None) -> None:
    """The document as text parts; put together in name order they are one JSON value."""
    document_lines(df, kind, warnings, order).orderBy("n").select("line").write.text(path)
