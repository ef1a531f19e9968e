"""Region scans, pages, VCF lines and genotype rows of one kit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospark.functions.genotype import genotype_row, vcf_fields
from zygospark.functions.naming import vcf_contig
from zygospark.operators.enrich import enrich_arrays
from zygospark.operators.ordering import COORDINATE_ORDER, page
from zygospark.operators.rsids import Coords
from zygospark.schema import OBSERVED
from zygospark.session import checked_broadcast, small_table, written

VERSION = "VCFv4.2"
#: (bits of a cell, least length) of regions that share a cell width.
WIDTHS = [(14, 0), (20, 1 << 17)]
SUMMED = (14, 20, 26, 32)  # bits of the cells whose calls are added up
BEYOND = 1 << 28  # past the longest contig; places from here on share the last cell
LISTED = 1000  # regions whose contigs go into the scan as literals
FEW = 10_000  # calls of a page that are enriched without sending others around them


def _cells(first: Column, last: Column, shift: int) -> Column:
    """Numbers of the cells of 2 ** shift positions from one place to another; the last cell has no end."""
    cap = F.lit(BEYOND >> shift)
    return F.sequence(F.least(F.shiftright(first, shift), cap), F.least(F.shiftright(last, shift), cap))


def region_scan(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """Calls whose start lies in a region, once per requested region.

    `regions` has (region_no, chrom, start, end).  A call in two regions comes
    back twice, and a block that starts before a region does not come back.

    Short and long regions are cut into cells of their own width, and a call meets
    the regions of its cell alone.  A call's place is in one cell of each width, so
    nothing is exploded on its side.
    """
    r = regions.select("region_no", F.col("chrom").alias("r_chrom"), F.col("start").cast("bigint").alias("r_start"), F.col("end").cast("bigint").alias("r_end"))
    r = written(r.filter("r_start <= r_end"))
    extent = r.agg(F.count("*").alias("n"), F.min("r_start").alias("lo"), F.max("r_end").alias("hi"), F.max(F.col("r_end") - F.col("r_start")).alias("longest"), F.min(F.col("r_end") - F.col("r_start")).alias("shortest")).first()
    if extent.n == 0:
        return calls.filter(F.lit(False)).select(F.lit(None).cast(regions.schema["region_no"].dataType).alias("region_no"), *calls.columns)
    # The reach of the whole list goes into the scan.
    near = calls.filter(F.col("pos").between(extent.lo, extent.hi))
    if extent.n <= LISTED:
        near = near.filter(F.col("chrom").isin([x.r_chrom for x in r.select("r_chrom").distinct().collect()]))
    parts = []
    for (shift, least), most in zip(WIDTHS, [w[1] - 1 for w in WIDTHS[1:]] + [None], strict=True):
        if extent.longest < least or (most is not None and extent.shortest > most):
            continue
        of_width = (F.col("r_end") - F.col("r_start")) >= least
        of_width = of_width if most is None else of_width & ((F.col("r_end") - F.col("r_start")) <= most)
        cells = checked_broadcast(r.filter(of_width).withColumn("_cell", F.explode(_cells(F.col("r_start"), F.col("r_end"), shift))))
        own = F.least(F.shiftright("pos", shift), F.lit(BEYOND >> shift))
        hit = near.withColumn("_own", own).join(cells, (F.col("chrom") == F.col("r_chrom")) & (F.col("_own") == F.col("_cell")) & F.col("pos").between(F.col("r_start"), F.col("r_end")))
        parts.append(hit.select("region_no", *calls.columns))
    return reduce(DataFrame.unionByName, parts)


def _span(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _with_shift(cells: Column, shift: int) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(shift).alias("shift"), c.alias("cell")))


def _cover(start: Column, end: Column) -> tuple[Column, Column]:
    """(cells partly in a region, [shift, cell] of whole ones): the widest that fit, so few at every width."""
    shift = SUMMED[0]
    first, last = F.shiftright(start + ((1 << shift) - 1), shift), F.shiftright(end + 1, shift) - 1
    ends = F.array_distinct(F.array(F.shiftright(start, shift), F.shiftright(end, shift)))
    partly = F.filter(ends, lambda c: (c < first) | (c > last))
    whole = []
    for shift, wider in zip(SUMMED, [*SUMMED[1:], None], strict=True):
        cells = _span(first, last)
        if wider is not None:
            step = wider - shift
            up, to = F.shiftright(first + ((1 << step) - 1), step), F.shiftright(last + 1, step) - 1
            outer = F.concat(_span(first, F.shiftleft(up, step) - 1), _span(F.shiftleft(to + 1, step), last))
            cells = F.when(up <= to, outer).otherwise(cells)
            # Where no wider cell fits, nothing is left for the next width.
            first, last = up, to
        whole.append(_with_shift(cells, shift))
    return partly, F.concat(*whole)


def region_totals(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_no, calls, orders, first_pos, last_end, het) of the calls that `region_scan` gives for a region.

    Calls are added up per cell of 2 ** 14 places and wider ones.  A region takes
    the sums of the cells inside it and meets calls only in the cells of its two
    ends, so a long region costs no more rows than the cells that cover it.
    """
    r = regions.select("region_no", "chrom", F.greatest(F.col("start").cast("bigint"), F.lit(0)).alias("r_start"), F.col("end").cast("bigint").alias("r_end"))
    sums = [F.sum(c).alias(c) for c in ("calls", "orders", "het")] + [F.min("first_pos").alias("first_pos"), F.max("last_end").alias("last_end")]
    each = calls.filter("pos >= 0").select(
        "chrom", F.shiftright(F.col("pos").cast("bigint"), SUMMED[0]).alias("cell"), F.lit(1).cast("bigint").alias("calls"), F.col("src_ord").alias("orders"),
        F.when(F.col("zygosity") == "het", 1).otherwise(0).cast("bigint").alias("het"), F.col("pos").alias("first_pos"), F.col("end").alias("last_end"),
    )
    least = written(each.groupBy("chrom", "cell").agg(*sums))
    reach = least.agg(F.max("cell")).first()[0]
    most = -1 if reach is None else ((reach + 1) << SUMMED[0]) - 1
    r = r.withColumn("r_end", F.least("r_end", F.lit(most).cast("bigint"))).filter("r_start <= r_end")
    partly, whole = _cover(F.col("r_start"), F.col("r_end"))
    r = written(r.withColumns({"partly": partly, "whole": whole}))
    levels = [
        least.withColumn("cell", F.shiftright("cell", shift - SUMMED[0])).groupBy("chrom", "cell").agg(*sums).withColumn("shift", F.lit(shift))
        for shift in SUMMED[1:]
    ]
    cells = reduce(DataFrame.unionByName, levels, least.withColumn("shift", F.lit(SUMMED[0])))
    inside = r.select("region_no", "chrom", F.explode("whole").alias("x")).select("region_no", "chrom", "x.*").join(cells, ["chrom", "shift", "cell"])
    ends = r.select("region_no", "chrom", "r_start", "r_end", F.explode("partly").alias("cell"))
    met = each.join(ends, ["chrom", "cell"]).filter(F.col("first_pos").between(F.col("r_start"), F.col("r_end")))
    columns = ["region_no", "calls", "orders", "het", "first_pos", "last_end"]
    return inside.select(*columns).unionByName(met.select(*columns)).groupBy("region_no").agg(*sums)


def export_calls(
    calls: DataFrame,
    regions: DataFrame | None = None,
    offset: int = 0,
    limit: int | None = None,
    kits: DataFrame | None = None,
    coords: Coords = None,
    reference: DataFrame | None = None,
) -> DataFrame:
    """Calls in export order: region by region, in coordinate order, then paged, then enriched.

    With `kits`, array calls of the page get the reference, alternates and id that
    the coordinate table and the reference know; other calls stay as stored.
    """
    order = COORDINATE_ORDER if regions is None else ["region_no", *COORDINATE_ORDER]
    rows = page(calls if regions is None else region_scan(calls, regions), order, offset, limit)
    if kits is None:
        return rows
    few = limit is not None and limit <= FEW
    return enrich_arrays(written(rows) if few else rows, kits, coords, reference, split=not few).orderBy(*order)


def genotype_rows(calls: DataFrame, build: Column | str) -> DataFrame:
    """The 14-column genotype contract for stored calls."""
    b = F.lit(build) if isinstance(build, str) else build
    return calls.select(*genotype_row(build=b, call_source=F.lit(OBSERVED)))


def number_text(q: Column) -> Column:
    """Shortest decimal text of a number, without an exponent and without trailing zeros."""
    text = q.cast("string")
    plain = text.try_cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(plain, r"\.?0+$", "")
    return F.when(text.contains("E"), F.coalesce(F.nullif(plain, F.lit("")), text)).otherwise(F.regexp_replace(text, r"\.0$", ""))


def vcf_lines(calls: DataFrame, build: Column | str) -> DataFrame:
    """Calls plus `line` (null for array codes without a VCF form)."""
    b = F.lit(build) if isinstance(build, str) else build
    dot = F.lit(".")
    v = calls.withColumn("_v", vcf_fields("ref_block", "ref", "alt", "gt", "genotype", "zygosity"))
    info = F.concat_ws(
        ";",
        F.when(F.col("ref_block"), F.concat(F.lit("END="), F.col("end").cast("string"))),
        F.when(F.col("_v.ref") == "N", F.lit("REF_UNKNOWN")),
    )
    line = F.concat_ws(
        "\t",
        vcf_contig(b, "chrom"),
        F.col("pos").cast("string"),
        F.coalesce("rsid", dot),
        F.col("_v.ref"),
        F.col("_v.alt"),
        F.coalesce(number_text(F.col("quality")), dot),
        F.coalesce("filter", dot),
        F.coalesce(F.nullif(info, F.lit("")), dot),
        F.lit("GT:DP"),
        F.concat(F.col("_v.gt"), F.lit(":"), F.coalesce(F.col("depth").cast("string"), dot)),
    )
    return v.withColumn("line", F.when(F.col("_v").isNotNull(), line)).drop("_v")


def vcf_header_lines(calls: DataFrame, build: str, kit: str, source_format: str, sample: str) -> DataFrame:
    """(at, line) header of an export; contigs in first-appearance order."""
    spark = calls.sparkSession
    fixed = [
        (0, f"##fileformat={VERSION}"),
        (1, f"##source=zygospark export of {kit} ({source_format})"),
        (2, f"##reference={build}"),
        (4, '##INFO=<ID=END,Number=1,Type=Integer,Description="Last position of a block">'),
        (5, '##INFO=<ID=REF_UNKNOWN,Number=0,Type=Flag,Description="REF is N: an array lists no reference letter">'),
        (6, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'),
        (7, '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">'),
        (8, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])),
    ]
    order = ["region_no", *COORDINATE_ORDER] if "region_no" in calls.columns else COORDINATE_ORDER
    contigs = calls.groupBy("chrom").agg(F.min(F.struct(*order)).alias("first"))
    lines = small_table(spark, fixed, "at int, line string").select("at", F.lit(None).cast(contigs.schema["first"].dataType).alias("first"), "line")
    named = contigs.select(
        F.lit(3).alias("at"), "first", F.concat(F.lit("##contig=<ID="), vcf_contig(F.lit(build), "chrom"), F.lit(">")).alias("line")
    )
    return lines.unionByName(named).orderBy("at", "first")
