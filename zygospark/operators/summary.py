"""Kit summaries: zygosity counts, per-contig counts, sex inference and caveats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospark.functions.common import round_places
from zygospark.functions.naming import contig_ord, in_par
from zygospark.functions.policy import has_rsids
from zygospark.schema import (
    ABSENT_MEANS_REF,
    EXPLICIT,
    HEMI,
    HET,
    HOM,
    HOM_ALT,
    HOM_REF,
    NO_CALL,
    OTHER_CONTIGS,
    PRIMARY_CHROMS,
    UNKNOWN_BUILD,
)
from zygospark.session import checked_broadcast

# Summary count names and the zygosity each counts.
ZYGOSITY_COUNTS = {
    "no_calls": NO_CALL,
    "het": HET,
    "hom_alt": HOM_ALT,
    "hom_ref": HOM_REF,
    "hom_unknown_ref": HOM,
    "hemizygous": HEMI,
}

# Sex inference thresholds.
MIN_X_SITES = 10
ARRAY_MALE_X, ARRAY_MALE_Y, ARRAY_FEMALE_X, ARRAY_FEMALE_Y = 0.03, 0.5, 0.08, 0.2
VCF_MALE_X, VCF_MALE_Y, VCF_FEMALE_X, VCF_FEMALE_Y = 0.25, 0.02, 0.4, 0.01


def zygosity_tallies() -> list[Column]:
    z = F.col("zygosity")
    return [
        F.count("*").alias("records"),
        *[F.count_if(z == value).alias(name) for name, value in ZYGOSITY_COUNTS.items()],
        F.count_if("ref_block").alias("ref_blocks"),
    ]


def zygosity_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("kit").agg(*zygosity_tallies())


def _sex_tallies(usable: Column) -> list[Column]:
    """Counts of the usable X and Y records outside the PAR."""
    x = usable & (F.col("chrom") == "X") & ~in_par("build", "chrom", "pos")
    y = usable & (F.col("chrom") == "Y")
    called = F.col("zygosity") != NO_CALL
    return [
        F.count_if(x & called).alias("x_called"),
        F.count_if(x & (F.col("zygosity") == HET)).alias("x_het"),
        F.count_if(y).alias("y_total"),
        F.count_if(y & called).alias("y_called"),
    ]


def chrom_counts(calls: DataFrame) -> DataFrame:
    """(kit, chrom, n) for the 25 primary contigs and other_contigs, zeros included."""
    key = F.when(contig_ord("chrom").isNotNull(), F.col("chrom")).otherwise(F.lit(OTHER_CONTIGS))
    counts = calls.groupBy("kit", key.alias("chrom")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(c) for c in [*PRIMARY_CHROMS, OTHER_CONTIGS]])
    grid = counts.select("kit").distinct().withColumn("chrom", F.explode(names))
    return grid.join(counts, ["kit", "chrom"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sex_tallies(calls: DataFrame, kits: DataFrame) -> DataFrame:
    """(kit, assay, x_called, x_het, y_total, y_called) outside the PAR and outside blocks."""
    meta = checked_broadcast(kits.select(F.col("id").alias("kit"), "build", "assay"))
    # Contigs are compared by number so that the scan can skip other row groups.
    xy = calls.filter(F.col("contig_ord").isin(23, 24) & ~F.col("ref_block")).join(meta, "kit")
    tallies = xy.groupBy("kit").agg(*_sex_tallies(F.lit(True)))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("x_called", "x_het", "y_total", "y_called")]
    return meta.join(tallies, "kit", "left").select("kit", "assay", *zero)


def infer_sex(tallies: DataFrame) -> DataFrame:
    """Adds sex, x_het_rate, y_call_rate (4 places), x_sites, y_sites, method."""
    array = F.col("assay") == "array"
    x, het, y, yc = F.col("x_called"), F.col("x_het"), F.col("y_total"), F.col("y_called")

    def rate(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    h = rate(het, x)
    r = F.when(array, rate(yc, y)).otherwise(rate(yc, x))
    on_array = (
        F.when((y > 0) & (h <= ARRAY_MALE_X) & (r >= ARRAY_MALE_Y), F.lit("male"))
        .when((h >= ARRAY_FEMALE_X) & ((y == 0) | (r <= ARRAY_FEMALE_Y)), F.lit("female"))
        .otherwise(F.lit("uncertain"))
    )
    on_vcf = (
        F.when((h <= VCF_MALE_X) & (r >= VCF_MALE_Y), F.lit("male"))
        .when((h >= VCF_FEMALE_X) & (r < VCF_FEMALE_Y), F.lit("female"))
        .otherwise(F.lit("uncertain"))
    )
    call = F.when(x < MIN_X_SITES, F.lit("uncertain")).when(array, on_array).otherwise(on_vcf)
    method = F.when(
        array,
        F.lit(
            f"array: het / called non-PAR X, called / listed Y; male <= {ARRAY_MALE_X} and >= {ARRAY_MALE_Y},"
            f" female >= {ARRAY_FEMALE_X} and <= {ARRAY_FEMALE_Y}"
        ),
    ).otherwise(
        F.lit(
            f"vcf: het / called non-PAR X, called Y / called non-PAR X; male <= {VCF_MALE_X} and >= {VCF_MALE_Y},"
            f" female >= {VCF_FEMALE_X} and < {VCF_FEMALE_Y}"
        )
    )
    return tallies.select(
        "*",
        call.alias("sex"),
        round_places(h, 4).alias("x_het_rate"),
        round_places(r, 4).alias("y_call_rate"),
        x.alias("x_sites"),
        y.alias("y_sites"),
        method.alias("method"),
    )


def _caveats(array: Column) -> Column:
    """Caveats of a row with a kit's facts, counts and inferred sex, in fixed order."""
    texts = [
        F.when(
            F.col("ref_calls") == ABSENT_MEANS_REF,
            F.lit(
                "only variants are listed: hom_ref counts listed records, and every other site stands for the reference"
            ),
        ).when(
            (F.col("ref_calls") == EXPLICIT) & (F.col("source_format") == "gvcf"),
            F.lit("reference blocks count in hom_ref, one for each block"),
        ),
        F.when(array, F.lit("an array tests chosen SNPs: nothing is known of other sites")),
        F.when(
            array & (F.col("hom_unknown_ref") > 0),
            F.concat(
                F.lit("no reference letter for "),
                F.col("hom_unknown_ref").cast("string"),
                F.lit(" homozygous array calls outside the coordinate table, counted as hom_unknown_ref"),
            ),
        ),
        F.when(F.col("build") == UNKNOWN_BUILD, F.lit("without a known build there is no PAR exclusion and no liftover")),
        F.when(
            F.col("sex") == "uncertain",
            F.concat(
                F.lit("sex is uncertain: x_het_rate "),
                F.regexp_replace(F.col("x_het_rate").cast("string"), r"\.0$", ""),
                F.lit(", y_call_rate "),
                F.regexp_replace(F.col("y_call_rate").cast("string"), r"\.0$", ""),
                F.lit(", "),
                F.col("x_sites").cast("string"),
                F.lit(" X sites outside the PAR"),
            ),
        ),
    ]
    return F.array_compact(F.array(*texts))


def caveats(counts: DataFrame, sexes: DataFrame, kits: DataFrame) -> DataFrame:
    """(kit, caveats) from zygosity counts, inferred sex and kit facts."""
    k = kits.select(F.col("id").alias("kit"), "build", "ref_calls", "source_format", F.col("assay").alias("kit_assay"))
    s = sexes.select("kit", "sex", "x_het_rate", "y_call_rate", "x_sites")
    rows = counts.select("kit", "hom_unknown_ref").join(k, "kit").join(s, "kit")
    return rows.select("kit", _caveats(F.col("kit_assay") == "array").alias("caveats"))


def summarize(calls: DataFrame, kits: DataFrame) -> DataFrame:
    """One summary row per kit, kits without calls included: counts, by_chrom map, sex struct, caveats.

    One scan and one aggregate of the calls; all else is per kit.
    """
    meta = checked_broadcast(kits.select(F.col("id").alias("kit"), "build", "assay", "ref_calls", "source_format"))
    main = contig_ord("chrom").isNotNull()
    chroms = {c: F.count_if(F.col("chrom") == c) for c in PRIMARY_CHROMS} | {OTHER_CONTIGS: F.count_if(~main)}
    by_chrom = F.create_map(*[x for c, n in chroms.items() for x in (F.lit(c), n)])
    found = calls.join(meta.select("kit", "build"), "kit").groupBy("kit")
    found = found.agg(*zygosity_tallies(), *_sex_tallies(~F.col("ref_block")), by_chrom.alias("by_chrom"))
    none = F.create_map(*[x for c in chroms for x in (F.lit(c), F.lit(0).cast("bigint"))])
    empty = {c: F.coalesce(c, none if c == "by_chrom" else F.lit(0).cast("bigint")) for c in found.columns if c != "kit"}
    rows = meta.join(found, "kit", "left").withColumns(empty)
    sex = F.struct(F.col("sex").alias("call"), "x_het_rate", "y_call_rate", "method", "x_sites", "y_sites")
    counts = ["kit", "records", *ZYGOSITY_COUNTS, "ref_blocks"]
    return infer_sex(rows).select(*counts, "by_chrom", sex.alias("sex"), _caveats(F.col("assay") == "array").alias("caveats"))


def kit_counts(calls: DataFrame, *more: Column) -> DataFrame:
    """(kit, records, rsid_records, has_rsids) and any further aggregates."""
    named = F.coalesce(F.col("rsid").startswith("rs"), F.lit(False))
    counts = calls.groupBy("kit").agg(F.count("*").alias("records"), F.count_if(named).alias("rsid_records"), *more)
    return counts.withColumn("has_rsids", has_rsids("records", "rsid_records"))
