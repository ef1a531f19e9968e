"""rsid tables: the curated list and sites-only dbSNP VCF text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospark.functions import naming as N
from zygospark.functions.common import parse_u32
from zygospark.functions.genotype import rs_number
from zygospark.schema import GRCH37, GRCH38, RSID_COORDS
from zygospark.session import small_table
from zygospark.sources.text import read_lines, split_once

# Curated SNPs, 1-based plus-strand coordinates in both builds.
# rsid, gene, chrom, GRCh37 pos/ref/alt, GRCh38 pos/ref/alt
CURATED_SNPS = [
    ("rs429358", "APOE", "19", 45411941, "T", "C", 44908684, "T", "C"),
    ("rs7412", "APOE", "19", 45412079, "C", "T", 44908822, "C", "T"),
    ("rs1801133", "MTHFR", "1", 11856378, "G", "A,C", 11796321, "G", "A,C"),
    ("rs1801131", "MTHFR", "1", 11854476, "T", "G", 11794419, "T", "G"),
    ("rs6025", "F5", "1", 169519049, "T", "C,A", 169549811, "C", "T,A"),
    ("rs1800562", "HFE", "6", 26093141, "G", "A", 26092913, "G", "A"),
    ("rs4988235", "MCM6/LCT", "2", 136608646, "G", "A,C,T", 135851076, "G", "A,C,T"),
    ("rs4244285", "CYP2C19", "10", 96541616, "G", "A,C,T", 94781859, "G", "A,C,T"),
]
CURATED_IDS = [row[0] for row in CURATED_SNPS]


def curated_rsids(spark: SparkSession, rsids: list[str] | None = None) -> DataFrame:
    """The curated table, one row per SNP, optionally restricted to some ids."""
    df = small_table(
        spark,
        CURATED_SNPS,
        "rsid string, gene string, chrom string, grch37_pos bigint, grch37_ref string, grch37_alt string,"
        " grch38_pos bigint, grch38_ref string, grch38_alt string",
    ).withColumn("source", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/snp/"), "rsid"))
    for b in ("grch37", "grch38"):
        df = df.withColumn(f"{b}_alt", F.split(f"{b}_alt", ","))
    return df if not rsids else df.filter(F.col("rsid").isin(rsids))


def curated_coords(spark: SparkSession) -> DataFrame:
    """Curated SNPs as coordinate rows of both builds (source `curated`)."""
    rows = []
    for rsid, _, chrom, p37, r37, a37, p38, r38, a38 in CURATED_SNPS:
        for build, pos, ref, alt in ((GRCH37, p37, r37, a37), (GRCH38, p38, r38, a38)):
            rows.append((build, int(rsid[2:]), rsid, chrom, int(chrom), pos, ref, alt.split(","), "curated"))
    return small_table(spark, rows, RSID_COORDS)


def dbsnp_rows(lines: DataFrame) -> DataFrame:
    """Body lines of a sites-only VCF: kept flag, contig, position and id array."""
    body = lines.filter(~F.col("value").startswith("#")).select("file", split_once(F.split("value", "\t")).alias("f"))
    f = [F.get("f", F.lit(i)) for i in range(5)]
    chrom = N.normalize_chrom(f[0])
    alts = F.split(F.regexp_replace(f[4], r"^\s+|\s+$", ""), ",")
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    rows = body.select(
        "file",
        N.contig_ord(chrom).alias("contig_ord"),
        parse_u32(f[1]).alias("pos"),
        F.split(f[2], ";").alias("ids"),
        F.when(f[3].isin(list("ACGT")), f[3]).alias("ref"),
        F.array_intersect(bases, alts).alias("alt"),
        (F.size("f") >= 5).alias("whole"),
    )
    kept = F.col("whole") & F.col("contig_ord").isNotNull() & F.col("pos").isNotNull()
    return rows.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("whole")


def dbsnp_coords(lines: DataFrame, build: str | None = None) -> DataFrame:
    """One coordinate row per rs number (source `dbsnp`); build null when not given."""
    rows = dbsnp_rows(lines).filter("kept").withColumn("id", F.explode("ids"))
    rows = rows.withColumn("rs_num", rs_number("id")).filter("rs_num is not null")
    return rows.select(
        F.lit(build).cast("string").alias("build"),
        "rs_num",
        F.concat(F.lit("rs"), F.col("rs_num").cast("string")).alias("rsid"),
        N.contig_name("contig_ord").alias("chrom"),
        "contig_ord",
        "pos",
        "ref",
        "alt",
        F.lit("dbsnp").alias("source"),
    )


def dbsnp_counts(lines: DataFrame) -> DataFrame:
    """(file, kept, skipped): rs ids kept and rows skipped."""
    ids = F.size(F.filter("ids", lambda i: rs_number(i).isNotNull()))
    return (
        dbsnp_rows(lines)
        .groupBy("file")
        .agg(
            F.coalesce(F.sum(F.when(F.col("kept"), ids)), F.lit(0)).cast("bigint").alias("kept"),
            F.count_if(~F.col("kept")).alias("skipped"),
        )
    )


def dbsnp_build(lines: DataFrame) -> DataFrame:
    """(file, build) from the `##` header text, null when not stated."""
    low = F.lower("value")
    meta = F.col("value").startswith("##")
    flags = lines.groupBy("file").agg(
        F.bool_or(meta & N.contains_any(low, ["grch38", "hg38"])).alias("g38"),
        F.bool_or(meta & N.contains_any(low, ["grch37", "hg19"])).alias("g37"),
    )
    return flags.select("file", F.when(F.col("g38"), F.lit(GRCH38)).when(F.col("g37"), F.lit(GRCH37)).alias("build"))


def read_dbsnp(spark: SparkSession, path: str, build: str | None = None) -> DataFrame:
    """Coordinate rows of one dbSNP VCF; the build comes from the header unless given."""
    lines = read_lines(spark, path)
    if build is None:
        found = {r.build for r in dbsnp_build(lines).select("build").distinct().limit(3).collect()}
        if len(found) != 1 or None in found:
            raise ValueError("cannot tell the build of the dbSNP VCF from its header; pass build=")
        build = found.pop()
    return dbsnp_coords(lines, build)
