"""Table schemas and fixed domain values shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Genome builds.
GRCH37 = "GRCh37"
GRCH38 = "GRCh38"
UNKNOWN_BUILD = "unknown"

# Zygosity labels.
HET = "het"
HOM_REF = "hom_ref"
HOM_ALT = "hom_alt"
HOM = "hom"
HEMI = "hemi"
NO_CALL = "no_call"

# How a genotype answer came about.
OBSERVED = "observed"
INFERRED_REF = "inferred_ref"
MISSING = "missing"

# What an absent site means for a kit.
EXPLICIT = "explicit"
ABSENT_MEANS_REF = "absent-means-ref"
UNKNOWN_CALLS = "unknown"

# Length of chromosome 1 per build.
CHR1_LENGTH = {GRCH37: 249250621, GRCH38: 248956422}

# Pseudo-autosomal intervals of X, 1-based inclusive.
PAR_X = {
    GRCH37: [(60001, 2699520), (154931044, 155260560)],
    GRCH38: [(10001, 2781479), (155701383, 156030895)],
}

U32_MAX = 4294967295
AUTOSOMES = 22
PRIMARY_CHROMS = [str(i) for i in range(1, AUTOSOMES + 1)] + ["X", "Y", "MT"]
OTHER_CONTIGS = "other_contigs"

CALLS = T.StructType(
    [
        T.StructField("kit", T.StringType()),
        T.StructField("src_ord", T.LongType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("contig_ord", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("rsid", T.StringType()),
        T.StructField("rs_num", T.LongType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.ArrayType(T.StringType())),
        T.StructField("genotype", T.StringType()),
        T.StructField("gt", T.StringType()),
        T.StructField("zygosity", T.StringType()),
        T.StructField("filter", T.StringType()),
        T.StructField("quality", T.FloatType()),
        T.StructField("depth", T.LongType()),
        T.StructField("ref_block", T.BooleanType()),
    ]
)
CALL_COLUMNS = CALLS.fieldNames()

KITS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("source_format", T.StringType()),
        T.StructField("assay", T.StringType()),
        T.StructField("build", T.StringType()),
        T.StructField("build_evidence", T.StringType()),
        T.StructField("sample", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("has_rsids", T.BooleanType()),
        T.StructField("rsid_records", T.LongType()),
        T.StructField("ref_calls", T.StringType()),
        T.StructField("chip", T.StringType()),
        T.StructField("imported_at", T.TimestampType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)

CHAIN_BLOCKS = T.StructType(
    [
        T.StructField("from_build", T.StringType()),
        T.StructField("to_build", T.StringType()),
        T.StructField("blk", T.LongType()),
        T.StructField("t_chrom", T.StringType()),
        T.StructField("t_start", T.LongType()),
        T.StructField("t_end", T.LongType()),
        T.StructField("q_chrom", T.StringType()),
        T.StructField("q_start", T.LongType()),
        T.StructField("q_size", T.LongType()),
        T.StructField("q_neg", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)

RSID_COORDS = T.StructType(
    [
        T.StructField("build", T.StringType()),
        T.StructField("rs_num", T.LongType()),
        T.StructField("rsid", T.StringType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("contig_ord", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
    ]
)

REFERENCE_CHUNKS = T.StructType(
    [
        T.StructField("build", T.StringType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("seq", T.StringType()),
    ]
)

GENOTYPE_COLUMNS = [
    "kit",
    "rsid",
    "chrom",
    "pos",
    "build",
    "ref",
    "alt",
    "genotype",
    "zygosity",
    "call_source",
    "filter",
    "quality",
    "depth",
    "lifted_from",
]
