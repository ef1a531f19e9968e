"""Builds, contig names, loci, regions, kit and lane names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from zygospark.functions.common import as_col, let, parse_decimal, parse_u32
from zygospark.schema import (
    AUTOSOMES,
    CHR1_LENGTH,
    GRCH37,
    GRCH38,
    PAR_X,
    PRIMARY_CHROMS,
    U32_MAX,
    UNKNOWN_BUILD,
)

# Accepted build names.
BUILD_NAMES = {
    GRCH37: ["grch37", "hg19", "b37", "37", "hs37d5"],
    GRCH38: ["grch38", "hg38", "b38", "38"],
    UNKNOWN_BUILD: ["unknown"],
}

# Build markers inside VCF header text; GRCh38 is tested first.
HEADER_MARKERS = [
    (GRCH38, ["grch38", "hg38", "gca_000001405.15", "b38", "hs38"]),
    (GRCH37, ["grch37", "hg19", "b37", "hs37d5", "human_g1k_v37", "gca_000001405.1"]),
]

# Contig aliases (array chromosome codes and mitochondrial names).
CONTIG_ALIASES = {
    "X": ["23", "25", "XY", "x"],
    "Y": ["24", "y"],
    "MT": ["26", "M", "m", "MT", "mt", "Mt"],
}

# Extensions dropped from a file name, each once, in this order.
NAME_EXTENSIONS = [".gz", ".bgz", ".vcf", ".gvcf", ".g", ".txt", ".csv", ".tsv"]

# Read-1 file name tokens and their read-2 counterparts.
MATE_TOKENS = [("_R1_", "_R2_"), ("_R1.", "_R2."), ("_1.", "_2."), (".R1.", ".R2."), ("_r1.", "_r2.")]


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def parse_build(s: Column | str) -> Column:
    t = F.lower(F.regexp_replace(as_col(s), r"^\s+|\s+$", ""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for build, names in BUILD_NAMES.items():
        out = out.when(t.isin(names), F.lit(build))
    return out


def other_build(b: Column | str) -> Column:
    b = as_col(b)
    return F.when(b == GRCH37, F.lit(GRCH38)).when(b == GRCH38, F.lit(GRCH37)).otherwise(F.lit(UNKNOWN_BUILD))


def build_from_chr1_length(n: Column | str) -> Column:
    n = as_col(n)
    return F.when(n == CHR1_LENGTH[GRCH37], F.lit(GRCH37)).when(n == CHR1_LENGTH[GRCH38], F.lit(GRCH38))


def build_from_text(s: Column | str) -> Column:
    t = F.lower(as_col(s))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for build, markers in HEADER_MARKERS:
        out = out.when(contains_any(t, markers), F.lit(build))
    return out


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_chrom(raw: Column | str) -> Column:
    """Contig name without `chr`, array codes mapped, RefSeq accessions mapped.

    `1` and `chr1` style names leave the CASE on its first branches, so the
    regular expressions only run for other spellings.
    """
    raw = as_col(raw)
    bare = F.substring(raw, 4, 1 << 30)
    base = F.regexp_replace(raw, r"^\s*(?:chr|Chr|CHR)?|\s+$", "")
    aliases = {name: target for target, names in CONTIG_ALIASES.items() for name in names}
    numbers = {str(i): c for i, c in enumerate(PRIMARY_CHROMS[:24], 1)}
    number = F.regexp_extract(base, r"^NC_0000\+?0*([0-9]+)(\..*)?$", 1)
    accession = F.coalesce(
        F.try_element_at(_map(numbers), number), F.when(base.rlike(r"^NC_012920(\.|$)"), F.lit("MT"))
    )
    named = F.coalesce(
        F.try_element_at(_map(aliases), base), F.when(base.startswith("NC_"), accession), base
    )
    return (
        F.when(raw.isin(PRIMARY_CHROMS), raw)
        .when(raw.startswith("chr") & bare.isin(PRIMARY_CHROMS), bare)
        .otherwise(named)
    )


def contig_ord(chrom: Column | str) -> Column:
    """1..22, X=23, Y=24, MT=25, null for every other contig."""
    c = as_col(chrom)
    digits = F.regexp_extract(c, r"^\+?0*([1-9][0-9]?)$", 1).try_cast("int")  # `05` and `+5` count as 5
    return (
        F.when(c.isin(PRIMARY_CHROMS[:AUTOSOMES]), c.try_cast("int"))
        .when(c == "X", F.lit(23))
        .when(c == "Y", F.lit(24))
        .when(c == "MT", F.lit(25))
        .when((c.startswith("0") | c.startswith("+")) & digits.between(1, AUTOSOMES), digits)
    )


def is_primary(chrom: Column | str) -> Column:
    return contig_ord(chrom).isNotNull()


def contig_name(ordinal: Column | str) -> Column:
    o = as_col(ordinal)
    return (
        F.when(o == 23, F.lit("X")).when(o == 24, F.lit("Y")).when(o == 25, F.lit("MT")).otherwise(o.cast("string"))
    )


def in_par(build: Column | str, chrom: Column | str, pos: Column | str) -> Column:
    b, c, p = as_col(build), as_col(chrom), as_col(pos)
    hits = [(b == name) & p.between(lo, hi) for name, spans in PAR_X.items() for lo, hi in spans]
    return F.coalesce((c == "X") & reduce(lambda x, y: x | y, hits), F.lit(False))


def parse_locus(s: Column | str) -> Column:
    """`CHR:POS` to struct(chrom, pos); null when malformed."""
    s = as_col(s)
    pattern = r"(?s)^(.+):([^:]*)$"
    pos = parse_u32(F.regexp_replace(F.regexp_extract(s, pattern, 2), "[,_]", ""))
    chrom = normalize_chrom(F.regexp_extract(s, pattern, 1))
    return F.when(s.rlike(pattern) & (pos > 0), F.struct(chrom.alias("chrom"), pos.alias("pos")))


def _scaled(text: Column) -> Column:
    def value(s: Column) -> Column:
        mult = F.when(s.rlike("[kK]$"), F.lit(1e3)).when(s.rlike("[mM]$"), F.lit(1e6)).otherwise(F.lit(1.0))
        return F.floor(parse_decimal(F.regexp_replace(s, "[kKmM]$", "")) * mult + 0.5)

    return let(let(F.regexp_replace(text, "[,_]", ""), value), lambda v: F.when(v.between(0, U32_MAX), v))


def parse_region(s: Column | str) -> Column:
    """`CHR[:START[-END]]` with k/M suffixes to struct(chrom, start, end); null when malformed."""
    s = as_col(s)
    pattern = r"(?s)^([^:]*)(:(.*))?$"

    def bounds(span: Column) -> Column:
        first, second = _scaled(F.substring_index(span, "-", 1)), _scaled(F.regexp_extract(span, r"(?s)^[^-]*-(.*)$", 1))
        paired = F.contains(span, F.lit("-"))
        both = let(first, lambda v: F.struct(F.when(v < 1, F.lit(1)).otherwise(v).alias("start"), second.alias("end")))
        one = let(first, lambda v: F.struct(v.alias("start"), v.alias("end")))
        return F.when(paired, both).otherwise(one)

    whole = F.struct(F.lit(1).cast("bigint").alias("start"), F.lit(U32_MAX).cast("bigint").alias("end"))
    span = F.when(F.contains(s, F.lit(":")), let(F.regexp_extract(s, pattern, 3), bounds)).otherwise(whole)
    parts = F.struct(F.regexp_extract(s, pattern, 1).alias("c"), span.alias("b"))
    return let(
        parts,
        lambda x: F.when(
            (x.c != "") & (x.b.start <= x.b.end),
            F.struct(normalize_chrom(x.c).alias("chrom"), x.b.start.alias("start"), x.b.end.alias("end")),
        ),
    )


def vcf_contig(build: Column | str, chrom: Column | str) -> Column:
    b, c = as_col(build), as_col(chrom)
    g38 = b == GRCH38
    return (
        F.when(g38 & (c == "MT"), F.lit("chrM"))
        .when(g38 & is_primary(c), F.concat(F.lit("chr"), c))
        .otherwise(c)
    )


def default_kit_name(path: Column | str) -> Column:
    name = F.regexp_extract(as_col(path), r"([^/]*)$", 1)
    for ext in NAME_EXTENSIONS:
        name = F.regexp_replace(name, ext.replace(".", r"\.") + "$", "")
    return name


def _cut_at_last(name: Column, token: str) -> tuple[Column, Column]:
    parts = F.split(name, token.replace(".", r"\."))
    head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), token)
    return F.when(F.size(parts) > 1, head), F.element_at(parts, -1)


def mate_name(name: Column | str) -> Column:
    """File name of the read-2 mate for a read-1 file name, else null."""
    name = as_col(name)
    out = []
    for one, two in MATE_TOKENS:
        head, tail = _cut_at_last(name, one)
        out.append(F.concat(head, F.lit(two), tail))
    return F.coalesce(*out)


def lane_of(name: Column | str) -> Column:
    """struct(sample, lane) of a read-1 file name; lane is null without an `_L00n` token."""
    name = as_col(name)
    tokens = ["_R1_", "_R1.", "_1.", ".R1.", "_r1."]
    stem = F.coalesce(*[_cut_at_last(name, t)[0] for t in tokens], name)
    lane_pattern = r"^(.*)_(L[0-9]{3})$"
    lane = F.when(stem.rlike(lane_pattern), F.regexp_extract(stem, lane_pattern, 2))
    stem = F.when(lane.isNotNull(), F.regexp_extract(stem, lane_pattern, 1)).otherwise(stem)
    return F.struct(F.regexp_replace(stem, r"_S[0-9]+$", "").alias("sample"), lane.alias("lane"))
