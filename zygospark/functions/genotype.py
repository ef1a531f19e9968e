"""Genotype expressions: zygosity, allele letters, comparison keys, VCF fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zygospark.functions.common import as_col, blank_to_null, let, parse_u32, round_places

from zygospark.schema import HEMI, HET, HOM, HOM_ALT, HOM_REF, NO_CALL

EMPTY_STRINGS = "array<string>"
BASES = ["A", "C", "G", "T"]
PLAIN_GTS = [a + sep + b for a in "01" for sep in "/|" for b in "01"] + ["0", "1"]
MISSING_ALLELE = r"(^|[/|])\.?([/|]|$)"


def no_strings() -> Column:
    return F.array().cast(EMPTY_STRINGS)


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def array_zygosity(genotype: Column | str, ref: Column | str | None = None) -> Column:
    """Zygosity of array letters; the reference only counts when it is one base."""
    g = as_col(genotype)
    r = F.lit(None).cast("string") if ref is None else as_col(ref)
    first, second = F.substring(g, 1, 1), F.substring(g, 2, 1)
    n = F.length(g)
    return (
        F.when(g.isNull() | (n == 0) | g.rlike("[-0?N ]") | (n > 2), F.lit(NO_CALL))
        .when(n == 1, F.lit(HEMI))
        .when(first != second, F.lit(HET))
        .when(F.length(r) == 1, F.when(r == first, F.lit(HOM_REF)).otherwise(F.lit(HOM_ALT)))
        .otherwise(F.lit(HOM))
    )


def is_symbolic(alt: Column | str) -> Column:
    a = as_col(alt)
    return a.startswith("<") | (a == "*") | a.rlike(r"[\[\]]")


def split_alts(alt_text: Column | str) -> Column:
    """ALT column to array; `.` is the empty list."""
    a = as_col(alt_text)
    return F.when(a == ".", no_strings()).otherwise(F.split(a, ","))


def stored_alts(alt_text: Column | str) -> Column:
    """ALT alleles kept in a call: angle-bracket alleles dropped, `*` kept."""
    a = as_col(alt_text)
    alts = split_alts(a)
    return F.when(F.contains(a, F.lit("<")), F.filter(alts, lambda x: ~x.startswith("<"))).otherwise(alts)


def only_symbolic(alt_text: Column | str) -> Column:
    """True when every ALT allele is symbolic; also true for `.`."""
    one = r"(<[^,]*|\*|[^,]*[\[\]][^,]*)"
    a = as_col(alt_text)
    return ~a.isin(BASES) & ((a == ".") | a.rlike(f"^{one}(,{one})*$"))


def genotype_letters(gt: Column | str, ref: Column | str, alt_text: Column | str) -> Column:
    """Allele letters of a GT string, from the REF and ALT columns.

    Nearly all rows of a real file are a single-base REF and ALT with a plain
    diploid GT: those are one character translation.  Everything else takes the
    general array form.  Arguments are read several times: pass stored columns.
    """
    gt, ref, alt = as_col(gt), as_col(ref), as_col(alt_text)
    snv = gt.isin(PLAIN_GTS) & ref.isin(BASES) & alt.isin(BASES)
    letters = F.call_function("translate", gt, F.lit("01/|"), F.concat(ref, alt))

    def allele(idx: Column) -> Column:
        k = F.when(idx.rlike(r"^\+?[0-9]+$"), idx.try_cast("int"))
        text = F.split_part(alt, F.lit(","), F.greatest(k, F.lit(1)))
        named = F.regexp_replace(text, r"^(<.*|\*|.*[\[\]].*|)$", "N")
        return F.when(k.isNull(), F.lit("N")).when(k == 0, ref).when(alt == ".", F.lit("N")).otherwise(named)

    joined = F.array_join(F.transform(F.split(gt, r"[/|]"), allele), "/")
    # Single letters stand together, longer alleles keep the slash.
    general = let(joined, lambda j: F.when(j.rlike(r"^[^/](/[^/])*$"), F.translate(j, "/", "")).otherwise(j))
    return (
        F.when(snv, letters)
        .when(gt.isin("./.", ".|."), F.lit("--"))
        .when(gt.rlike(r"^\.?$"), F.lit("-"))
        .when(gt.rlike(MISSING_ALLELE), F.lit("--"))
        .otherwise(general)
    )


def vcf_zygosity(gt: Column | str) -> Column:
    """Zygosity from the GT index texts (`01` and `1` count as different)."""
    gt = as_col(gt)
    return (
        F.when(gt.isin("0/1", "1/0", "0|1", "1|0"), F.lit(HET))
        .when(gt.isin("1/1", "1|1"), F.lit(HOM_ALT))
        .when(gt.isin("0/0", "0|0"), F.lit(HOM_REF))
        .when(gt.isin("./.", ".|."), F.lit(NO_CALL))
        .when(gt.isin("0", "1"), F.lit(HEMI))
        .when(gt.rlike(MISSING_ALLELE), F.lit(NO_CALL))
        .when(~gt.rlike(r"[/|]"), F.lit(HEMI))
        .when(gt.rlike(r"^0([/|]0)+$"), F.lit(HOM_REF))
        .when(gt.rlike(r"^([^/|]*)([/|]\1)+$"), F.lit(HOM_ALT))
        .otherwise(F.lit(HET))
    )


def info_get(info: Column | str, key: str) -> Column:
    """Value of the first `key=value` entry of an INFO string, else null."""
    info = as_col(info)
    pattern = f"(?:^|;){key}=([^;]*)"
    there = F.contains(info, F.lit(f"{key}=")) & info.rlike(pattern)
    return F.when(there, F.regexp_extract(info, pattern, 1))


def format_get(fmt: Column, values: Column, key: str) -> Column:
    """Sample value for a FORMAT key; both arguments are already split arrays."""
    at = F.array_position(fmt, F.lit(key))
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))


def call_depth(fmt_text: Column | str, sample: Column | str, info: Column | str) -> Column:
    """First present of FORMAT DP, FORMAT MIN_DP, INFO DP; a present `.` stops the search."""
    fmt_text, sample = as_col(fmt_text), as_col(sample)
    fmt, vals = F.split(fmt_text, ":"), F.split(sample, ":")
    second = F.split_part(sample, F.lit(":"), F.lit(2))
    usual = ((fmt_text == "GT:DP") | fmt_text.startswith("GT:DP:")) & (second != "")
    searched = F.coalesce(format_get(fmt, vals, "DP"), format_get(fmt, vals, "MIN_DP"), info_get(info, "DP"))
    return parse_u32(F.when(usual, second).otherwise(searched))


def call_end(pos: Column, ref: Column, info_end: Column) -> Column:
    return F.greatest(F.coalesce(info_end, pos + F.greatest(F.length(ref) - 1, F.lit(0))), pos)


def pick_rsid(id_text: Column | str) -> Column:
    c = as_col(id_text)
    simple = F.when(c.startswith("rs"), c)
    return F.when(
        F.contains(c, F.lit(";")), F.get(F.filter(F.split(c, ";"), lambda x: x.startswith("rs")), F.lit(0))
    ).otherwise(simple)


def rs_number(rsid: Column | str) -> Column:
    return parse_u32(F.regexp_extract(as_col(rsid), r"^(?:rs|RS)(\+?[0-9]+)$", 1))


def indexed_rs(rsid: Column | str) -> Column:
    """rs number used for lookups; zero and non-numeric ids have none."""
    return F.nullif(rs_number(rsid), F.lit(0).cast("bigint"))


def complement(s: Column | str) -> Column:
    """Base complement without reversal; other characters are kept."""
    return F.translate(as_col(s), "ACGTacgt", "TGCAtgca")


def allele_key(genotype: Column | str) -> Column:
    """Sorted allele array; null for no-calls; one allele counts twice."""
    g = as_col(genotype)
    alleles = F.when(F.contains(g, F.lit("/")), F.split(g, "/")).otherwise(chars(g))
    bad = (g == "") | F.exists(alleles, lambda a: a.isin("", "-", ".", "0", "N"))
    doubled = F.when(F.size(alleles) == 1, F.concat(alleles, alleles)).otherwise(alleles)
    return F.when(~bad, F.sort_array(doubled))


def snv_key(genotype: Column | str, zygosity: Column | str) -> Column:
    """Order-free A/C/G/T key as text, null when the call is not comparable."""
    g, z = as_col(genotype), as_col(zygosity)
    a, b = F.substring(g, 1, 1), F.substring(g, 2, 1)
    many = F.array_join(F.sort_array(F.split(g, "")), "")
    return F.when(
        (z != NO_CALL) & g.rlike("^[ACGT]+$"),
        F.when(F.length(g) == 2, F.concat(F.least(a, b), F.greatest(a, b)))
        .when(F.length(g) == 1, F.concat(g, g))
        .otherwise(many),
    )


def is_called(zygosity: Column | str = "zygosity") -> Column:
    return as_col(zygosity) != NO_CALL


def hom_ref_letters(ref: Column | str) -> Column:
    """Genotype text of an inferred reference call: the reference twice."""
    r = as_col(ref)
    return F.concat(r, r)


def lifted(c: Column | str, reverse: Column | str) -> Column:
    """Allele text moved to the plus strand of the target build."""
    c = as_col(c)
    return F.when(as_col(reverse), complement(c)).otherwise(c)


def lifted_alts(alts: Column | str, reverse: Column | str) -> Column:
    alts = as_col(alts)
    return F.when(as_col(reverse), F.transform(alts, complement)).otherwise(alts)


def vcf_fields(
    ref_block: Column | str,
    ref: Column | str,
    alt: Column | str,
    gt: Column | str,
    genotype: Column | str,
    zygosity: Column | str,
) -> Column:
    """struct(ref, alt, gt) for a VCF line; null when the letters have no VCF form."""
    block, ref, alt = as_col(ref_block), as_col(ref), as_col(alt)
    gt, g, z = as_col(gt), F.coalesce(as_col(genotype), F.lit("")), as_col(zygosity)
    base = F.coalesce(ref, F.lit("N"))
    letters = chars(g)
    alts = F.array_except(letters, F.array(base))

    def index(x: Column) -> Column:
        return F.when(x == base, F.lit("0")).otherwise(F.array_position(alts, x).cast("string"))

    pair = F.concat(index(F.substring(g, 1, 1)), F.lit("/"), index(F.substring(g, 2, 1)))
    idx = (
        F.when(F.length(g) == 2, pair)
        .when(F.length(g) == 1, index(g))
        .otherwise(F.array_join(F.transform(letters, index), "/"))
    )

    def fields(r: Column, a: Column, t: Column) -> Column:
        return F.struct(r.alias("ref"), a.alias("alt"), t.alias("gt"))

    dot = F.lit(".")
    return (
        F.when(block, fields(base, F.lit("<*>"), F.coalesce(gt, F.lit("0/0"))))
        .when(
            ref.isNotNull() & gt.isNotNull(),
            fields(ref, F.when(F.size(alt) > 0, F.array_join(alt, ",")).otherwise(dot), gt),
        )
        .when(g.rlike("[^ACGT-]"), F.lit(None))
        .when(z == NO_CALL, fields(base, dot, F.when(F.length(g) == 1, dot).otherwise(F.lit("./."))))
        .otherwise(fields(base, F.when(F.size(alts) > 0, F.array_join(alts, ",")).otherwise(dot), idx))
    )


def genotype_row(kit="kit", build="build", call_source="call_source", lifted_from=None) -> list[Column]:
    """The 14 output columns of a genotype answer, from call columns in scope."""
    source = as_col(call_source)
    lift = F.lit(None).cast("struct<build:string,pos:bigint>") if lifted_from is None else as_col(lifted_from)
    genotype = F.when(source != "missing", blank_to_null("genotype"))
    return [
        as_col(kit).alias("kit"),
        F.col("rsid"),
        blank_to_null("chrom").alias("chrom"),
        F.nullif(F.col("pos"), F.lit(0).cast("bigint")).alias("pos"),
        as_col(build).alias("build"),
        F.col("ref"),
        F.coalesce(F.col("alt"), no_strings()).alias("alt"),
        genotype.alias("genotype"),
        F.coalesce(F.col("zygosity"), F.lit(NO_CALL)).alias("zygosity"),
        source.alias("call_source"),
        F.col("filter"),
        round_places("quality", 2).alias("quality"),
        F.col("depth"),
        lift.alias("lifted_from"),
    ]


