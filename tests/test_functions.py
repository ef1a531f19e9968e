"""Literal checks of the column helpers."""

from pyspark.sql import functions as F

from zygospark.functions import genotype as G
from zygospark.functions import naming as N
from zygospark.functions import policy as P
from zygospark.functions.common import parse_decimal, parse_u32, round_places


def evaluate(spark, rows, schema, *exprs):
    df = spark.createDataFrame(rows, schema)
    out = df.select(*[e.alias(f"o{i}") for i, e in enumerate(exprs)]).collect()
    return [r[0] if len(exprs) == 1 else tuple(r) for r in out]


def strings(spark, values, *exprs):
    return evaluate(spark, [(v,) for v in values], "s string", *exprs)


def test_u32_and_decimal(spark):
    assert strings(spark, ["5", "+5", "-5", " 5", "4294967295", "4294967296", "x", ""], parse_u32("s")) == [
        5, 5, None, None, 4294967295, None, None, None,
    ]
    assert strings(spark, ["1.5", ".5", "5.", "1d", "x", ""], parse_decimal("s")) == [1.5, 0.5, 5.0, None, None, None]
    assert evaluate(spark, [(0.12345,), (2.0,)], "x double", round_places("x", 4)) == [0.1235, 2.0]


def test_builds(spark):
    assert strings(spark, [" HG19 ", "b38", "37", "Unknown", "x"], N.parse_build("s")) == [
        "GRCh37", "GRCh38", "GRCh37", "unknown", None,
    ]
    assert strings(spark, ["GRCh37", "GRCh38", "unknown"], N.other_build("s")) == ["GRCh38", "GRCh37", "unknown"]
    texts = ["##reference=hs38DH.fa", "human_g1k_v37.fasta", "GCA_000001405.15", "GCA_000001405.1", "chm13"]
    assert strings(spark, texts, N.build_from_text("s")) == ["GRCh38", "GRCh37", "GRCh38", "GRCh37", None]
    assert evaluate(spark, [(249250621,), (248956422,), (5,)], "n long", N.build_from_chr1_length("n")) == [
        "GRCh37", "GRCh38", None,
    ]


def test_contig_names(spark):
    names = {
        "chr1": "1", "chrM": "MT", "23": "X", "25": "X", "26": "MT", "24": "Y", "XY": "X", " chrX ": "X",
        "NC_000019.10": "19", "NC_000023.11": "X", "NC_000024.1": "Y", "NC_012920.1": "MT", "NC_000099.1": "NC_000099.1",
        "chr1_KI270706v1_random": "1_KI270706v1_random", "hs37d5": "hs37d5", "HLA-A*01:01:01:01": "HLA-A*01:01:01:01",
        "NC_000001": "1",
    }
    assert strings(spark, list(names), N.normalize_chrom("s")) == list(names.values())
    assert strings(spark, ["1", "22", "X", "Y", "MT", "05", "0", "23", "EBV", "Un"], N.contig_ord("s")) == [
        1, 22, 23, 24, 25, 5, None, None, None, None,
    ]


def test_par(spark):
    rows = [("GRCh37", "X", 60001), ("GRCh37", "X", 60000), ("GRCh38", "X", 156030895), ("GRCh38", "X", 2781480),
            ("GRCh38", "7", 20000), ("unknown", "X", 70000)]
    assert evaluate(spark, rows, "b string, c string, p long", N.in_par("b", "c", "p")) == [
        True, False, True, False, False, False,
    ]


def test_array_zygosity(spark):
    rows = [("AG", None), ("AA", None), ("AA", "A"), ("GG", "A"), ("A", None), ("--", None), ("00", None),
            ("DI", None), ("", None), ("ACG", None), ("AA", "AT"), ("N", "A")]
    assert evaluate(spark, rows, "g string, r string", G.array_zygosity("g", "r")) == [
        "het", "hom", "hom_ref", "hom_alt", "hemi", "no_call", "no_call", "het", "no_call", "no_call", "hom", "no_call",
    ]


def test_genotype_letters(spark):
    base, other = "G", "A"
    rows = [
        # one alternative base
        ("0/0", base, other, "GG", "hom_ref"), ("0|1", base, other, "GA", "het"), ("1/0", base, other, "AG", "het"), ("1/1", base, other, "AA", "hom_alt"),
        # one copy, three copies, none
        ("0", base, other, "G", "hemi"), ("1/1/0", base, other, "AAG", "het"), ("1/1/1", base, "CC", "CC/CC/CC", "hom_alt"), ("", base, other, "-", "no_call"),
        # missing alleles
        ("./1", base, other, "--", "no_call"), (".|.", base, other, "--", "no_call"), (".", base, other, "-", "no_call"),
        # several, long, symbolic and unreadable alleles
        ("2/1", base, "A,C", "CA", "het"), ("1/0", "GTT", "G", "G/GTT", "het"), ("0/2", base, other, "GN", "het"), ("?/0", base, other, "NG", "het"),
        ("0/0", base, "<DEL>", "GG", "hom_ref"), ("1|1", base, "*", "NN", "hom_alt"), ("0/00", base, other, "GG", "het"), ("0/0", base, ".", "GG", "hom_ref"),
    ]
    got = evaluate(spark, rows, "gt string, r string, a string, l string, z string",
                   G.genotype_letters("gt", "r", "a"), G.vcf_zygosity("gt"))
    assert got == [(r[3], r[4]) for r in rows]


def test_alts_and_info(spark):
    assert strings(spark, [".", "G", "<NON_REF>", "G,<NON_REF>", "*", "A[1:5[", "G,T"],
                   G.only_symbolic("s"), G.stored_alts("s")) == [
        (True, []), (False, ["G"]), (True, []), (False, ["G"]), (True, ["*"]), (True, ["A[1:5["]), (False, ["G", "T"]),
    ]
    info = ["DP=5;END=9", "XEND=4", "END=1;END=2", ".", "END="]
    assert strings(spark, info, G.info_get("s", "END")) == ["9", None, "1", None, ""]
    rows = [("GT:DP", "0/1:7", "DP=9"), ("GT:MIN_DP", "0/1:3", "DP=9"), ("GT", "0/1", "DP=9"), ("GT:DP", "0/1:.", "DP=9"),
            ("GT:DP", "0/1", "DP=9")]
    depth = G.call_depth("f", "v", "i")
    assert evaluate(spark, rows, "f string, v string, i string", depth) == [7, 3, 9, None, 9]
    assert strings(spark, ["rs5", "x;rs7;rs8", ".", "i3;RS2"], G.pick_rsid("s")) == ["rs5", "rs7", None, None]
    assert strings(spark, ["rs12", "RS7", "rs0", "i3", "rs4294967296"], G.rs_number("s")) == [12, 7, 0, None, None]


def test_keys(spark):
    assert strings(spark, ["CT", "A", "--", "AT/A", "", "A/", "DI"], G.allele_key("s")) == [
        ["C", "T"], ["A", "A"], None, ["A", "AT"], None, None, ["D", "I"],
    ]
    assert strings(spark, ["TC", "A", "DI", "AT/A", "CBA", "GCA"], G.snv_key("s", F.lit("het"))) == [
        "CT", "AA", None, None, None, "ACG",
    ]
    assert strings(spark, ["ACgtN-"], G.complement("s")) == ["TGcaN-"]


def test_loci_and_regions(spark):
    assert strings(spark, ["chr19:44,908,684", "19", "1:0", ":5", "HLA:A:7"], N.parse_locus("s")) == [
        ("19", 44908684), None, None, None, ("HLA:A", 7),
    ]
    regions = ["chr19:44.9M-45.0M", "X", "1:1k-2k", "1:5-3", "1:77", ":5-6", "1:0-9", "1:x-9", "1:"]
    assert strings(spark, regions, N.parse_region("s")) == [
        ("19", 44900000, 45000000), ("X", 1, 4294967295), ("1", 1000, 2000), None, ("1", 77, 77), None, ("1", 1, 9),
        None, None,
    ]


def test_vcf_fields(spark):
    rows = [
        (False, "T", ["C"], "0/1", "TC", "het"), (False, "T", [], "0/0", "TT", "hom_ref"),
        (True, "T", [], None, "TT", "hom_ref"), (True, None, [], "0/0", "", "hom_ref"),
        (False, None, [], None, "AG", "het"), (False, "G", ["A"], None, "AG", "het"), (False, None, [], None, "II", "hom"),
        (False, None, [], None, "--", "no_call"), (False, "A", [], None, "-", "no_call"), (False, "C", [], None, "T", "hemi"),
        (False, "T", ["C"], None, "TC", "het"),
    ]
    got = evaluate(spark, rows, "b boolean, r string, a array<string>, t string, g string, z string",
                   G.vcf_fields("b", "r", "a", "t", "g", "z"))
    assert got == [
        ("T", "C", "0/1"), ("T", ".", "0/0"), ("T", "<*>", "0/0"), ("N", "<*>", "0/0"), ("N", "A,G", "1/2"),
        ("G", "A", "1/0"), None, ("N", ".", "./."), ("A", ".", "."), ("C", "T", "1"), ("T", "C", "0/1"),
    ]


def test_names(spark):
    names = ["/x/genome_Jane_v5_Full.txt", "sample.hard-filtered.vcf.gz", "s.g.vcf.gz", "a.csv"]
    assert strings(spark, names, N.default_kit_name("s")) == ["genome_Jane_v5_Full", "sample.hard-filtered", "s", "a"]
    lanes = ["NA_S1_L002_R1_001.fastq.gz", "x_1.fq.gz", "x_R1.fastq", "plain.fastq"]
    assert strings(spark, lanes, N.mate_name("s"), N.lane_of("s")) == [
        ("NA_S1_L002_R2_001.fastq.gz", ("NA", "L002")), ("x_2.fq.gz", ("x", None)), ("x_R2.fastq", ("x", None)),
        (None, ("plain.fastq", None)),
    ]
    rows = [("GRCh38", "MT"), ("GRCh38", "5"), ("GRCh38", "EBV"), ("GRCh37", "5")]
    assert evaluate(spark, rows, "b string, c string", N.vcf_contig("b", "c")) == ["chrM", "chr5", "EBV", "5"]


def test_policies(spark):
    rows = [("array", "23andme", False), ("wgs", "gvcf", True), ("wgs", "vcf", True), ("wgs", "vcf", False), ("wes", "vcf", False)]
    assert evaluate(spark, rows, "a string, f string, d boolean", P.ref_calls_policy("a", "f", "d")) == [
        "explicit", "explicit", "unknown", "absent-means-ref", "unknown",
    ]
    rows = [("GRCh37", "header", None), ("GRCh37", "header", "hg38"), ("unknown", "assumed", "38"), ("GRCh37", "header", "37")]
    got = evaluate(spark, rows, "d string, e string, o string", P.build_policy("d", "e", "o"))
    assert [(g.build, g.evidence, g.warning is not None) for g in got] == [
        ("GRCh37", "header", False), ("GRCh38", "assumed", True), ("GRCh38", "assumed", False), ("GRCh37", "header", False),
    ]
    assert evaluate(spark, [(4, 2), (0, 0), (5, 2)], "r long, n long", P.has_rsids("r", "n")) == [True, False, False]
