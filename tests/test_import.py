"""Import job, catalog, lookups, comparison and export on small literal files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from zygospark.operators import audit, catalog, compare, export, lookup, summary
from zygospark.session import small_table
from zygospark.sinks import export as sink
from zygospark.sinks import store
from zygospark.sinks.audit_log import audited_compare, audited_lookup, read_audit
from zygospark.sources import chain, fasta, rsid_tables
from zygospark.sources.importer import Options, import_files, parse_files, remove_kit, stored_summaries
from zygospark.sources.text import read_lines

VCF_HEAD = (
    "##fileformat=VCFv4.2\n##contig=<ID=chr1,length=248956422>\n"
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
)
CHAIN = (
    "chain 4200 chr5 90000 + 2000 2330 chr5 91000 + 700 1020 11\n120 40 0\n80 0 30\n90\n\n"
    "chain 77 chr8 40000 + 15000 15060 chr12 9000 - 2500 2560 12\n60\n"
)
X_SITES, Y_SITES = 64, 25  # of the array; one X site is het, each fifth Y site is not called


def male_array():
    """Array rows of a male: chosen sites of chromosomes 1, 6, 10 and 19, one PAR site, X, Y and MT."""
    rng = random.Random(2024)
    known = {"rs7412": ("19", 45412079, "CT"), "rs1801131": ("1", 11854476, "GG"), "rs1800562": ("6", 26093141, "GG"), "rs4244285": ("10", 96541616, "GA")}
    rows = [(rsid, *place) for rsid, place in known.items()]
    rows += [("i700", "6", 4_100_000, "DI"), ("rs8801", "12", 55_000, "--"), ("rs8802", "X", 155_000_000, "CA")]
    for n, pos in enumerate(sorted(rng.sample(range(5_000_000, 80_000_000), X_SITES))):
        rows.append((f"rs77{n:03d}", "X", pos, "TC" if n == 20 else rng.choice("ACGT")))
    for n, pos in enumerate(sorted(rng.sample(range(7_000_000, 20_000_000), Y_SITES))):
        rows.append((f"rs99{n:03d}", "Y", pos, "--" if n % 5 == 4 else rng.choice("ACGT")))
    rows.append(("i701", "MT", 7028, "T"))
    head = "# This data file generated by 23andMe\n# human assembly build 37\n# rsid\tchromosome\tposition\tgenotype\n"
    return head + "".join("\t".join(map(str, r)) + "\n" for r in rows)


ARRAY_ROWS = 4 + 3 + X_SITES + Y_SITES + 1


def wgs_vcf():
    body = [
        "chr19\t44908822\t.\tC\tT\t71.5\tPASS\tDP=44\tGT:DP\t1/0:41\t0/0:6",
        "chr1\t11794419\t.\tT\tG\t12\tPASS\t.\tGT\t0/1\t0/0",
        "chr10\t94781859\t.\tG\tA\t.\t.\t.\tGT:DP\t1|0:.\t1/1:2",
        "scaffold7\t12\tss4;rs31\tC\tA,G\t1e7\tq20\t.\tGT\t2/1\t./.",
        "decoy\t12\t.\tC\tA\t8\tPASS\t.\tGT\t1/1\t./.",
        "chrY\t?\t.\tT\tG\t8\tPASS\t.\tGT\t1\t1",
        "chr4\t9\t.\tG",
    ]
    return VCF_HEAD + "\n".join(body) + "\n"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("world")
    (base / "male.txt").write_text(male_array())
    with gzip.open(base / "wgs.vcf.gz", "wt") as f:  # two gzip members
        f.write(wgs_vcf()[:200])
    with gzip.open(base / "wgs.vcf.gz", "at") as f:
        f.write(wgs_vcf()[200:])
    (base / "blocks.g.vcf").write_text(
        "##fileformat=VCFv4.2\n##reference=GRCh38\n##GVCFBlock=x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tG\n"
        "chr6\t26090000\t.\tT\t<NON_REF>\t.\t.\tEND=26092900\tGT:DP:MIN_DP\t0/0:37:35\n"
        "chr6\t26092913\t.\tG\tA,<NON_REF>\t48\tPASS\t.\tGT:DP\t1/0:33\n"
    )
    root = str(base / "store")
    kits = import_files(spark, root, [str(base / n) for n in ("male.txt", "wgs.vcf.gz", "blocks.g.vcf")])
    ids = {r.name: r.id for r in kits.collect()}
    return base, root, ids


def tables(spark, root):
    return store.read_calls(spark, f"{root}/calls"), store.read_kits(spark, f"{root}/kits")


def test_kit_rows(spark, world):
    _, root, ids = world
    k = {r.name: r for r in store.read_kits(spark, f"{root}/kits").collect()}
    assert sorted(ids) == ["blocks", "male", "wgs"] and sorted(ids.values()) == ["k1", "k2", "k3"]
    m, w, g = k["male"], k["wgs"], k["blocks"]
    assert (m.source_format, m.assay, m.build, m.build_evidence, m.ref_calls, m.has_rsids, m.chip, m.sample) == (
        "23andme", "array", "GRCh37", "header", "explicit", True, "unknown", "male")
    assert (w.source_format, w.assay, w.build, w.build_evidence, w.ref_calls, w.has_rsids, w.chip, w.sample) == (
        "vcf", "wgs", "GRCh38", "contig-lengths", "absent-means-ref", False, None, "S1")
    assert (g.source_format, g.build_evidence, g.ref_calls) == ("gvcf", "header", "explicit")
    assert (m.records, w.records, w.rsid_records, g.records) == (ARRAY_ROWS, 5, 1, 2)
    assert any("malformed" in x and "2" in x for x in w.warnings) and any("multi-sample" in x for x in w.warnings)


def test_stored_calls(spark, world):
    _, root, ids = world
    calls = store.read_calls(spark, f"{root}/calls", [ids["wgs"]]).orderBy("contig_ord").collect()
    assert [(c.chrom, c.contig_ord) for c in calls] == [
        ("1", 1), ("10", 10), ("19", 19), ("scaffold7", 26), ("decoy", 27)]
    apoe = calls[2]
    assert (apoe.pos, apoe.end, apoe.genotype, apoe.zygosity, apoe.quality, apoe.depth, apoe.alt) == (
        44908822, 44908822, "TC", "het", 71.5, 41, ["T"])
    assert calls[1].filter is None and calls[1].quality is None and calls[1].depth is None
    assert (calls[3].rsid, calls[3].rs_num, calls[3].genotype, calls[3].alt) == ("rs31", 31, "GA", ["A", "G"])


def test_second_sample_and_errors(spark, world, tmp_path):
    base, root, _ = world
    rows, info, _ = parse_files(spark, [str(base / "wgs.vcf.gz")], Options(sample="S2"))
    got = {r.chrom: r.gt for r in rows.filter("problem is null").collect()}
    assert got["10"] == "1/1" and got["19"] == "0/0" and info.first().sample == "S2"
    with pytest.raises(ValueError, match="not in VCF"):
        parse_files(spark, [str(base / "wgs.vcf.gz")], Options(sample="S3"))
    with pytest.raises(ValueError, match="already exists"):
        import_files(spark, root, [str(base / "male.txt")])
    bad = tmp_path / "bad.txt"
    bad.write_text("hello\nworld\n")
    with pytest.raises(ValueError, match="cannot detect"):
        import_files(spark, root, [str(bad)])
    with pytest.raises(ValueError, match="no genotype rows"):
        import_files(spark, root, [str(bad)], Options(fmt="ftdna"))
    zipped = tmp_path / "a.txt"
    zipped.write_bytes(b"PK\x03\x04zzz\n")
    with pytest.raises(ValueError, match="zip"):
        import_files(spark, root, [str(zipped)])
    sites_only = tmp_path / "s.vcf"
    sites_only.write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n9\t44\t.\tC\tT\t.\t.\t.\n")
    with pytest.raises(ValueError, match="no sample columns"):
        import_files(spark, root, [str(sites_only)])
    assert store.read_kits(spark, f"{root}/kits").count() == 3


def test_other_array_formats(spark, tmp_path):
    files = {
        "ancestry.txt": "#AncestryDNA raw data download\n#build 37.1\nrsid\tchromosome\tposition\tallele1\tallele2\nrs1\t23\t100\tA\tG\nrs2\t25\t200\t0\t0\nrs3\t26\t5\tT\tT\n",
        "ftdna.csv": 'RSID,CHROMOSOME,POSITION,RESULT\n"rs1","1","100","CT"\n"rsid","1","x","CT"\n"rs2","1","101","c c"\n',
        "myheritage.csv": '# MyHeritage\n# build 36\nRSID,CHROMOSOME,POSITION,RESULT\n"rs1","1","100",""\n',
    }
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    rows, info, formats = parse_files(spark, [str(tmp_path / n) for n in files])
    facts = {r.source_format: (r.build, r.evidence) for r in info.collect()}
    assert facts == {"ancestry": ("GRCh37", "header"), "ftdna": ("GRCh37", "assumed"), "myheritage": ("unknown", "header")}
    got = sorted((r.rsid, r.chrom, r.pos, r.genotype, r.zygosity, r.problem) for r in rows.collect() if r.file.endswith("ancestry.txt"))
    assert got == [("rs1", "X", 100, "AG", "het", None), ("rs2", "X", 200, "--", "no_call", None), ("rs3", "MT", 5, "TT", "hom", None)]
    ft = {r.rsid: (r.genotype, r.problem) for r in rows.collect() if r.file.endswith("ftdna.csv")}
    assert ft == {"rs1": ("CT", None), "rs2": ("CC", None), "rsid": ("CT", "position")}


def test_summary(spark, world):
    _, root, ids = world
    s = {r.kit: r for r in summary.summarize(*tables(spark, root)).collect()}
    m = s[ids["male"]]
    no_calls = 1 + Y_SITES // 5
    assert (m.records, m.no_calls, m.het, m.hom_unknown_ref) == (ARRAY_ROWS, no_calls, 5, 2)
    assert m.hemizygous == X_SITES - 1 + Y_SITES - Y_SITES // 5 + 1
    assert m.records == m.no_calls + m.het + m.hom_alt + m.hom_ref + m.hom_unknown_ref + m.hemizygous
    assert (m.sex.call, m.sex.x_het_rate, m.sex.y_call_rate) == ("male", round(1 / X_SITES, 4), 0.8)
    assert (m.by_chrom["Y"], m.by_chrom["MT"], m.by_chrom["other_contigs"], m.by_chrom["22"]) == (Y_SITES, 1, 0, 0)
    kept = {r.kit: r for r in stored_summaries(spark, root).collect()}
    assert {k: r.asDict(True) for k, r in kept.items()} == {k: r.asDict(True) for k, r in s.items()}
    w = s[ids["wgs"]]
    assert w.by_chrom["other_contigs"] == 2 and w.sex.call == "uncertain" and any("only variants" in c for c in w.caveats)


def test_lookups(spark, world):
    _, root, ids = world
    calls, kits = tables(spark, root)
    m, w, g = ids["male"], ids["wgs"], ids["blocks"]
    asked = [
        ("own id", m, "rs7412", None, None, None), ("own id, reference", m, "rs1800562", None, None, None), ("own text id", m, "i700", None, None, None),
        ("no such id", m, "rs123123123", None, None, None), ("id by place", w, "rs7412", None, None, None), ("id, not listed", w, "rs6025", None, None, None),
        ("place", w, None, "10", 94781859, None), ("in a block", g, None, "6", 26091234, None), ("past the blocks", g, None, "6", 31000000, None),
        ("other contig", w, None, "scaffold7", 13, None), ("lifted", w, None, "19", 45412079, "GRCh37"), ("not lifted", w, None, "7", 41, "GRCh37"),
    ]
    q = small_table(spark, asked, "qid string, kit string, rsid string, chrom string, pos bigint, build string")
    blocks = small_table(
        spark, [("GRCh37", "GRCh38", 1, "19", 45412000, 45412500, "19", 44908743, 59000000, False, 1.0)],
        "from_build string, to_build string, blk bigint, t_chrom string, t_start bigint, t_end bigint, q_chrom string, q_start bigint, q_size bigint, q_neg boolean, score double",
    )
    r = {x.qid: x for x in lookup.lookup(calls, kits, q, None, blocks).collect()}
    before = read_audit(spark, root).count()
    audited_lookup(spark, root, lookup.lookup(calls, kits, q, None, blocks))
    note = read_audit(spark, root).orderBy(F.col("seq").desc()).first()
    assert note.seq == before + 1 and json.loads(note.details) == {"answers": 12, "inferred": 1, "missing": 4, "observed": 7}
    own = r["own id"]
    assert (own.pos, own.genotype, own.zygosity, own.ref, own.alt) == (45412079, "CT", "het", "C", ["T"])
    assert r["own id, reference"].zygosity == "hom_ref" and (r["own text id"].genotype, r["own text id"].zygosity) == ("DI", "het")
    assert r["no such id"].call_source == "missing" and r["no such id"].warnings and r["no such id"].chrom is None
    near = r["id by place"]
    assert (near.pos, near.genotype, near.rsid, near.quality, near.depth, near.filter) == (44908822, "TC", "rs7412", 71.5, 41, "PASS")
    implied = r["id, not listed"]
    assert (implied.pos, implied.genotype, implied.call_source, implied.zygosity) == (169549811, "CC", "inferred_ref", "hom_ref")
    assert r["place"].rsid == "rs4244285"
    block = r["in a block"]
    assert (block.zygosity, block.call_source, block.depth, block.genotype) == ("hom_ref", "observed", 37, None)
    assert r["past the blocks"].call_source == "missing" and r["other contig"].call_source == "missing"
    lifted = r["lifted"]
    assert (lifted.pos, lifted.build, lifted.lifted_from.build, lifted.lifted_from.pos) == (44908822, "GRCh38", "GRCh37", 45412079)
    assert (r["not lifted"].call_source, r["not lifted"].build, r["not lifted"].pos) == ("missing", "GRCh37", 41)
    with pytest.raises(ValueError, match="need chain blocks"):
        lookup.lookup(calls, kits, q, None, None)


def test_far_block(spark):
    """A block that starts many records earlier still answers; the look-back limit is for those who ask for it."""
    def row(o, pos, end, block):
        return ("k", o, "2", 2, pos, end, None, None, "A", [] if block else ["C"], None if block else "AC", None, "hom_ref" if block else "het", None, None, 9, block)

    calls = small_table(spark, [row(0, 100, 9000, True)] + [row(i, 100 + i, 100 + i, False) for i in range(1, 91)], store.CALLS)
    kits = small_table(spark, [("k", "GRCh38", "explicit", False, 0, "wgs")],
                       "id string, build string, ref_calls string, has_rsids boolean, rsid_records bigint, assay string")
    q = small_table(spark, [("far", "k", "2", 5000, None)], "qid string, kit string, chrom string, pos bigint, build string")
    found = lookup.lookup_positions(calls, kits, q).first()
    assert (found.call_source, found.zygosity) == ("observed", "hom_ref")
    assert lookup.lookup_positions(calls, kits, q, max_lookback=lookup.LOOK_BACK).first().call_source == "missing"
    assert lookup.lookup_positions(calls, kits, q, max_lookback=91).first().call_source == "observed"


def test_compare(spark, world):
    _, root, ids = world
    calls, kits = tables(spark, root)
    rows = [("19", 45412079, 44908822), ("1", 11854476, 11794419), ("6", 26093141, 26092913), ("10", 96541616, 94781859)]  # GRCh37 to GRCh38
    blocks = small_table(
        spark, [("GRCh37", "GRCh38", i, c, a - 1, a, c, b - 1, 10**9, False, 1.0) for i, (c, a, b) in enumerate(rows)],
        "from_build string, to_build string, blk bigint, t_chrom string, t_start bigint, t_end bigint, q_chrom string, q_start bigint, q_size bigint, q_neg boolean, score double",
    )
    pairs = small_table(spark, [(ids["wgs"], ids["male"]), (ids["male"], ids["male"])], "a string, b string")
    tallies, listed = compare.compare(calls, kits, pairs, blocks, max_discordant=1)
    t = {r.a: r for r in tallies.collect()}
    w = t[ids["wgs"]]
    # rs7412 and rs4244285 agree, rs1801131 is TG against GG, rs1800562 is not in the VCF and GG in the array.
    assert (w.overlap, w.concordant, w.discordant, w.inferred_ref_sites, w.lifted, w.build) == (4, 3, 1, 1, True, "GRCh38")
    assert w.unlifted_sites == ARRAY_ROWS - (1 + Y_SITES // 5) - len(rows)
    assert t[ids["male"]].discordant == 0 and t[ids["male"]].skipped_sites == 1  # DI is not comparable
    audited_compare(spark, root, tallies)
    assert json.loads(read_audit(spark, root).orderBy(F.col("seq").desc()).first().details)["pairs"] == 2
    assert listed.count() == 1
    full = compare.discordant_sites(calls, kits, pairs, blocks).collect()
    assert {(r.chrom, r.pos, r.source_a) for r in full} == {("1", 11794419, "observed")}
    for none in (None, blocks.withColumn("to_build", F.lit("GRCh37"))):
        with pytest.raises(ValueError, match="needs chain blocks"):
            compare.compare_tallies(calls, kits, pairs, none)
    bad = kits.withColumn("build", F.when(F.col("id") == ids["male"], "unknown").otherwise(F.col("build")))
    with pytest.raises(ValueError, match="unknown build"):
        compare.compare_tallies(calls, bad, pairs, blocks)


def test_compare_duplicates(spark):
    """First A record uses up B's site; later ones count as unmatched; the last B record wins."""
    def call(kit, o, pos, g, z="het", ref="A"):
        return (kit, o, "1", 1, pos, pos, None, None, ref, ["G"], g, None, z, None, None, None, False)

    calls = small_table(
        spark,
        [call("a", 1, 10, "AG"), call("a", 2, 10, "GG", "hom_alt"), call("a", 3, 10, "GG", "hom_alt"), call("a", 4, 20, "AA", "hom_ref"),
         call("b", 1, 10, "TT"), call("b", 2, 10, "AG"), call("b", 3, 30, "AG")],
        store.CALLS,
    )
    kits = small_table(spark, [("a", "GRCh38", "wgs", "absent-means-ref"), ("b", "GRCh38", "wgs", "absent-means-ref")],
                       "id string, build string, assay string, ref_calls string")
    pairs = small_table(spark, [("a", "b")], "a string, b string")
    t = compare.compare_tallies(calls, kits, pairs).first()
    # 10: AG = AG; two GG against AA; 20: AA = inferred AA; 30: inferred AA against AG.
    assert (t.overlap, t.concordant, t.discordant, t.inferred_ref_sites, t.skipped_sites) == (5, 2, 3, 4, 0)
    listed = compare.discordant_sites(calls, kits, pairs).orderBy("n").collect()
    assert [(r.pos, r.call_a.genotype, r.call_b.genotype) for r in listed] == [(10, "GG", "AA"), (10, "GG", "AA"), (30, "AA", "AG")]


def test_export(spark, world, tmp_path):
    _, root, ids = world
    calls = store.read_calls(spark, f"{root}/calls", [ids["wgs"]])
    sink.write_vcf(calls, str(tmp_path / "vcf"), "GRCh38", ids["wgs"], "vcf", "S1")
    text = "".join(p.read_text() for p in sorted((tmp_path / "vcf").glob("part-*"))).splitlines()
    assert text[0] == "##fileformat=VCFv4.2" and [x for x in text if x.startswith("##contig")][0] == "##contig=<ID=chr1>"
    assert [x for x in text if not x.startswith("#")][2:4] == [
        "chr19\t44908822\t.\tC\tT\t71.5\tPASS\t.\tGT:DP\t1/0:41", "scaffold7\t12\trs31\tC\tA,G\t10000000\tq20\t.\tGT:DP\t2/1:."]
    male = store.read_calls(spark, f"{root}/calls", [ids["male"]])
    rows = male.orderBy("contig_ord", "pos").collect()
    page = export.export_calls(male, None, 1, 2).collect()
    assert [r.pos for r in page] == [r.pos for r in rows[1:3]]
    assert export.export_calls(male, None, len(rows), 5).count() == 0
    deep = export.export_calls(male, None, 3, None).collect()
    assert [(r.chrom, r.pos) for r in deep] == [(r.chrom, r.pos) for r in rows[3:]]
    regions = small_table(spark, [(0, "6", 1, 10**9), (1, "6", 20_000_000, 10**9)], "region_no int, chrom string, start bigint, end bigint")
    assert [r.pos for r in export.export_calls(male, regions).collect()] == [4_100_000, 26093141, 26093141]
    out = export.genotype_rows(male, "GRCh37")
    sink.write_rows(out, str(tmp_path / "tsv"), "tsv", columns=["rsid", "pos", "alt", "lifted_from"], null="NA")
    lines = (next((tmp_path / "tsv").glob("part-*"))).read_text().splitlines()
    assert lines[0] == "rsid\tpos\talt\tlifted_from" and lines[1].endswith("\t\tNA")
    sink.write_rows(out.limit(2), str(tmp_path / "json"), "json")
    body = json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))))
    assert (body["kind"], body["count"], len(body["data"]), body["warnings"]) == ("genotypes", 2, 2, [])
    sink.write_document(out.limit(0), str(tmp_path / "none"), "genotypes", ["none"])
    none = json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))
    assert (none["count"], none["data"], none["warnings"]) == (0, [], ["none"])


def test_replace_remove_and_find(spark, world, tmp_path):
    base, _, _ = world
    root = str(tmp_path / "store")
    import_files(spark, root, [str(base / "male.txt")])
    again = import_files(spark, root, [str(base / "male.txt")], replace=True).first()
    assert again.id == "k2" and store.read_kits(spark, f"{root}/kits").count() == 1
    kits = store.read_kits(spark, f"{root}/kits")
    assert catalog.find_kits(kits, small_table(spark, [("male",), ("k2",)], "key string")).count() == 2
    assert catalog.rename_kit(kits, "k2", "x").first().name == "x"
    with pytest.raises(KeyError):
        remove_kit(spark, root, "nobody")
    remove_kit(spark, root, "male")
    assert store.read_kits(spark, f"{root}/kits").count() == 0
    log = read_audit(spark, root)
    assert [(r.seq, r.command) for r in log.orderBy("seq").collect()] == [(1, "import"), (2, "import"), (3, "rm")]
    assert '"replaced": ["k1"]' in log.filter("seq = 2").first().details and audit.verify_chain(log).count() == 0
    assert not list((tmp_path / "store" / "calls").glob("kit=*"))


def test_chain_text(spark, tmp_path):
    from zygospark.operators.liftover import lift_best

    (tmp_path / "a.chain").write_text(CHAIN)
    blocks = chain.read_chain(spark, str(tmp_path / "a.chain"), "GRCh37", "GRCh38")
    points = [("5", 2001), ("5", 2120), ("5", 2130), ("5", 2161), ("5", 2240), ("5", 2241), ("5", 2331), ("8", 15001), ("8", 15060), ("9", 4)]
    got = lift_best(small_table(spark, points, "chrom string, pos bigint"), blocks, "GRCh37", "GRCh38").collect()
    nowhere = (None, None, None)
    assert {(r.chrom, r.pos): (r.lifted_chrom, r.lifted_pos, r.reverse) for r in got} == {
        ("5", 2001): ("5", 701, False), ("5", 2120): ("5", 820, False), ("5", 2130): nowhere,  # in the gap of 40
        ("5", 2161): ("5", 821, False), ("5", 2240): ("5", 900, False), ("5", 2241): ("5", 931, False),  # past the target's gap of 30
        ("5", 2331): nowhere, ("8", 15001): ("12", 6500, True), ("8", 15060): ("12", 6441, True), ("9", 4): nowhere,
    }
    headless, short = "33 4 4\n12\n", "chain 12 chr5 90000\n60\n"
    for text in (headless, short, CHAIN.replace("90000 +", "90000 -"), CHAIN.replace("120 40 0", "many 40 0"), CHAIN + "15\n"):
        (tmp_path / "b.chain").write_text(text)
        with pytest.raises(ValueError, match="malformed"):
            chain.read_chain(spark, str(tmp_path / "b.chain"), "GRCh37", "GRCh38")


def test_dbsnp_text(spark, tmp_path):
    rows = ["NC_000003.12 4411 rs771 G C", "NC_000003.12 4500 rs64 T C,A", "NC_000011.10 812 rs905 CAG C", "NW_003315905.1 77 rs3 T G"]
    head = "##fileformat=VCFv4.2\n##reference=GRCh38.p14\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    (tmp_path / "db.vcf").write_text(head + "".join("\t".join([*r.split(), ".", ".", "."]) + "\n" for r in rows))
    coords = rsid_tables.read_dbsnp(spark, str(tmp_path / "db.vcf"))
    got = {r.rsid: (r.build, r.chrom, r.pos, r.ref, r.alt) for r in coords.collect()}
    assert got == {
        "rs771": ("GRCh38", "3", 4411, "G", ["C"]), "rs64": ("GRCh38", "3", 4500, "T", ["A", "C"]), "rs905": ("GRCh38", "11", 812, None, ["C"]),
    }
    counts = rsid_tables.dbsnp_counts(read_lines(spark, str(tmp_path / "db.vcf"))).first()
    assert (counts.kept, counts.skipped) == (3, 1)
    store.write_rsid_coords(coords, str(tmp_path / "coords"))
    assert store.read_rsid_coords(spark, str(tmp_path / "coords"), "by_pos").count() == 3
    assert rsid_tables.curated_rsids(spark, ["rs7412", "rs6025"]).count() == 2


def test_fasta_text(spark, tmp_path):
    from zygospark.operators.rsids import reference_bases

    random.seed(5)
    long = "".join(random.choice("ACGTacgt") for _ in range(5000))
    lines = [long[i : i + 61] for i in range(0, len(long), 61)]
    (tmp_path / "r.fa").write_text(">chr4 made up\nTTGACCA\nggtnaca\nTC\n>chr2\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many splits of one file
    try:
        chunks = fasta.read_fasta(spark, str(tmp_path / "r.fa"), "GRCh38", 100)
        seqs = {(r.chrom, r.chunk): r.seq for r in chunks.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert seqs[("4", 0)] == "TTGACCAGGTNACATC"
    assert "".join(seqs[("2", i)] for i in range(50)) == long.upper()
    points = small_table(spark, [("4", 2), ("4", 16), ("4", 17), ("2", 4321), ("3", 1)], "chrom string, pos bigint").withColumn("build", F.lit("GRCh38"))
    base = {(r.chrom, r.pos): r.base for r in reference_bases(points, chunks, chunk=100).collect()}
    assert base == {("4", 2): "T", ("4", 16): "C", ("4", 17): None, ("2", 4321): long[4320].upper(), ("3", 1): None}


def test_fastq_files(spark, tmp_path):
    from zygospark.sources.fastq import read_fastq_pairs

    for side in (1, 2):
        with gzip.open(tmp_path / f"S_L001_R{side}_001.fastq.gz", "wt") as f:
            f.writelines(f"@r{i}/{side}\nACGT{side}\n+\nIIIII\n" for i in range(50))
        (tmp_path / f"x_{side}.fq").write_text("".join(f"@x{i}/{side}\nAC\n+\nII\n" for i in range(7)))
    files = [str(p) for p in tmp_path.iterdir()]
    got = read_fastq_pairs(spark, files).collect()
    assert len(got) == 57 and all(r.r1_name[:-1] == r.r2_name[:-1] for r in got)
    assert {(r.sample, r.lane) for r in got} == {("S", "L001"), ("x", "L002")}
    assert read_fastq_pairs(spark, files, 5).count() == 10
    with pytest.raises(ValueError, match="R2"):
        read_fastq_pairs(spark, files[:1])


def test_fastq_lost_mates(spark, tmp_path):
    """Reads without a mate come back alone, with a problem."""
    from zygospark.sources.fastq import read_fastq_pairs

    for side, n in ((1, 9), (2, 6)):
        (tmp_path / f"q_{side}.fq").write_text("".join(f"@q{i}/{side}\nGATT\n+\nFFFF\n" for i in range(n)))
    got = read_fastq_pairs(spark, [str(tmp_path / f"q_{k}.fq") for k in (1, 2)]).collect()
    assert sorted((r.pair, r.r2_name is None, r.problem) for r in got) == [(i, i > 5, "no R2 read" if i > 5 else None) for i in range(9)]


def test_import_rules(spark, world, tmp_path):
    """VCF noise and empty VCF files are imported; names of one batch differ; unknown builds are refused."""
    root = str(tmp_path / "store")
    (tmp_path / "noisy.vcf").write_text(VCF_HEAD + "chr3\t1\t.\n" * 1200 + "chr3\t60\t.\tA\tT\t9\tPASS\t.\tGT\t0/1\t0/0\n")
    (tmp_path / "none.vcf").write_text(VCF_HEAD)
    kits = {r.name: r for r in import_files(spark, root, [str(tmp_path / n) for n in ("noisy.vcf", "none.vcf")]).collect()}
    assert (kits["noisy"].records, kits["none"].records, kits["none"].has_rsids) == (1, 0, False)
    assert any("1200" in w for w in kits["noisy"].warnings)
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "twin.vcf").write_text(VCF_HEAD + "chr3\t60\t.\tA\tT\t9\tPASS\t.\tGT\t0/1\t0/0\n")
    twins = [str(tmp_path / d / "twin.vcf") for d in ("a", "b")]
    with pytest.raises(ValueError, match="named 'twin'"):
        import_files(spark, root, twins)
    both = import_files(spark, root, twins, Options(names={f"file:{twins[0]}": "left", "win.vcf": "wrong", twins[0]: "left"}))
    assert sorted(r.name for r in both.collect()) == ["left", "twin"]
    with pytest.raises(ValueError, match="unknown genome build"):
        import_files(spark, root, twins, Options(build="hg99"))


def test_audit(spark):
    rows = [(i, f"t{i}", "lookup", None if i % 2 else "u", f'{{"rows": {i}}}') for i in range(1, 21)]
    log = audit.link_entries(small_table(spark, rows, "seq bigint, ts string, command string, user string, details string"))
    assert audit.verify_audit(log).count() == 0
    edited = log.withColumn("details", F.when(F.col("seq") == 7, "x").otherwise(F.col("details")))
    assert {r.seq for r in audit.verify_audit(edited).collect()} == {7, 8}
    assert {r.seq for r in audit.verify_audit(log.filter("seq <> 5")).collect()} == {6}
    assert [r.seq for r in audit.tail_audit(log, 3).collect()] == [18, 19, 20]
    more = audit.next_entries(log, [("t21", "import", None, "{}"), ("t22", "rm", "u", "{}")])
    assert [r.seq for r in more.orderBy("seq").collect()] == [21, 22]
    assert audit.verify_audit(log.unionByName(more)).count() == 0
    first = audit.next_entries(log.limit(0), [("t1", "kits", None, "{}")])
    assert audit.verify_audit(first).count() == 0 and first.first().seq == 1


def test_folder_ingest(spark, world, tmp_path):
    from zygospark.streaming.ingest import ingest_folder

    base, _, _ = world
    landing = tmp_path / "in"
    landing.mkdir()
    for n in ("male.txt", "blocks.g.vcf"):
        (landing / n).write_text((base / n).read_text())
    q = ingest_folder(spark, str(landing), str(tmp_path / "store"), str(tmp_path / "ck"))
    assert q.awaitTermination(180) and q.exception() is None
    assert {r.name for r in store.read_kits(spark, str(tmp_path / "store" / "kits")).collect()} == {"male", "blocks"}
