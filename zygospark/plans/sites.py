"""Liftover, rsid resolution, reference bases and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from zygospark.functions.common import int_div
from zygospark.operators import enrich, liftover, rsids
from zygospark.plans import derived as D
from zygospark.plans import oracle_views as V
from zygospark.plans.registry import query
from zygospark.schema import GRCH37, GRCH38
from zygospark.sources import chain, rsid_tables
from zygospark.sources.rsid_tables import CURATED_IDS, CURATED_SNPS

CURATED_VALUES = ", ".join(
    f"('{b}', '{r[0]}', {int(r[0][2:])}, '{r[2]}', {r[2]}, {p}, '{ref}', '{alt}')"
    for r in CURATED_SNPS
    for b, p, ref, alt in ((GRCH37, r[3], r[4], r[5]), (GRCH38, r[6], r[7], r[8]))
)
CURATED = f"""
g_curated AS (SELECT * FROM (VALUES {CURATED_VALUES}) AS v(build, rsid, rs_num, chrom, contig_ord, pos, ref, alt))"""


def _points(spark, sf):
    return D.calls(spark, sf).select("kit", "src_ord", "chrom", "pos")


POINTS = "points AS (SELECT kit || ':' || src_ord || ':' || chrom || ':' || pos AS pid, kit, src_ord, chrom, pos FROM g_calls)"


@query(
    "q_liftover_best",
    f"""{V.with_views(V.CALLS, V.CHAIN, POINTS, V.lift("points", "up"))}
SELECT kit, src_ord, chrom, pos, lifted_chrom, lifted_pos, 'GRCh38' AS lifted_build,
  CASE WHEN lifted_pos IS NOT NULL THEN CASE WHEN reverse THEN '-' ELSE '+' END END AS strand,
  CASE WHEN lifted_pos IS NULL THEN 'unmapped' ELSE 'mapped' END AS status FROM up""",
)
def liftover_best(spark, sf):
    out = liftover.liftover(_points(spark, sf), D.chain_blocks(spark, sf), GRCH37, GRCH38)
    return out.select("kit", "src_ord", "chrom", "pos", "lifted_chrom", "lifted_pos", "lifted_build", "strand", "status")


@query(
    "q_liftover_all",
    f"""{V.with_views(V.CALLS, V.CHAIN, POINTS, V.lift("points", "up"))}
SELECT p.kit, p.src_ord, p.chrom, p.pos, h.lifted_pos, h.blk, h.score::DOUBLE AS score, h.best::INT AS hit_no
FROM up_hits h JOIN points p USING (pid)""",
)
def liftover_all(spark, sf):
    from pyspark.sql import Window as W

    hits = liftover.liftover(_points(spark, sf), D.chain_blocks(spark, sf), GRCH37, GRCH38, hits="all")
    # A window per point: its hits are the chains that overlap there.  A call listed twice has each hit twice, under one number.
    order = W.partitionBy("kit", "src_ord", "chrom", "pos").orderBy(
        F.col("score").desc(), F.col("t_start").desc(), F.col("blk").desc()
    )
    return hits.select("kit", "src_ord", "chrom", "pos", "lifted_pos", "blk", "score", F.dense_rank().over(order).alias("hit_no"))


@query(
    "q_liftover_unmapped",
    f"""{V.with_views(V.CALLS, V.CHAIN, POINTS, V.lift("points", "up"))}
SELECT kit, chrom, CASE WHEN lifted_pos IS NULL THEN 'unmapped' ELSE 'mapped' END AS status,
  count(*) AS n, count(*) FILTER (reverse) AS on_minus FROM up GROUP BY 1, 2, 3""",
)
def liftover_unmapped(spark, sf):
    out = liftover.liftover(_points(spark, sf), D.chain_blocks(spark, sf), GRCH37, GRCH38)
    return out.groupBy("kit", "chrom", "status").agg(F.count("*").alias("n"), F.count_if(F.col("reverse")).alias("on_minus"))


CHAIN_TEXT = """
-- three files; each part is a chain of two blocks followed by a blank line
src AS (SELECT p_partkey AS pk, 'f' || (p_partkey % 3) AS file, CAST(p_size AS BIGINT) AS s, p_partkey % 5 = 0 AS neg FROM part)"""


def chain_lines(spark, sf):
    pk, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    text = F.array(
        F.concat_ws(
            " ", F.lit("chain"), (s * 10).cast("string"), F.concat(F.lit("chr"), (pk % 22 + 1).cast("string")), F.lit("900000000"),
            F.lit("+"), (pk * 1000).cast("string"), (pk * 1000 + 500).cast("string"), F.lit("chrX"), F.lit("800000000"),
            F.when(pk % 5 == 0, F.lit("-")).otherwise(F.lit("+")), (pk * 2000).cast("string"), (pk * 2000 + 500).cast("string"),
            pk.cast("string"),
        ),
        F.concat_ws("\t", (s + 100).cast("string"), (s % 7).cast("string"), (s % 11).cast("string")),
        (s + 50).cast("string"),
        F.lit(""),
    )
    rows = D.table(spark, sf, "part").select(pk, F.posexplode(text).alias("i", "value"))
    file = F.concat(F.lit("f"), (pk % 3).cast("string"))
    return D.lines(rows, file, int_div(pk, 3) * 4 + F.col("i"), F.col("value"), block=64)


@query(
    "q_chain_blocks",
    f"""WITH {CHAIN_TEXT}
SELECT file, CAST(pk % 22 + 1 AS VARCHAR) AS t_chrom, pk * 1000 + x.dt AS t_start, pk * 1000 + x.dt + x.size AS t_end,
  'X' AS q_chrom, pk * 2000 + x.dq AS q_start, 800000000::BIGINT AS q_size, neg AS q_neg, s * 10.0::DOUBLE AS score
FROM (SELECT *, unnest([{{'dt': 0, 'dq': 0, 'size': s + 100}}, {{'dt': s + 100 + s % 7, 'dq': s + 100 + s % 11, 'size': s + 50}}]) AS x FROM src)""",
)
def chain_blocks(spark, sf):
    rows = chain.chain_rows(chain_lines(spark, sf)).filter("problem is null")
    return rows.select("file", "t_chrom", "t_start", "t_end", "q_chrom", "q_start", "q_size", "q_neg", "score")


def dbsnp_lines(spark, sf):
    """Sites-only VCF text from part: RefSeq names, id lists, odd references, some bad rows."""
    pk, s = F.col("p_partkey"), F.col("p_size")
    cm = pk % 27
    name = (
        F.when(cm == 0, F.lit("NT_187361.1"))
        .when(cm == 25, F.lit("NC_012920.1"))
        .when(cm == 26, F.lit("NW_003571054.1"))
        .otherwise(F.concat(F.lit("NC_0000"), F.lpad(cm.cast("string"), 2, "0"), F.lit(".11")))
    )
    rs = F.concat(F.lit("rs"), (pk * 2 % 997).cast("string"))
    ids = F.when(s % 3 == 0, F.concat(rs, F.lit(";rs"), (pk + 5000).cast("string"))).when(s % 3 == 1, rs).otherwise(F.lit("."))
    ref = F.when(s % 5 == 0, F.lit("AT")).otherwise(D.base_at(pk))
    alt = F.when(s % 4 == 0, F.lit("T,G")).when(s % 4 == 1, F.lit("<DEL>,C,A")).otherwise(D.base_at(pk + 1))
    pos = F.when(s % 13 == 0, F.lit("x")).otherwise((int_div(pk, 27) * 100 + s).cast("string"))
    line = F.concat_ws("\t", name, pos, ids, ref, alt, F.lit("."), F.lit("."), F.lit("."))
    rows = D.table(spark, sf, "part").select(pk, F.posexplode(F.array(F.lit("##reference=GRCh38.p14"), line)).alias("i", "value"))
    rows = rows.filter((F.col("i") == 1) | (pk == 0))
    return D.lines(rows, F.lit("dbsnp"), pk * 2 + F.col("i"), F.col("value"))


DBSNP_TEXT = """
db AS (
  SELECT p_partkey AS pk, CAST(p_size AS BIGINT) AS s, CAST(p_partkey % 27 AS INT) AS cm,
    p_size % 13 <> 0 AND p_partkey % 27 BETWEEN 1 AND 25 AS kept,
    p_partkey // 27 * 100 + p_size AS pos,
    CASE WHEN p_size % 3 = 0 THEN [p_partkey * 2 % 997, p_partkey + 5000] WHEN p_size % 3 = 1 THEN [p_partkey * 2 % 997] ELSE [] END AS ids,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) END AS ref,
    CASE WHEN p_size % 4 = 0 THEN 'G,T' WHEN p_size % 4 = 1 THEN 'A,C' ELSE substr('ACGT', CAST((p_partkey + 1) % 4 + 1 AS INT), 1) END AS alt
  FROM part),
db_rows AS (
  SELECT unnest(ids) AS rs_num, CASE cm WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'MT' ELSE CAST(cm AS VARCHAR) END AS chrom,
    cm AS contig_ord, CAST(pos AS BIGINT) AS pos, ref, alt FROM db WHERE kept)"""


@query("q_dbsnp_import", f"WITH {DBSNP_TEXT} SELECT rs_num, 'rs' || rs_num AS rsid, chrom, contig_ord, pos, ref, alt FROM db_rows")
def dbsnp_import(spark, sf):
    rows = rsid_tables.dbsnp_coords(dbsnp_lines(spark, sf), GRCH38)
    return rows.select("rs_num", "rsid", "chrom", "contig_ord", "pos", "ref", F.array_join("alt", ",").alias("alt"))


@query(
    "q_dbsnp_counts",
    f"WITH {DBSNP_TEXT} SELECT 'dbsnp' AS file, sum(CASE WHEN kept THEN len(ids) ELSE 0 END)::BIGINT AS kept, count(*) FILTER (NOT kept) AS skipped, 'GRCh38' AS build FROM db",
)
def dbsnp_counts(spark, sf):
    lines = dbsnp_lines(spark, sf)
    return rsid_tables.dbsnp_counts(lines).join(rsid_tables.dbsnp_build(lines), "file")


@query(
    "q_dbsnp_first",
    f"""WITH {DBSNP_TEXT},
by_rs AS (SELECT *, row_number() OVER (PARTITION BY rs_num ORDER BY contig_ord, pos, ref NULLS FIRST, alt) AS n FROM db_rows),
by_pos AS (SELECT *, row_number() OVER (PARTITION BY contig_ord, pos ORDER BY rs_num, ref NULLS FIRST, alt) AS n FROM db_rows)
SELECT 'rs' AS key, rs_num, contig_ord, pos, ref, alt FROM by_rs WHERE n = 1
UNION ALL SELECT 'pos', rs_num, contig_ord, pos, ref, alt FROM by_pos WHERE n = 1""",
)
def dbsnp_first(spark, sf):
    coords = rsid_tables.dbsnp_coords(dbsnp_lines(spark, sf), GRCH38)
    cols = ["rs_num", "contig_ord", "pos", "ref", F.array_join("alt", ",").alias("alt")]
    one = rsids.first_per_rs(coords).select(F.lit("rs").alias("key"), *cols)
    return one.unionByName(rsids.first_per_position(coords).select(F.lit("pos").alias("key"), *cols))


def rsid_queries(spark, sf):
    """One id per part: its own number, a curated id for every 50th, a text id for every 7th."""
    pk = F.col("p_partkey")
    curated = F.element_at(F.array(*[F.lit(r) for r in CURATED_IDS]), (int_div(pk, 50) % len(CURATED_IDS) + 1).cast("int"))
    number = (pk * 100 + 25).cast("string")
    rsid = F.when(pk % 50 == 0, curated).when(pk % 7 == 0, F.concat(F.lit("i"), number)).otherwise(F.concat(F.lit("rs"), number))
    return D.table(spark, sf, "part").select(pk.alias("qid"), rsid.alias("rsid"))


RSID_QUERIES = f"""
queries AS (
  SELECT p_partkey AS qid, CASE WHEN p_partkey % 50 = 0 THEN {[*CURATED_IDS]}[CAST(p_partkey // 50 % {len(CURATED_IDS)} + 1 AS INT)]
    WHEN p_partkey % 7 = 0 THEN 'i' || (p_partkey * 100 + 25) ELSE 'rs' || (p_partkey * 100 + 25) END AS rsid FROM part),
both_builds AS (SELECT qid, rsid, b.build FROM queries, (VALUES ('GRCh37'), ('GRCh38')) AS b(build)),
known AS (
  SELECT build, rsid, chrom, pos, ref, alt, 'curated' AS source FROM g_curated
  UNION ALL SELECT build, rsid, chrom, pos, ref, alt, 'dbsnp' FROM g_coords
  WHERE rsid NOT IN (SELECT rsid FROM g_curated))"""


@query(
    "q_rsid_resolve",
    f"""{V.with_views(V.COORDS, CURATED, RSID_QUERIES)}
SELECT q.qid, q.rsid, q.build, k.chrom, k.pos, k.ref, k.alt, k.source
FROM both_builds q LEFT JOIN known k ON k.rsid = q.rsid AND k.build = q.build""",
)
def rsid_resolve(spark, sf):
    q = rsid_queries(spark, sf).withColumn("build", F.explode(F.array(F.lit(GRCH37), F.lit(GRCH38))))
    out = rsids.resolve_rsids(q, D.rsid_coords(spark, sf))
    return out.select(
        "qid", "rsid", "build", "coord.chrom", "coord.pos", "coord.ref", F.array_join("coord.alt", ",").alias("alt"), "coord.source"
    )


CROSS_BUILD = f"""
direct AS (SELECT q.qid, q.rsid, k.chrom, k.pos, k.ref, k.alt, k.source FROM queries q LEFT JOIN known k ON k.rsid = q.rsid AND k.build = 'GRCh38'),
far AS (SELECT q.qid AS pid, q.rsid, k.chrom, k.pos, k.alt, k.source FROM queries q JOIN known k ON k.rsid = q.rsid AND k.build = 'GRCh37'),
{V.lift("far", "far_up")},
resolved AS (
  SELECT d.qid, d.rsid, coalesce(d.chrom, f.lifted_chrom) AS chrom, coalesce(d.pos, f.lifted_pos) AS pos, d.ref,
    CASE WHEN d.pos IS NOT NULL THEN d.alt WHEN f.lifted_pos IS NOT NULL THEN f.alt END AS alt,
    CASE WHEN d.pos IS NOT NULL THEN d.source WHEN f.lifted_pos IS NOT NULL THEN f.source END AS source,
    CASE WHEN d.pos IS NULL AND f.lifted_pos IS NOT NULL THEN f.pos END AS from_pos,
    d.pos IS NULL AND f.pid IS NOT NULL AND f.lifted_pos IS NULL AS lift_failed
  FROM direct d LEFT JOIN far_up f ON f.pid = d.qid)"""


@query(
    "q_rsid_crossbuild",
    f"""{V.with_views(V.COORDS, CURATED, V.CHAIN, RSID_QUERIES, CROSS_BUILD)}
SELECT qid, rsid, chrom, pos, ref, alt, from_pos, lift_failed FROM resolved""",
)
def rsid_crossbuild(spark, sf):
    q = rsid_queries(spark, sf).withColumn("build", F.lit(GRCH38))
    out = rsids.resolve_across_builds(q, D.rsid_coords(spark, sf), D.chain_blocks(spark, sf))
    return out.select(
        "qid", "rsid", "coord.chrom", "coord.pos", "coord.ref", F.array_join("coord.alt", ",").alias("alt"),
        F.col("lifted_from.pos").alias("from_pos"), "lift_failed",
    )


NAMED = """
named AS (
  SELECT build, chrom, pos, rsid, ref, alt FROM g_curated
  UNION ALL SELECT c.build, c.chrom, c.pos, c.rsid, c.ref, c.alt FROM g_coords c
  WHERE NOT EXISTS (SELECT 1 FROM g_curated k WHERE k.build = c.build AND k.chrom = c.chrom AND k.pos = c.pos))"""


@query(
    "q_coord_to_rsid",
    f"""{V.with_views(V.CALLS, V.KITS, V.COORDS, CURATED, NAMED)}
SELECT c.kit, c.chrom, c.pos, n.rsid, n.ref, n.alt
FROM g_calls c JOIN g_kits k USING (kit) LEFT JOIN named n ON n.build = k.build AND n.chrom = c.chrom AND n.pos = c.pos""",
)
def coord_to_rsid(spark, sf):
    builds = D.kits(spark).select(F.col("id").alias("kit"), "build")
    points = D.calls(spark, sf).select("kit", "chrom", "pos").join(builds, "kit")
    out = rsids.name_positions(points, D.rsid_coords(spark, sf))
    return out.select("kit", "chrom", "pos", "named.rsid", "named.ref", F.array_join("named.alt", ",").alias("alt"))


FASTA_WIDTH = 20
BASE_SQL = f"""
bases AS (
  SELECT 'c' || (p_partkey % 27) AS chrom, p_partkey // 27 AS slot, i,
    substr('ACGT', CAST((p_partkey * (i + 3) + i) % 4 + 1 AS INT), 1) AS base
  FROM part, range({FASTA_WIDTH}) AS r(i))"""
CHUNK = 64


@query(
    "q_reference_chunks",
    f"""WITH {BASE_SQL} SELECT 'GRCh38' AS build, chrom, (slot * {FASTA_WIDTH} + i) // {CHUNK} AS chunk,
string_agg(base, '' ORDER BY slot, i) AS seq FROM bases GROUP BY 1, 2, 3""",
)
def reference_chunks(spark, sf):
    return D.fasta_chunks(spark, sf, CHUNK)


@query(
    "q_reference_base",
    f"""WITH {BASE_SQL},
points AS (SELECT l_orderkey, l_linenumber, 'c' || (l_partkey % 29) AS chrom, l_partkey // 27 * {FASTA_WIDTH} + CAST(l_quantity AS BIGINT) AS pos FROM lineitem)
SELECT p.chrom, p.pos, b.base, count(*) AS n FROM points p
LEFT JOIN bases b ON b.chrom = p.chrom AND b.slot * {FASTA_WIDTH} + b.i = p.pos - 1 GROUP BY 1, 2, 3""",
)
def reference_base(spark, sf):
    pk = F.col("l_partkey")
    points = D.table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), (pk % 29).cast("string")).alias("chrom"),
        (int_div(pk, 27) * FASTA_WIDTH + F.col("l_quantity").cast("bigint")).alias("pos"),
        F.lit(GRCH38).alias("build"),
    )
    out = rsids.reference_bases(points, D.fasta_chunks(spark, sf, CHUNK), chunk=CHUNK)
    return out.groupBy("chrom", "pos", "base").agg(F.count("*").alias("n"))


ENRICHED = """
own AS (SELECT k.*, c.rsid AS own_rsid, c.ref AS own_ref, c.alt AS own_alt, c.pos IS NOT NULL AS own_hit
        FROM g_calls k LEFT JOIN g_coords c ON k.kit = 'k1' AND c.build = 'GRCh37' AND c.rs_num = k.rs_num
          AND c.chrom = k.chrom AND c.pos = k.pos),
enriched AS (
  SELECT o.kit, o.src_ord, o.chrom, o.contig_ord, o.pos, o.end_pos, o.rs_num, o.genotype, o.gt, o.filter, o.quality, o.depth, o.ref_block,
    coalesce(o.rsid, n.rsid) AS rsid,
    CASE WHEN o.kit <> 'k1' THEN o.ref WHEN own_hit THEN own_ref ELSE n.ref END AS ref,
    CASE WHEN o.kit <> 'k1' THEN o.alt WHEN own_hit THEN own_alt ELSE n.alt END AS alt,
    CASE WHEN o.kit = 'k1' AND o.zygosity = 'hom' AND coalesce(own_ref, n.ref) IS NOT NULL
         THEN CASE WHEN substr(o.genotype, 1, 1) = coalesce(own_ref, n.ref) THEN 'hom_ref' ELSE 'hom_alt' END
         ELSE o.zygosity END AS zygosity
  FROM own o LEFT JOIN named n ON o.kit = 'k1' AND n.build = 'GRCh37' AND n.chrom = o.chrom AND n.pos = o.pos)"""


@query(
    "q_enrich_array",
    f"""{V.with_views(V.CALLS, V.COORDS, CURATED, NAMED, ENRICHED)}
SELECT kit, chrom, pos, rsid, ref, alt, genotype, zygosity FROM enriched""",
)
def enrich_array(spark, sf):
    out = enrich.enrich_arrays(D.calls(spark, sf), D.kits(spark), D.rsid_coords(spark, sf))
    alt = F.when(F.size("alt") > 0, F.array_join("alt", ","))
    return out.select("kit", "chrom", "pos", "rsid", "ref", alt.alias("alt"), "genotype", "zygosity")
