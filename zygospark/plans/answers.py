"""Lookup and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospark.operators import compare, lookup, ordering, summary
from zygospark.plans import derived as D
from zygospark.plans import oracle_views as V
from zygospark.plans.registry import query
from zygospark.plans.sites import CURATED, ENRICHED, NAMED, RSID_QUERIES, rsid_queries
from zygospark.schema import GRCH37, GRCH38
from zygospark.session import small_table
from zygospark.sinks.audit_log import lookup_details

# ---------------------------------------------------------------- lookups

SITE_COLUMNS = "sid, kit, chrom, pos, build, ref_calls, q_rsid, ref_hint, alt_hint, from_build, from_pos"


def answer_sql(sites: str) -> str:
    """CTE `answers` for a CTE of sites."""
    return f"""
sited AS (SELECT s.*, coalesce(s.ref_hint, n.ref) AS site_ref FROM {sites} s
          LEFT JOIN named n ON n.build = s.build AND n.chrom = s.chrom AND n.pos = s.pos),
exact AS (SELECT s.*, e.rsid, e.ref, e.alt, e.genotype, e.zygosity, e.filter, e.quality, e.depth, e.ref_block
          FROM sited s JOIN enriched e ON e.kit = s.kit AND e.chrom = s.chrom AND e.pos = s.pos),
spanned AS (
  SELECT * FROM (SELECT s.*, c.filter, c.quality, c.depth,
      row_number() OVER (PARTITION BY s.sid ORDER BY c.pos DESC, c.end_pos DESC, c.src_ord DESC) AS n
    FROM sited s JOIN g_calls c ON c.kit = s.kit AND c.chrom = s.chrom AND c.ref_block AND c.pos < s.pos AND c.end_pos >= s.pos
    WHERE s.sid NOT IN (SELECT sid FROM exact)) WHERE n = 1),
absent AS (SELECT *, ref_calls = 'absent-means-ref' AND regexp_full_match(chrom, '[0-9]+|X|Y|MT') AS inferred FROM sited
           WHERE sid NOT IN (SELECT sid FROM exact) AND sid NOT IN (SELECT sid FROM spanned)),
answers AS (
  SELECT sid AS qid, kit, q_rsid AS rsid, chrom, pos, build, site_ref AS ref, alt_hint AS alt, site_ref || site_ref AS genotype,
    'hom_ref' AS zygosity, 'observed' AS call_source, filter, quality, depth, from_build, from_pos FROM exact WHERE ref_block
  UNION ALL
  SELECT sid, kit, q_rsid, chrom, pos, build, site_ref, alt_hint, site_ref || site_ref, 'hom_ref', 'observed', filter, quality, depth,
    from_build, from_pos FROM spanned
  UNION ALL
  SELECT sid, kit, coalesce(rsid, q_rsid), chrom, pos, build, ref, alt, genotype, zygosity, 'observed', filter, quality, depth,
    from_build, from_pos FROM exact WHERE NOT ref_block
  UNION ALL
  SELECT sid, kit, q_rsid, chrom, pos, build, CASE WHEN inferred THEN site_ref ELSE ref_hint END, alt_hint,
    CASE WHEN inferred THEN site_ref || site_ref END, CASE WHEN inferred THEN 'hom_ref' ELSE 'no_call' END,
    CASE WHEN inferred THEN 'inferred_ref' ELSE 'missing' END, NULL, NULL, NULL, from_build, from_pos FROM absent)"""


ANSWER_SELECT = """SELECT qid, kit, rsid, chrom, pos, build, ref, alt, genotype, zygosity, call_source, filter,
floor(quality::DOUBLE * 100 + 0.5) / 100 AS quality, depth, from_build, from_pos FROM answers"""


def flat(answers: DataFrame) -> DataFrame:
    plain = [
        "qid", "kit", "rsid", "chrom", "pos", "build", "ref", "genotype", "zygosity", "call_source", "filter", "quality", "depth",
    ]
    return answers.select(
        *plain,
        F.when(F.size("alt") > 0, F.array_join("alt", ",")).alias("alt"),
        F.col("lifted_from.build").alias("from_build"),
        F.col("lifted_from.pos").alias("from_pos"),
    )


def counted_kits(spark, calls):
    return D.kits(spark, summary.kit_counts(calls))


def place_queries(calls: DataFrame, targets: list[str], build: str | None) -> DataFrame:
    """Every place where some kit has a call, asked of the target kits."""
    q = calls.select("chrom", "pos").distinct()
    q = q.withColumn("kit", F.explode(F.array(*[F.lit(t) for t in targets])))
    return q.select(
        F.concat_ws(":", "kit", "chrom", F.col("pos").cast("string")).alias("qid"), "kit", "chrom", "pos",
        F.lit(build).cast("string").alias("build"),
    )


def place_sites_sql(targets: list[str]) -> str:
    kits = ", ".join(f"('{t}')" for t in targets)
    return f"""
places AS (
  SELECT t.kit || ':' || c.chrom || ':' || c.pos AS sid, t.kit, c.chrom, c.pos, k.build, k.ref_calls
  FROM (SELECT DISTINCT chrom, pos FROM g_calls) c, (VALUES {kits}) AS t(kit) JOIN g_kits k ON k.kit = t.kit),
sites AS (
  SELECT p.*, n.rsid AS q_rsid, n.ref AS ref_hint, n.alt AS alt_hint, NULL::VARCHAR AS from_build, NULL::BIGINT AS from_pos
  FROM places p LEFT JOIN named n ON n.build = p.build AND n.chrom = p.chrom AND n.pos = p.pos)"""


BASE = (V.CALLS, V.KITS, V.COORDS, CURATED, NAMED, ENRICHED)


@query("q_lookup_exact", f"{V.with_views(*BASE, place_sites_sql(['k2']), answer_sql('sites'))} {ANSWER_SELECT}")
def lookup_exact(spark, sf):
    calls = D.stored_calls(spark, sf)
    q = place_queries(calls, ["k2"], None)
    return flat(lookup.lookup_positions(calls, counted_kits(spark, calls), q, D.rsid_coords(spark, sf)))


@query("q_lookup_spanning", f"{V.with_views(*BASE, place_sites_sql(['k3']), answer_sql('sites'))} {ANSWER_SELECT}")
def lookup_spanning(spark, sf):
    calls = D.stored_calls(spark, sf)
    q = place_queries(calls, ["k3"], None)
    return flat(lookup.lookup_positions(calls, counted_kits(spark, calls), q, D.rsid_coords(spark, sf)))


CROSS_SITES = f"""
asked AS (SELECT t.kit || ':' || c.chrom || ':' || c.pos AS pid, t.kit, c.chrom, c.pos
          FROM (SELECT DISTINCT chrom, pos FROM g_calls) c, (VALUES ('k2'), ('k3')) AS t(kit)),
{V.lift("asked", "moved")},
sites AS (
  SELECT m.pid AS sid, m.kit, m.lifted_chrom AS chrom, m.lifted_pos AS pos, k.build, k.ref_calls, n.rsid AS q_rsid, n.ref AS ref_hint,
    n.alt AS alt_hint, 'GRCh37' AS from_build, m.pos AS from_pos
  FROM moved m JOIN g_kits k ON k.kit = m.kit
  LEFT JOIN named n ON n.build = k.build AND n.chrom = m.lifted_chrom AND n.pos = m.lifted_pos WHERE m.lifted_pos IS NOT NULL)"""


@query(
    "q_lookup_crossbuild",
    f"""{V.with_views(*BASE, V.CHAIN, CROSS_SITES, answer_sql("sites"))} {ANSWER_SELECT}
UNION ALL SELECT pid, kit, NULL, chrom, pos, 'GRCh37', NULL, NULL, NULL, 'no_call', 'missing', NULL, NULL, NULL, NULL, NULL
FROM moved WHERE lifted_pos IS NULL""",
)
def lookup_crossbuild(spark, sf):
    calls = D.stored_calls(spark, sf)
    q = place_queries(calls, ["k2", "k3"], GRCH37)
    kits = counted_kits(spark, calls)
    return flat(lookup.lookup_positions(calls, kits, q, D.rsid_coords(spark, sf), D.chain_blocks(spark, sf)))


def rsid_answer_sql(asked: str) -> str:
    """Answers for a CTE of (qid, kit, rsid) queries against GRCh37 and GRCh38 kits."""
    return f"""
q AS (SELECT a.*, k.build, k.ref_calls, a.kit <> 'k2' AS indexed FROM {asked} a JOIN g_kits k USING (kit)),
own_hits AS MATERIALIZED (
  SELECT q.qid, q.kit, e.rsid, e.chrom, e.pos, q.build, e.ref, e.alt, e.genotype, e.zygosity, e.filter, e.quality, e.depth
  FROM q JOIN enriched e ON q.indexed AND e.kit = q.kit AND e.rsid = q.rsid),
rest AS (SELECT * FROM q WHERE qid NOT IN (SELECT qid FROM own_hits)),
near AS (SELECT r.*, k.chrom, k.pos, k.ref, k.alt FROM rest r JOIN known k ON k.rsid = r.rsid AND k.build = r.build),
far AS (SELECT r.qid AS pid, r.kit, r.rsid, r.build, r.ref_calls, k.build AS o_build, k.chrom, k.pos, k.alt
        FROM rest r JOIN known k ON k.rsid = r.rsid AND k.build <> r.build WHERE r.qid NOT IN (SELECT qid FROM near)),
{V.lift("far", "far_up")},
sites AS (
  SELECT qid AS sid, kit, chrom, pos, build, ref_calls, rsid AS q_rsid, ref AS ref_hint, alt AS alt_hint,
    NULL::VARCHAR AS from_build, NULL::BIGINT AS from_pos FROM near
  UNION ALL SELECT pid, kit, lifted_chrom, lifted_pos, build, ref_calls, rsid, NULL, alt, o_build, pos FROM far_up WHERE lifted_pos IS NOT NULL),
{answer_sql("sites")}"""


RSID_TAIL = f"""{ANSWER_SELECT}
UNION ALL SELECT qid, kit, rsid, chrom, pos, build, ref, alt, genotype, zygosity, 'observed', filter,
  floor(quality::DOUBLE * 100 + 0.5) / 100, depth, NULL, NULL FROM own_hits
UNION ALL SELECT qid, kit, rsid, NULL, NULL, build, NULL, NULL, NULL, 'no_call', 'missing', NULL, NULL, NULL, NULL, NULL
FROM rest WHERE qid NOT IN (SELECT sid FROM sites)"""
CALL_IDS = """
asked AS (SELECT t.kit || ':' || c.rsid AS qid, t.kit, c.rsid
  FROM (SELECT DISTINCT rsid FROM g_calls WHERE rsid IS NOT NULL) c, (VALUES ('k3'), ('k4')) AS t(kit))"""
TABLE_IDS = """
asked AS (SELECT k.kit || ':' || q.qid AS qid, k.kit, q.rsid FROM queries q, g_kits k)"""


def both_ways(spark, sf):
    """The same alignment blocks read in both directions."""
    return D.chain_blocks(spark, sf).unionByName(D.chain_blocks(spark, sf, GRCH38, GRCH37))


@query(
    "q_lookup_rsid",
    f"{V.with_views(*BASE, V.CHAIN, RSID_QUERIES, CALL_IDS, rsid_answer_sql('asked').lstrip())} {RSID_TAIL}",
)
def lookup_rsid(spark, sf):
    calls = D.stored_calls(spark, sf)
    ids = calls.filter("rsid is not null").select("rsid").distinct()
    q = ids.withColumn("kit", F.explode(F.array(F.lit("k3"), F.lit("k4"))))
    q = q.select(F.concat_ws(":", "kit", "rsid").alias("qid"), "kit", "rsid")
    return flat(lookup.lookup_rsids(calls, counted_kits(spark, calls), q, D.rsid_coords(spark, sf), both_ways(spark, sf)))


@query(
    "q_lookup_rsid_table",
    f"{V.with_views(*BASE, V.CHAIN, RSID_QUERIES, TABLE_IDS, rsid_answer_sql('asked').lstrip())} {RSID_TAIL}",
)
def lookup_rsid_table(spark, sf):
    calls = D.stored_calls(spark, sf)
    kits = counted_kits(spark, calls)
    q = rsid_queries(spark, sf).withColumn("kit", F.explode(F.array(*[F.lit(f"k{i}") for i in range(1, 5)])))
    q = q.select(F.concat_ws(":", "kit", F.col("qid").cast("string")).alias("qid"), "kit", "rsid")
    return flat(lookup.lookup_rsids(calls, kits, q, D.rsid_coords(spark, sf), both_ways(spark, sf)))


@query(
    "q_infer_absent",
    f"""{V.with_views(*BASE, place_sites_sql(["k2", "k3", "k4"]), answer_sql("sites"))}
SELECT kit, call_source, zygosity, count(*) AS n, count(ref) AS with_ref, count(genotype) AS with_genotype FROM answers GROUP BY 1, 2, 3""",
)
def infer_absent(spark, sf):
    calls = D.stored_calls(spark, sf)
    q = place_queries(calls, ["k2", "k3", "k4"], None)
    out = lookup.lookup_positions(calls, counted_kits(spark, calls), q, D.rsid_coords(spark, sf))
    return out.groupBy("kit", "call_source", "zygosity").agg(
        F.count("*").alias("n"), F.count("ref").alias("with_ref"), F.count("genotype").alias("with_genotype")
    )


@query(
    "q_lookup_warnings",
    f"""{V.with_views(*BASE, place_sites_sql(["k2"]), answer_sql("sites"))}
SELECT DISTINCT chrom || ':' || pos || '{lookup.UNKNOWN_REFERENCE}' AS warning FROM answers WHERE call_source = 'inferred_ref' AND ref IS NULL
UNION SELECT '{lookup.INFERRED_WARNING}' FROM answers WHERE call_source = 'inferred_ref'""",
)
def lookup_warnings(spark, sf):
    calls = D.stored_calls(spark, sf)
    q = place_queries(calls, ["k2"], None)
    out = lookup.lookup_positions(calls, counted_kits(spark, calls), q, D.rsid_coords(spark, sf))
    return lookup.distinct_warnings(out, ["qid"])


@query(
    "q_audit_details",
    f"""{V.with_views(*BASE, place_sites_sql(["k2"]), answer_sql("sites"))}
SELECT count(*) AS answers, count(*) FILTER (call_source = 'observed') AS observed, count(*) FILTER (call_source = 'inferred_ref') AS inferred,
  count(*) FILTER (call_source = 'missing') AS missing FROM answers""",
)
def audit_details(spark, sf):
    calls = D.stored_calls(spark, sf)
    q = place_queries(calls, ["k2"], None)
    return lookup_details(lookup.lookup_positions(calls, counted_kits(spark, calls), q, D.rsid_coords(spark, sf)))


@query(
    "q_records_between",
    f"""{V.with_views(V.CALLS)},
spans AS (SELECT kit || ':' || src_ord || ':' || chrom || ':' || pos AS id, kit, chrom, pos AS lo, pos + 1000 AS hi FROM g_calls)
SELECT s.id, count(c.pos) AS n FROM spans s LEFT JOIN g_calls c ON c.kit = s.kit AND c.chrom = s.chrom AND c.pos > s.lo AND c.pos < s.hi
GROUP BY s.id""",
)
def records_between(spark, sf):
    calls = D.stored_calls(spark, sf)
    key = F.concat_ws(":", "kit", F.col("src_ord").cast("string"), "chrom", F.col("pos").cast("string"))
    spans = calls.select(key.alias("id"), "kit", "chrom", F.col("pos").alias("lo"), (F.col("pos") + 1000).alias("hi"))
    return ordering.records_between(calls, spans)


# ---------------------------------------------------------------- comparisons

SAME_BUILD = [("k2", "k3"), ("k2", "k4"), ("k3", "k4"), ("k4", "k2")]
ACROSS = [("k2", "k1"), ("k3", "k1"), ("k1", "k2"), ("k1", "k4")]
ALL_PAIRS = [(f"k{a}", f"k{b}") for a in range(1, 5) for b in range(1, 5) if a != b]


def pair_table(spark, pairs):
    return small_table(spark, pairs, "a string, b string")


def letter_coords(calls: DataFrame) -> DataFrame:
    """Reference letters seen in the GRCh38 kits, as a coordinate table."""
    seen = calls.filter("ref is not null and contig_ord is not null").select("chrom", "contig_ord", "pos", "ref").distinct()
    number = F.col("contig_ord").cast("bigint") * (1 << 40) + F.col("pos")
    return seen.select(
        F.lit(GRCH38).alias("build"), number.alias("rs_num"), F.concat(F.lit("rs"), number.cast("string")).alias("rsid"),
        "chrom", "contig_ord", "pos", "ref", F.array().cast("array<string>").alias("alt"), F.lit("dbsnp").alias("source"),
    )


LETTERS = """
letters AS (SELECT DISTINCT 'GRCh38' AS build, chrom, pos, ref FROM g_calls WHERE ref IS NOT NULL AND contig_ord IS NOT NULL)"""
COORD_LETTERS = "letters AS (SELECT build, chrom, pos, ref FROM named)"


def key_sql(g: str, z: str) -> str:
    return f"""CASE WHEN {z} <> 'no_call' AND regexp_full_match({g}, '[ACGT]+') THEN
      CASE WHEN length({g}) = 1 THEN {g} || {g} ELSE least(substr({g}, 1, 1), substr({g}, 2, 1)) || greatest(substr({g}, 1, 1), substr({g}, 2, 1)) END END"""


def compare_sql(pairs, source: str, region: str = "TRUE") -> str:
    """CTEs up to `judged`: one row per judged pair of genotypes."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""
pairs AS (
  SELECT p.a, p.b, ka.build AS a_build, kb.build AS b_build, ka.ref_calls = 'absent-means-ref' AS a_absent,
    kb.ref_calls = 'absent-means-ref' AS b_absent
  FROM (VALUES {values}) AS p(a, b) JOIN g_kits ka ON ka.kit = p.a JOIN g_kits kb ON kb.kit = p.b),
a_rows AS (
  SELECT p.*, c.chrom, c.pos, c.contig_ord, c.end_pos, c.src_ord, c.rsid, c.genotype, c.zygosity, {key_sql("c.genotype", "c.zygosity")} AS key,
    coalesce(c.ref, l.ref) AS letter,
    row_number() OVER (PARTITION BY p.a, p.b, c.chrom, c.pos ORDER BY c.end_pos, c.src_ord) AS n
  FROM pairs p JOIN {source} c ON c.kit = p.a LEFT JOIN letters l ON l.build = p.a_build AND l.chrom = c.chrom AND l.pos = c.pos
  WHERE c.zygosity <> 'no_call' AND NOT c.ref_block AND {region.format(c="c.chrom", p="c.pos")}),
b_calls AS (
  SELECT p.a || p.b || c.src_ord || ':' || c.chrom || ':' || c.pos AS pid, p.*, c.chrom, c.pos, c.contig_ord, c.end_pos, c.src_ord, c.rsid,
    c.ref, c.genotype, c.zygosity
  FROM pairs p JOIN g_calls c ON c.kit = p.b WHERE c.zygosity <> 'no_call' AND NOT c.ref_block),
{V.lift("b_calls", "b_up")},
b_moved AS (
  SELECT a, b, a_build, b_build, a_absent, b_absent, contig_ord, chrom AS o_chrom, pos AS o_pos, end_pos, src_ord, rsid, zygosity,
    CASE WHEN a_build = b_build THEN chrom ELSE lifted_chrom END AS chrom, CASE WHEN a_build = b_build THEN pos ELSE lifted_pos END AS pos,
    CASE WHEN a_build <> b_build AND reverse THEN translate(genotype, 'ACGT', 'TGCA') ELSE genotype END AS genotype,
    CASE WHEN a_build <> b_build AND reverse THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref
  FROM b_up),
b_rows AS (
  SELECT * FROM (
    SELECT m.*, {key_sql("genotype", "zygosity")} AS key, coalesce(m.ref, l.ref) AS letter,
      row_number() OVER (PARTITION BY a, b, m.chrom, m.pos ORDER BY contig_ord DESC NULLS FIRST, o_chrom DESC, o_pos DESC, end_pos DESC, src_ord DESC) AS n
    FROM b_moved m LEFT JOIN letters l ON l.build = m.a_build AND l.chrom = m.chrom AND l.pos = m.pos
    WHERE m.pos IS NOT NULL AND {region.format(c="m.chrom", p="m.pos")}) WHERE n = 1),
judged AS (
  SELECT x.a, x.b, x.chrom, x.pos, x.key AS ka, y.key AS kb, FALSE AS inferred, 0 AS side, x.genotype AS ga, y.genotype AS gb,
    coalesce(x.rsid, y.rsid) AS rsid, x.contig_ord, x.end_pos, x.src_ord
  FROM a_rows x JOIN b_rows y ON x.n = 1 AND y.a = x.a AND y.b = x.b AND y.chrom = x.chrom AND y.pos = x.pos
  UNION ALL
  SELECT x.a, x.b, x.chrom, x.pos, x.key, x.letter || x.letter, TRUE, 0, x.genotype, x.letter || x.letter, x.rsid, x.contig_ord, x.end_pos, x.src_ord
  FROM a_rows x LEFT JOIN b_rows y ON x.n = 1 AND y.a = x.a AND y.b = x.b AND y.chrom = x.chrom AND y.pos = x.pos
  WHERE y.a IS NULL AND x.b_absent AND regexp_full_match(x.chrom, '[0-9]+|X|Y|MT')
  UNION ALL
  SELECT y.a, y.b, y.chrom, y.pos, y.letter || y.letter, y.key, TRUE, 1, y.letter || y.letter, y.genotype, y.rsid, NULL, NULL, NULL
  FROM b_rows y LEFT JOIN a_rows x ON y.a = x.a AND y.b = x.b AND y.chrom = x.chrom AND y.pos = x.pos
  WHERE x.a IS NULL AND y.a_absent AND regexp_full_match(y.chrom, '[0-9]+|X|Y|MT'))"""


TALLY_SELECT = """
SELECT p.a, p.b, p.a_build AS build, p.a_build <> p.b_build AS lifted,
  count(*) FILTER (ka = kb) AS concordant, count(*) FILTER (ka <> kb) AS discordant, count(*) FILTER (inferred) AS inferred_ref_sites,
  count(*) FILTER (j.a IS NOT NULL AND (ka IS NULL OR kb IS NULL)) AS skipped_sites,
  coalesce((SELECT count(*) FROM b_moved m WHERE m.a = p.a AND m.b = p.b AND m.pos IS NULL), 0) AS unlifted_sites,
  count(*) FILTER (ka = kb OR ka <> kb) AS overlap,
  CASE WHEN count(*) FILTER (ka = kb OR ka <> kb) > 0 THEN
    floor((count(*) FILTER (ka = kb) / count(*) FILTER (ka = kb OR ka <> kb)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE ELSE 0.0::DOUBLE END AS concordance
FROM pairs p LEFT JOIN judged j ON j.a = p.a AND j.b = p.b GROUP BY p.a, p.b, p.a_build, p.b_build"""


@query(
    "q_compare_same_build",
    f"{V.with_views(*BASE, V.CHAIN, COORD_LETTERS, compare_sql(SAME_BUILD, 'enriched').lstrip())} {TALLY_SELECT}",
)
def compare_same_build(spark, sf):
    return compare.compare_tallies(
        D.stored_calls(spark, sf), D.kits(spark), pair_table(spark, SAME_BUILD), coords=D.rsid_coords(spark, sf)
    )


@query(
    "q_compare_lifted",
    f"{V.with_views(V.CALLS, V.KITS, V.CHAIN, LETTERS, compare_sql([('k2', 'k1')], 'g_calls').lstrip())} {TALLY_SELECT}",
)
def compare_lifted(spark, sf):
    calls = D.stored_calls(spark, sf)
    return compare.compare_tallies(
        calls, D.kits(spark), pair_table(spark, [("k2", "k1")]), D.chain_blocks(spark, sf), letter_coords(calls)
    )


@query(
    "q_compare_all_pairs",
    f"{V.with_views(*BASE, V.CHAIN, COORD_LETTERS, compare_sql(ALL_PAIRS, 'enriched').lstrip())} {TALLY_SELECT}",
)
def compare_all_pairs(spark, sf):
    return compare.compare_tallies(
        D.stored_calls(spark, sf), D.kits(spark), pair_table(spark, ALL_PAIRS), both_ways(spark, sf), D.rsid_coords(spark, sf)
    )


REGION = ("3", 1, 3_000_000)


@query(
    "q_compare_region",
    f"""{V.with_views(*BASE, V.CHAIN, COORD_LETTERS,
        compare_sql(ACROSS, "enriched", "{c} = '3' AND {p} BETWEEN 1 AND 3000000").lstrip())} {TALLY_SELECT}""",
)
def compare_region(spark, sf):
    return compare.compare_tallies(
        D.stored_calls(spark, sf), D.kits(spark), pair_table(spark, ACROSS), both_ways(spark, sf), D.rsid_coords(spark, sf), region=REGION
    )


@query(
    "q_discordant_capped",
    f"""{V.with_views(*BASE, V.CHAIN, COORD_LETTERS, compare_sql(ALL_PAIRS, "enriched").lstrip())},
listed AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY side,
    CASE WHEN side = 0 THEN contig_ord END NULLS LAST, CASE WHEN side = 0 THEN chrom END,
    CASE WHEN side = 1 THEN TRY_CAST(CASE chrom WHEN 'X' THEN '23' WHEN 'Y' THEN '24' WHEN 'MT' THEN '25' ELSE chrom END AS INT) END,
    pos, end_pos, src_ord) AS n FROM judged WHERE ka <> kb)
SELECT a, b, n::INT AS n, chrom, pos, rsid, ga AS genotype_a, gb AS genotype_b,
  CASE WHEN inferred AND side = 1 THEN 'inferred_ref' ELSE 'observed' END AS source_a,
  CASE WHEN inferred AND side = 0 THEN 'inferred_ref' ELSE 'observed' END AS source_b FROM listed WHERE n <= 50""",
)
def discordant_capped(spark, sf):
    rows = compare.discordant_sites(
        D.stored_calls(spark, sf), D.kits(spark), pair_table(spark, ALL_PAIRS), both_ways(spark, sf), D.rsid_coords(spark, sf)
    )
    return rows.select(
        "a", "b", "n", "chrom", "pos", "rsid", F.col("call_a.genotype").alias("genotype_a"),
        F.col("call_b.genotype").alias("genotype_b"), "source_a", "source_b",
    )
