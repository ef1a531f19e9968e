"""Summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from zygospark.functions.policy import has_rsids, ref_calls_policy
from zygospark.operators import ordering, summary
from zygospark.plans import derived as D
from zygospark.plans import oracle_views as V
from zygospark.plans.registry import query

ZYGOSITY_SQL = """
  count(*) FILTER (zygosity = 'no_call') AS no_calls, count(*) FILTER (zygosity = 'het') AS het,
  count(*) FILTER (zygosity = 'hom_alt') AS hom_alt, count(*) FILTER (zygosity = 'hom_ref') AS hom_ref,
  count(*) FILTER (zygosity = 'hom') AS hom_unknown_ref, count(*) FILTER (zygosity = 'hemi') AS hemizygous,
  count(*) FILTER (ref_block) AS ref_blocks"""


@query(
    "q_summary_zygosity",
    f"{V.with_views(V.CALLS)} SELECT kit, count(*) AS records, {ZYGOSITY_SQL} FROM g_calls GROUP BY kit",
)
def summary_zygosity(spark, sf):
    return summary.zygosity_counts(D.calls(spark, sf))


PRIMARY_LIST = ", ".join(f"('{c}')" for c in [*map(str, range(1, 23)), "X", "Y", "MT", "other_contigs"])


@query(
    "q_summary_by_chrom",
    f"""{V.with_views(V.CALLS)},
names AS (SELECT * FROM (VALUES {PRIMARY_LIST}) AS v(chrom)),
counts AS (SELECT kit, CASE WHEN contig_ord IS NULL THEN 'other_contigs' ELSE chrom END AS chrom, count(*) AS n
           FROM g_calls GROUP BY 1, 2)
SELECT k.kit, names.chrom, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT kit FROM g_calls) k CROSS JOIN names LEFT JOIN counts c ON c.kit = k.kit AND c.chrom = names.chrom""",
)
def summary_by_chrom(spark, sf):
    return summary.chrom_counts(D.calls(spark, sf))


SEX_VIEWS = """
tallies AS (
  SELECT k.kit, k.assay,
    count(*) FILTER (c.chrom = 'X' AND c.zygosity <> 'no_call') AS x_called,
    count(*) FILTER (c.chrom = 'X' AND c.zygosity = 'het') AS x_het,
    count(*) FILTER (c.chrom = 'Y') AS y_total,
    count(*) FILTER (c.chrom = 'Y' AND c.zygosity <> 'no_call') AS y_called
  FROM g_kits k LEFT JOIN g_calls c ON c.kit = k.kit AND NOT c.ref_block AND (c.chrom = 'Y' OR (c.chrom = 'X' AND NOT (
    CASE k.build WHEN 'GRCh37' THEN c.pos BETWEEN 60001 AND 2699520 OR c.pos BETWEEN 154931044 AND 155260560
                 WHEN 'GRCh38' THEN c.pos BETWEEN 10001 AND 2781479 OR c.pos BETWEEN 155701383 AND 156030895
                 ELSE FALSE END)))
  GROUP BY 1, 2),
rates AS (
  SELECT *, CASE WHEN x_called > 0 THEN x_het / x_called ELSE 0.0 END AS h,
    CASE WHEN assay = 'array' THEN CASE WHEN y_total > 0 THEN y_called / y_total ELSE 0.0 END
         ELSE CASE WHEN x_called > 0 THEN y_called / x_called ELSE 0.0 END END AS y
  FROM tallies),
sexes AS (
  SELECT kit, CASE WHEN x_called < 10 THEN 'uncertain'
    WHEN assay = 'array' THEN CASE WHEN y_total > 0 AND h <= 0.03 AND y >= 0.5 THEN 'male'
      WHEN h >= 0.08 AND (y_total = 0 OR y <= 0.2) THEN 'female' ELSE 'uncertain' END
    ELSE CASE WHEN h <= 0.25 AND y >= 0.02 THEN 'male' WHEN h >= 0.4 AND y < 0.01 THEN 'female' ELSE 'uncertain' END
    END AS sex,
    floor(h * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS x_het_rate,
    floor(y * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS y_call_rate,
    x_called AS x_sites, y_total AS y_sites
  FROM rates)"""


@query("q_sex_inference", f"{V.with_views(V.CALLS, V.KITS, SEX_VIEWS)} SELECT * FROM sexes")
def sex_inference(spark, sf):
    tallies = summary.sex_tallies(D.calls(spark, sf), D.kits(spark))
    return summary.infer_sex(tallies).select("kit", "sex", "x_het_rate", "y_call_rate", "x_sites", "y_sites")


@query(
    "q_caveats",
    f"""{V.with_views(V.CALLS, V.KITS, SEX_VIEWS)},
homs AS (SELECT kit, count(*) FILTER (zygosity = 'hom') AS hom FROM g_calls GROUP BY kit)
SELECT k.kit, concat_ws(' | ',
  CASE WHEN ref_calls = 'absent-means-ref' THEN 'only variants are listed: hom_ref counts listed records, and every other site stands for the reference'
       WHEN ref_calls = 'explicit' AND source_format = 'gvcf' THEN 'reference blocks count in hom_ref, one for each block' END,
  CASE WHEN assay = 'array' THEN 'an array tests chosen SNPs: nothing is known of other sites' END,
  CASE WHEN assay = 'array' AND hom > 0 THEN 'no reference letter for ' || hom || ' homozygous array calls outside the coordinate table, counted as hom_unknown_ref' END,
  CASE WHEN build = 'unknown' THEN 'without a known build there is no PAR exclusion and no liftover' END,
  CASE WHEN sex = 'uncertain' THEN 'sex is uncertain: x_het_rate ' || regexp_replace(CAST(x_het_rate AS VARCHAR), '\\.0$', '')
    || ', y_call_rate ' || regexp_replace(CAST(y_call_rate AS VARCHAR), '\\.0$', '') || ', ' || x_sites || ' X sites outside the PAR' END) AS caveats
FROM g_kits k JOIN homs USING (kit) JOIN sexes USING (kit)""",
)
def caveats(spark, sf):
    calls, kits = D.calls(spark, sf), D.kits(spark)
    sexes = summary.infer_sex(summary.sex_tallies(calls, kits))
    rows = summary.caveats(summary.zygosity_counts(calls), sexes, kits)
    return rows.select("kit", F.array_join("caveats", " | ").alias("caveats"))


@query(
    "q_summary_report",
    f"""{V.with_views(V.CALLS, V.KITS, SEX_VIEWS)}
SELECT c.kit, c.records, c.het, c.hemizygous, c.chrom_1, c.mt, c.other_contigs, s.sex FROM (
  SELECT kit, count(*) AS records, {ZYGOSITY_SQL}, count(*) FILTER (chrom = '1') AS chrom_1,
    count(*) FILTER (chrom = 'MT') AS mt, count(*) FILTER (contig_ord IS NULL) AS other_contigs
  FROM g_calls GROUP BY kit) c JOIN sexes s USING (kit)""",
)
def summary_report(spark, sf):
    rows = summary.summarize(D.calls(spark, sf), D.kits(spark))
    pick = [("1", "chrom_1"), ("MT", "mt"), ("other_contigs", "other_contigs")]
    return rows.select(
        "kit", "records", "het", "hemizygous", *[F.col("by_chrom")[k].alias(n) for k, n in pick], F.col("sex.call").alias("sex")
    )


@query(
    "q_has_rsids",
    f"""{V.with_views(V.CALLS)} SELECT kit, count(*) AS records, count(*) FILTER (rsid LIKE 'rs%') AS rsid_records,
count(*) > 0 AND 2 * count(*) FILTER (rsid LIKE 'rs%') >= count(*) AS has_rsids FROM g_calls GROUP BY kit""",
)
def has_rsids_query(spark, sf):
    return summary.kit_counts(D.calls(spark, sf))


@query(
    "q_ref_calls_policy",
    """WITH s AS (SELECT s_suppkey, ['array', 'wgs', 'wes'][CAST(s_suppkey % 3 AS INT) + 1] AS assay,
  ['23andme', 'vcf', 'gvcf', 'ftdna'][CAST(s_suppkey % 4 AS INT) + 1] AS source_format, s_suppkey % 5 = 0 AS derived,
  CASE WHEN s_suppkey % 11 = 0 THEN 'absent-means-ref' END AS asked FROM supplier)
SELECT s_suppkey, coalesce(asked, CASE WHEN assay = 'array' OR source_format = 'gvcf' THEN 'explicit' WHEN derived THEN 'unknown'
  WHEN assay = 'wgs' THEN 'absent-means-ref' ELSE 'unknown' END) AS ref_calls,
  s_suppkey > 0 AND 2 * (s_suppkey % 7) >= s_suppkey AS has_rsids FROM s""",
)
def ref_calls(spark, sf):
    k = F.col("s_suppkey")

    def one_of(values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))

    s = D.table(spark, sf, "supplier").select(
        k,
        one_of(["array", "wgs", "wes"], 3).alias("assay"),
        one_of(["23andme", "vcf", "gvcf", "ftdna"], 4).alias("source_format"),
        (k % 5 == 0).alias("derived"),
        F.when(k % 11 == 0, F.lit("absent-means-ref")).alias("asked"),
    )
    return s.select(
        k, ref_calls_policy("assay", "source_format", "derived", "asked").alias("ref_calls"), has_rsids(k, k % 7).alias("has_rsids")
    )


@query(
    "q_contig_order",
    f"""{V.with_views(V.CALLS)},
others AS (SELECT kit, chrom, 25 + row_number() OVER (PARTITION BY kit ORDER BY min(src_ord), chrom) AS n
           FROM g_calls WHERE contig_ord IS NULL GROUP BY kit, chrom)
SELECT c.kit, c.chrom, coalesce(c.contig_ord, o.n)::INT AS contig_ord, count(*) AS n, min(c.pos) AS first_pos
FROM g_calls c LEFT JOIN others o ON o.kit = c.kit AND o.chrom = c.chrom GROUP BY 1, 2, 3""",
)
def contig_order(spark, sf):
    calls = ordering.with_contig_order(D.calls(spark, sf))
    return calls.groupBy("kit", "chrom", "contig_ord").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
