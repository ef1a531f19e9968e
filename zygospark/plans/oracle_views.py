"""SQL text of the derived views, for the checking engine only."""

CONTIG = (
    "CASE {0} WHEN 0 THEN 'hs37d5' WHEN 26 THEN 'GL000192.1' WHEN 23 THEN 'X' WHEN 24 THEN 'Y'"
    " WHEN 25 THEN 'MT' ELSE CAST({0} AS VARCHAR) END"
)


def contig(expr: str) -> str:
    return CONTIG.format(expr)


CALLS = f"""
g_base AS (
  SELECT l_suppkey % 4 + 1 AS kn, CAST(l_partkey % 27 AS INT) AS cm, l_partkey AS pk,
         CAST(l_quantity AS BIGINT) AS q, l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln
  FROM lineitem),
g_rows AS (
  SELECT 'k' || CAST(kn AS VARCHAR) AS kit, ok * 10 + ln AS src_ord, {contig("cm")} AS chrom,
    CASE WHEN cm BETWEEN 1 AND 25 THEN cm END AS contig_ord,
    1 + (pk - pk % 27) // 27 * 40000 + q * 100 AS pos,
    CASE WHEN kn = 2 OR (kn > 2 AND pk % 2 = 1) THEN NULL
         WHEN (pk + q) % 10 = 0 THEN 'i' || CAST(pk * 100 + q AS VARCHAR)
         ELSE 'rs' || CAST(pk * 100 + q AS VARCHAR) END AS rsid,
    substr('ACGT', CAST((pk + q) % 4 + 1 AS INT), 1) AS r,
    substr('ACGT', CAST((pk + q + 1 + pk % 3) % 4 + 1 AS INT), 1) AS a,
    CASE WHEN (ok + ln) % 10 < 4 THEN '0/1' WHEN (ok + ln) % 10 < 6 THEN '1/1' WHEN (ok + ln) % 10 < 8 THEN '0/0'
         WHEN (ok + ln) % 10 = 8 THEN './.' ELSE '1' END AS gt,
    CASE WHEN ok % 7 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter, CAST(ln * 10 AS FLOAT) AS quality, q + ln AS depth, kn
  FROM g_base),
g_calls AS (
  SELECT kit, src_ord, chrom, contig_ord, pos,
    CASE WHEN kn = 3 AND gt = '0/0' THEN pos + 250 ELSE pos END AS end_pos, rsid,
    CASE WHEN rsid LIKE 'rs%' THEN CAST(substr(rsid, 3) AS BIGINT) END AS rs_num,
    CASE WHEN kn = 1 THEN NULL ELSE r END AS ref, CASE WHEN kn = 1 THEN NULL ELSE a END AS alt,
    CASE gt WHEN '0/1' THEN r || a WHEN '1/1' THEN a || a WHEN '0/0' THEN r || r WHEN '1' THEN a ELSE '--' END AS genotype,
    CASE WHEN kn = 1 THEN NULL ELSE gt END AS gt,
    CASE WHEN gt = '0/1' THEN 'het' WHEN gt = './.' THEN 'no_call' WHEN gt = '1' THEN 'hemi' WHEN kn = 1 THEN 'hom'
         WHEN gt = '1/1' THEN 'hom_alt' ELSE 'hom_ref' END AS zygosity,
    CASE WHEN kn = 1 THEN NULL ELSE filter END AS filter, CASE WHEN kn = 1 THEN NULL ELSE quality END AS quality,
    CASE WHEN kn = 1 THEN NULL ELSE depth END AS depth, COALESCE(kn = 3 AND gt = '0/0', FALSE) AS ref_block
  FROM g_rows)"""

KITS = """
g_kits AS (
  SELECT * FROM (VALUES
    ('k1', '23andme', 'array', 'GRCh37', 'explicit'),
    ('k2', 'vcf', 'wgs', 'GRCh38', 'absent-means-ref'),
    ('k3', 'gvcf', 'wgs', 'GRCh38', 'explicit'),
    ('k4', 'vcf', 'wes', 'GRCh38', 'unknown')) AS v(kit, source_format, assay, build, ref_calls))"""

CHAIN = f"""
g_parts AS (
  SELECT p_partkey AS blk, {contig("CAST(p_partkey % 27 AS INT)")} AS chrom,
         (p_partkey - p_partkey % 27) // 27 * 40000 AS t_start, CAST(p_size AS BIGINT) AS p_size FROM part),
g_chain AS (
  SELECT blk, chrom AS t_chrom, t_start, t_start + 3000 AS t_end, chrom AS q_chrom,
         CASE WHEN blk % 5 = 0 THEN 300000000 - (t_start + 5000) ELSE t_start + 200 END AS q_start,
         300000001 AS q_size, blk % 5 = 0 AS q_neg, p_size AS score FROM g_parts
  UNION ALL
  SELECT 1000000 + blk, chrom, t_start, t_start + 4000, chrom, t_start + 300, 300000001, FALSE, 60 - p_size
  FROM g_parts WHERE p_size % 7 = 0)"""

COORDS = """
g_coords AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'GRCh38' ELSE 'GRCh37' END AS build, p_partkey * 100 + 25 AS rs_num,
         'rs' || CAST(p_partkey * 100 + 25 AS VARCHAR) AS rsid,
         CASE CAST(p_partkey % 27 AS INT) WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'MT'
              ELSE CAST(p_partkey % 27 AS VARCHAR) END AS chrom,
         CAST(p_partkey % 27 AS INT) AS contig_ord,
         1 + (p_partkey - p_partkey % 27) // 27 * 40000 + 2500 AS pos,
         substr('ACGT', CAST((p_partkey + 25) % 4 + 1 AS INT), 1) AS ref,
         substr('ACGT', CAST((p_partkey + 26 + p_partkey % 3) % 4 + 1 AS INT), 1) AS alt
  FROM part WHERE p_partkey % 27 BETWEEN 1 AND 25)"""


def lift(points: str, name: str) -> str:
    """CTE with the best hit per point row (needs a unique pid, chrom, pos)."""
    return f"""
{name}_hits AS (
  SELECT p.pid, c.q_chrom AS lifted_chrom,
    1 + CASE WHEN c.q_neg THEN c.q_size - 1 - (c.q_start + greatest(p.pos - 1, 0) - c.t_start)
             ELSE c.q_start + greatest(p.pos - 1, 0) - c.t_start END AS lifted_pos,
    c.q_neg AS reverse, c.score, c.t_start, c.blk,
    row_number() OVER (PARTITION BY p.pid ORDER BY c.score DESC, c.t_start DESC, c.blk DESC) AS best
  FROM {points} p JOIN g_chain c ON p.chrom = c.t_chrom
    AND greatest(p.pos - 1, 0) >= c.t_start AND greatest(p.pos - 1, 0) < c.t_end),
{name} AS (
  SELECT p.*, h.lifted_chrom, h.lifted_pos, h.reverse
  FROM {points} p LEFT JOIN {name}_hits h ON p.pid = h.pid AND h.best = 1)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views)
