"""Mixing sources to target weights: whole copies of each document plus one seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospark.llm.rows import written
from zygospark.operators.ordering import rank_rows
from zygospark.session import checked_broadcast

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
SHARE = (3, 2)  # the mix is 3/2 of all sizes
MOST = 2  # times its source's size that a target may be
SEED = "mix-1"
BROADCAST_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Water filling: the budget is shared by weight; sources above their bound
    stop there and the rest is shared anew until none is above.  Only the
    level (two whole numbers) comes to the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rank_rows(sources, [F.col("source").asc_nulls_last()], "at")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    total, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = "decimal(38,0)"
    stopped, light = 0, 0
    while True:
        above_by = SHARE[0] * total - SHARE[1] * MOST * stopped  # the budget left, times SHARE[1]
        below_by = SHARE[1] * (weights - light)
        above = F.col("weight").cast(wide) * F.lit(above_by).cast("decimal(20,0)") > F.col("source_size").cast("decimal(20,0)") * F.lit(MOST * below_by).cast(wide)
        now = ranked.filter(above).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if tuple(now) == (stopped, light):
            break
        stopped, light = now
    shared = (F.col("weight") * F.lit(above_by)).cast("double") / F.lit(float(below_by or 1))
    target = F.when(above, (F.col("source_size") * MOST).cast("double")).otherwise(shared)
    return ranked.select("source", "source_size", target.alias("target"))


def copies(doc_id: Column, target: Column, source_size: Column, seed: str = SEED) -> Column:
    """floor(rate) plus one with the fraction's probability, drawn from a hash of the id: the same in every run."""
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def _with_targets(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """`rows` (with _source) beside their source's target; few sources are broadcast, else a hot one is split by adaptive execution."""
    goals = checked_broadcast(goals, BROADCAST_SOURCES).withColumnsRenamed({"source": "_goal"})
    return rows.join(goals, F.col("_source").eqNullSafe(F.col("_goal"))).drop("_goal")


def mix_counts(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs.

    size is the number of words, source_size and target are its source's sums.
    Sources in code point order, null last, weigh 5, 2, 1, repeating, and share
    150 % of all sizes, at most twice their own.  Each document is taken
    floor(target / source_size) times and once more with the fraction's
    probability.

    Native expressions only.  Sizes are computed once and summed per source
    before the shuffle.  Null and empty texts have size 0; a source without
    words has target 0 and takes none.  Null doc_ids share one draw, as do
    rows that repeat a doc_id.
    """
    source = F.col("source").cast("string").alias("source")
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source, size_of(F.col("text").cast("string")).alias("size")))
    rows = _with_targets(sizes.withColumnRenamed("source", "_source"), targets(sizes))
    n = copies(F.col("doc_id"), F.col("target"), F.col("source_size"), seed).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents: every row as often as `mix_counts` says, all columns kept, `copy_no` from 1 behind them."""
    names = [*docs.columns, "copy_no"]
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    column = {c: F.col(f"_{docs.columns.index(c)}") for c in ("doc_id", "text", "source")}
    source = column["source"].cast("string")
    sizes = written(plain.select(source.alias("source"), size_of(column["text"].cast("string")).alias("size")))
    rows = _with_targets(plain.withColumn("_source", source), targets(sizes))
    n = copies(column["doc_id"].cast("long"), F.col("target"), F.col("source_size"), seed).cast("int")
    rows = rows.withColumn("_n", n).filter("_n > 0")
    return rows.select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no")).toDF(*names)


#: The same as `mix_counts`, for the table `documents`; the level is found from running sums in the order in which sources reach their bound.
COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s),
o AS (
  SELECT *, coalesce(sum(source_size) OVER p, 0)::BIGINT AS before, (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::BIGINT AS left_weight,
    sum(source_size) OVER ()::BIGINT AS total, row_number() OVER (ORDER BY 2.0 * source_size / weight, place) AS turn
  FROM w WINDOW p AS (ORDER BY 2.0 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT 3 * total - 4 * before AS num, 2 * left_weight AS den FROM o
  WHERE weight * (3 * total - 4 * before) <= 2 * source_size * 2 * left_weight ORDER BY turn LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN weight * num > 2 * source_size * den THEN (2 * source_size)::DOUBLE ELSE (weight * num)::DOUBLE / den::DOUBLE END AS target
  FROM w, level),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
"""

MIX_COUNTS_SQL = COUNTS_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"
