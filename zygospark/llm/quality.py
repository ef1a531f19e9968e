"""Quality rules with thresholds that adapt to each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.llm.rows import long_id, written
from zygospark.llm.text import find_words, grams, mix, slices, span_hash, sums
from zygospark.session import checked_broadcast

GAMMA = 1.02  # a sketch bucket holds values within 1 % of its middle
LEAST_ROWS = 100  # a smaller group takes the merged sketch of its language, then of all
SPREAD = 3.0
#: metric -> (least distance of a threshold from the median, whether low values fail as well)
RULES = {"word_length": (1.25, True), "symbols": (0.1, False), "dup_lines": (0.4, False), "repeats": (0.4, False)}
LOW, MIDDLE, HIGH = 0.1, 0.5, 0.9

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def count_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text."""
    words = find_words(data, offsets)
    docs = len(words)
    rise = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    letters = rise((data & 0xC0) != 0x80)
    chars = rise(letters[words.ends] - letters[words.starts])
    symbols = rise(_SYMBOL[data])

    feeds = np.flatnonzero(data == 10)
    begins, ends = np.sort(np.concatenate((offsets[:-1], feeds + 1))), np.sort(np.concatenate((feeds, offsets[1:])))
    line_doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(feeds, offsets)) + 1)
    spoken = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    key = mix(span_hash(sums(data), begins, ends) ^ mix(line_doc.astype(np.uint64), 21))[spoken]
    line_doc = line_doc[spoken]
    _, where = np.unique(key, return_index=True)
    lines = np.bincount(line_doc, minlength=docs)
    dups = lines - np.bincount(line_doc[where], minlength=docs)

    hashes, at, begin = grams(words.hashes, words.first, 3)
    key = hashes ^ mix(np.repeat(np.arange(docs), np.diff(begin)).astype(np.uint64), 22)
    order = np.argsort(key)
    twin = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    inside = np.zeros(len(words.hashes) + 2, bool)
    for j in range(3):
        inside[at[again] + j] = True
    repeats = rise(inside)
    per = lambda run, cut: run[cut[1:]] - run[cut[:-1]]
    return [words.counts, per(chars, words.first), per(symbols, offsets), lines, dups, per(repeats, words.first)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in slices(batch["text"]):
            n = len(offsets) - 1
            own = [batch[c].slice(at, n) for c in ("doc_id", "lang", "source")]
            yield pa.record_batch([*own, *(pa.array(x, pa.int64()) for x in count_texts(data, offsets))], names=["doc_id", "lang", "source", *COUNTS])


def _metrics() -> dict[str, Column]:
    words, lines = F.col("n_words").cast("double"), F.col("n_lines").cast("double")
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
    }


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketch of (metric, value) rows by keys: counts of logarithmic buckets; null is the bucket of 0."""
    bucket = F.when(F.col("value") > 0, F.ceil(F.ln("value") / F.lit(float(np.log(GAMMA)))).cast("int"))
    return rows.groupBy(*keys, "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up over all keys but these."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, rows, lo, mid, hi) of each sketch; a window holds one sketch's buckets, a few hundred."""
    own = W.partitionBy(*keys, "metric")
    up = own.orderBy(F.col("bucket").asc_nulls_first())
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (GAMMA + 1)))
    ranked = sketches.select(*keys, "metric", value.alias("v"), F.sum("n").over(up).alias("upto"), F.sum("n").over(own).alias("rows"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), F.col("v")))
    return ranked.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), at(LOW).alias("lo"), at(MIDDLE).alias("mid"), at(HIGH).alias("hi"))


def thresholds(counts: DataFrame) -> DataFrame:
    """(lang, source, <metric>_min, <metric>_max) of each pair among the counted rows that pass the base rules."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in _metrics().items())))
    rows = counts.filter(~F.col("base_failed")).select("lang", "source", pairs.alias("m")).select("lang", "source", "m.*")
    fine = written(sketch(rows, ["lang", "source"]))
    by_lang = merge(fine, ["lang"])
    levels = [
        quantiles(fine, ["lang", "source"]),
        quantiles(by_lang, ["lang"]).withColumnRenamed("lang", "l1"),
        quantiles(merge(by_lang, []), []),
    ]
    names = ("rows", "lo", "mid", "hi")
    a, b, c = (q.select(*(x for x in q.columns if x not in names), F.struct(*names).alias(f"q{i}")) for i, q in enumerate(levels))
    joined = a.join(b.withColumnRenamed("metric", "m1"), a["lang"].eqNullSafe(F.col("l1")) & (a["metric"] == F.col("m1")))
    joined = joined.join(c, "metric")
    q = F.when(F.col("q0.rows") >= LEAST_ROWS, F.col("q0")).when(F.col("q1.rows") >= LEAST_ROWS, F.col("q1")).otherwise(F.col("q2"))
    joined = joined.select("lang", "source", "metric", q.alias("q"))
    columns = []
    for name, (least, both) in RULES.items():
        mine = F.col("metric") == name
        up = F.col("q.mid") + F.greatest(F.lit(least), SPREAD * (F.col("q.hi") - F.col("q.mid")))
        down = F.col("q.mid") - F.greatest(F.lit(least), SPREAD * (F.col("q.mid") - F.col("q.lo")))
        columns.append(F.max(F.when(mine, up)).alias(f"{name}_max"))
        if both:
            columns.append(F.max(F.when(mine, down)).alias(f"{name}_min"))
    return joined.groupBy("lang", "source").agg(*columns)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) of every row.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows.  The others are held against thresholds of their language and
    source: the median plus 3 times the distance to the 90th percentile, or a
    least distance where that is more; word length also from below.  Quantiles
    come from mergeable sketches (counts of logarithmic buckets, 1 % exact);
    pairs with under 100 documents use their language's merged sketch, then
    the merged sketch of all.  `failed` names the first metric out of bounds.

    The text is read once; a hot source is only partial sums and a narrow join.
    Null and empty texts have no words and fail the base rule.  Null lang or
    source is a group of its own.  Repeated rows are judged and counted each.
    """
    docs = long_id(docs, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counts = written(docs.mapInArrow(_count, schema).withColumn("base_failed", failed))
    bounds = checked_broadcast(written(thresholds(counts)), 100_000)
    bounds = bounds.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = counts.join(bounds, counts["lang"].eqNullSafe(F.col("t_lang")) & counts["source"].eqNullSafe(F.col("t_source")), "left")
    reason = F.when(F.col("base_failed"), "base")
    for name, value in _metrics().items():
        out = value > F.col(f"{name}_max")
        if RULES[name][1]:
            out = out | (value < F.col(f"{name}_min"))
        reason = reason.when(out, name)
    columns = ["doc_id", *(c for c in COUNTS if c != "n_lines"), "base_failed"]
    return joined.select(*columns, reason.isNull().alias("kept"), reason.alias("failed"))
