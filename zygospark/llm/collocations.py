"""Phrase collocations, counted by prefix-free parsing.

A piece (a text between marks) is cut wherever the hash of OVERLAP consecutive
words hits a trigger, and every chunk carries the OVERLAP words of the trigger
that ends it, with which the next one begins.  Chunks depend on content alone, so
passages that repeat give the same chunks.  The dictionary holds each distinct
chunk once with its frequency; phrases are counted inside its chunks, weighted.
A phrase belongs to the chunk in which it starts before the overlap: phrases of
up to OVERLAP + 1 words that start there also end there, so each is counted once.

Phrases are counted level by level: one can be frequent only if its parts are.
Levels are thinned by bit filters over hashes of frequent phrases, whose size is
bounded (fuller filters thin less, nothing is lost), and the counts that decide
are taken over the phrases' own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.llm.rows import written
from zygospark.llm.text import LOWER, STEP, mix, slices, span_hash, sums

LONGEST = 5  # words of a phrase
OVERLAP = LONGEST - 1
SPACING = 48  # one in so many places is a trigger
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases of a language
FILTER_BITS = 27  # largest bit filter: 16 MB
BITS_PER_PHRASE = 16
TOKENS = 1 << 21  # words counted together in a task before they are sent

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False

CHUNKS = "lang string, last boolean, chunk string, weight long"


class _Tokens:
    """Words of lower-cased texts, written one after another with one space after each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = _WORD[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        bounds = offsets[offsets < n]
        begin[bounds] |= inside[bounds]
        cut = bounds[bounds > 0] - 1
        end[cut] |= inside[cut]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        lengths = ends - starts
        self.text_of = np.searchsorted(offsets, starts, "right") - 1
        breaks = np.cumsum(np.append(_BREAK[data], False))
        self.begins = np.ones(len(starts), bool)  # whether a word begins a piece
        self.begins[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (self.text_of[1:] != self.text_of[:-1])
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.starts + lengths
        self.bytes = np.full(len(starts) + int(lengths.sum()), 0x20, np.uint8)
        keep = inside[:n]
        self.bytes[np.arange(int(keep.sum())) + np.repeat(np.arange(len(starts)), lengths)] = data[keep]
        self.running = sums(self.bytes)
        self.hashes = span_hash(self.running, self.starts, self.ends)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as strings; spans may overlap."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])]).cast(pa.string())


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; windows that run over the end are cut off."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * STEP + hashes[j : j + n]
    return mix(out, k)


def _weighted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, place of the first of each, sum of weights)."""
    distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, of, weights)
    return distinct, first, out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to chunks; equal ones of a run of texts are one row."""
    for batch in batches:
        langs = batch["lang"].to_numpy(zero_copy_only=False)
        _, lang_no = np.unique(langs.astype(str), return_inverse=True)
        for at, data, offsets in slices(batch["text"]):
            t = _Tokens(data, offsets)
            n = len(t.hashes)
            if not n:
                continue
            piece = np.cumsum(t.begins) - 1
            trigger = np.zeros(n, bool)
            windows = _rolled(t.hashes, OVERLAP)
            whole = piece[: len(windows)] == piece[OVERLAP - 1 :] if len(windows) else np.zeros(0, bool)
            trigger[: len(windows)] = whole & (windows % np.uint64(SPACING) == 0)
            first = np.flatnonzero(t.begins | trigger)
            after = np.append(first[1:], n)
            goes_on = np.append(~t.begins[first[1:]], False)  # the next chunk is of the same piece
            stop = np.where(goes_on, after + OVERLAP, after)
            chunk = span_hash(t.running, t.starts[first], t.ends[stop - 1])
            text = at + t.text_of[first]
            key = mix(chunk ^ mix(lang_no[text].astype(np.uint64) * np.uint64(2) + goes_on, 9))
            _, rows, weight = _weighted(key, np.ones(len(key), np.int64))
            columns = [pa.array(langs[text[rows]]), pa.array(~goes_on[rows]), _strings(t.bytes, t.starts[first[rows]], t.ends[stop[rows] - 1]), pa.array(weight)]
            yield pa.record_batch(columns, names=["lang", "last", "chunk", "weight"])


class _Chunks:
    """Words of dictionary chunks: hashes that tell languages apart, own places, weights."""

    def __init__(self, batch: pa.RecordBatch, at: int, data: np.ndarray, offsets: np.ndarray, lang_hash: np.ndarray):
        texts = len(offsets) - 1
        space = np.flatnonzero(data == 0x20)
        first = np.searchsorted(space, offsets[:-1]) + np.arange(texts)  # number of each chunk's first word
        n = len(space) + texts
        self.data = data
        self.starts = np.zeros(n, np.int64)
        self.ends = np.zeros(n, np.int64)
        is_first = np.zeros(n, bool)
        is_first[first] = True
        self.starts[is_first], self.starts[~is_first] = offsets[:-1], space + 1
        is_last = np.zeros(n, bool)
        is_last[np.append(first[1:], n) - 1] = True
        self.ends[is_last], self.ends[~is_last] = offsets[1:], space
        sizes = np.diff(np.append(first, n))
        self.chunk = np.repeat(np.arange(texts), sizes)
        own = sizes - np.where(batch["last"].to_numpy(zero_copy_only=False)[at : at + texts], 0, OVERLAP)
        place = np.arange(n) - first[self.chunk]
        self.own = place < own[self.chunk]
        self.left = sizes[self.chunk] - place  # words from here to the chunk's end
        self.weight = batch["weight"].to_numpy()[at : at + texts]
        self.lang = lang_hash[at : at + texts]
        self.hashes = span_hash(sums(data), self.starts, self.ends)

    def keys(self, k: int) -> np.ndarray:
        """Hash of the k words from each place on, with the language; where they do not fit, any value."""
        rolled = _rolled(self.hashes, k)
        return mix(rolled ^ self.lang[self.chunk[: len(rolled)]], 31)

    def starts_of(self, k: int) -> np.ndarray:
        """Places where a phrase of k words is counted."""
        n = max(len(self.hashes) - k + 1, 0)
        return self.own[:n] & (self.left[:n] >= k)


def _frequent(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the filter holds keys; what it does not hold is not frequent."""
    size = np.uint64(len(bits) * 8)
    out = np.ones(len(keys), bool)
    for h in (keys % size, (keys >> np.uint64(32)) % size):
        out &= (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def _allowed(c: _Chunks, k: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the phrases of k words all of whose parts may be frequent, and themselves where a filter says so."""
    keys = c.keys(k)
    ok = c.starts_of(k)
    for part in range(1, min(k, len(filters)) + 1):
        if part < min(k, len(filters)) and part < k - 1:
            continue  # implied by the longer parts
        at = np.flatnonzero(ok)
        inner = c.keys(part)
        for shift in range(k - part + 1):
            at = at[_frequent(inner[at + shift], filters[part - 1])]
        ok = np.zeros(len(ok), bool)
        ok[at] = True
    at = np.flatnonzero(ok)
    return at, keys[at]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, _Chunks]]:
    for batch in batches:
        lang_hash = np.array([hash_text(x) for x in batch["lang"].to_pylist()], np.uint64)
        for at, data, offsets in slices(batch["chunk"], 8 << 20):
            yield batch, at, _Chunks(batch, at, data, offsets, lang_hash)


_langs: dict[str, int] = {}


def hash_text(text: str) -> int:
    """A word's hash as the parser gives it; kept, since languages are few."""
    if text not in _langs:
        data = np.frombuffer(text.encode() or b" ", np.uint8)
        _langs[text] = int(span_hash(sums(data), np.array([0]), np.array([len(data)]))[0])
    return _langs[text]


def _count_hashes(k: int, sent: Broadcast):
    """(key, n) of the phrases of k words whose parts may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, held = [], [], 0
        for _, _, c in _runs(batches):
            at, key = _allowed(c, k, sent.value)
            keys.append(key)
            weights.append(c.weight[c.chunk[at]])
            held += len(at)
            if held > TOKENS:
                yield _sums(keys, weights)
                keys, weights, held = [], [], 0
        if held:
            yield _sums(keys, weights)

    return run


def _sums(keys: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
    distinct, _, n = _weighted(np.concatenate(keys), np.concatenate(weights))
    return pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(n)], names=["key", "n"])


def _count_phrases(sizes: tuple[int, ...], sent: Broadcast | None):
    """(lang, k, phrase, n) of phrases that may be frequent, by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, c in _runs(batches):
            for k in sizes:
                at, keys = _allowed(c, k, sent.value if sent else [])
                _, rows, n = _weighted(keys, c.weight[c.chunk[at]])
                at = at[rows]
                langs = batch["lang"].take(pa.array(first + c.chunk[at]))
                phrases = _strings(c.data, c.starts[at], c.ends[at + k - 1])
                yield pa.record_batch([langs, pa.array(np.full(len(at), k, np.int32)), phrases, pa.array(n)], names=["lang", "k", "phrase", "n"])

    return run


def _bit_filter(keys: DataFrame) -> np.ndarray:
    """Two bits of each key in a bitmap of at most 2 ** FILTER_BITS bits, built by the executors."""
    bits = min(FILTER_BITS, max(18, (keys.count() * BITS_PER_PHRASE).bit_length()))
    size = 1 << bits
    low = F.col("key").bitwiseAND(size - 1)
    high = F.shiftrightunsigned("key", 32).bitwiseAND(size - 1)
    spots = keys.select(F.explode(F.array(low, high)).alias("h"))
    # Buckets of 32,768 bits are numbered from 1; position 0 of bucket 1 is value 1.
    spots = spots.select((F.col("h") + 1).alias("v"))
    maps = spots.groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m")).collect()
    out = np.zeros((size >> 3) + 4096, np.uint8)
    for r in maps:  # at most 2 ** FILTER_BITS bits in all
        part = np.frombuffer(bytes(r.m), np.uint8)
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(part)] = part
    return out[: size >> 3]


def phrase_counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): (lang, k, phrase, f) of all phrases of 1 to LONGEST words that occur `least` times or more, and (lang, n) words of each lang."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    chunks = texts.mapInArrow(_parse, CHUNKS).groupBy("lang", "last", "chunk").agg(F.sum("weight").alias("weight"))
    chunks = written(chunks)
    schema = "lang string, k int, phrase string, n long"
    words = chunks.mapInArrow(_count_phrases((1,), None), schema).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f"))
    words = written(words)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.filter(F.col("f") >= least)
    keys = written(words.select("lang", "phrase").mapInArrow(_word_keys, "key long"))
    filters = [_bit_filter(keys)]
    for k in range(2, LONGEST - 1):
        sent = spark.sparkContext.broadcast(list(filters))
        counted = chunks.mapInArrow(_count_hashes(k, sent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        filters.append(_bit_filter(written(counted.filter(F.col("n") >= least).select("key"))))
        sent.destroy()
    sent = spark.sparkContext.broadcast(filters)
    longer = chunks.mapInArrow(_count_phrases(tuple(range(2, LONGEST + 1)), sent), schema).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f"))
    longer = written(longer.filter(F.col("f") >= least))
    sent.destroy()
    return words.unionByName(longer), totals


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of single words, as chunks give them."""
    for batch in batches:
        lang = np.array([hash_text(x) for x in batch["lang"].to_pylist()], np.uint64)
        for at, data, offsets in slices(batch["phrase"]):
            hashes = span_hash(sums(data), offsets[:-1], offsets[1:])
            yield pa.record_batch([pa.array(mix(_rolled(hashes, 1) ^ lang[at : at + len(hashes)], 31).view(np.int64))], names=["key"])


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The `top` highest-scoring phrases of 2 to LONGEST words of each lang: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z) and cut at marks and line ends into pieces, pieces
    at spaces and tabs into words.  A candidate occurs `least` times or more (a);
    its score is the lowest over its cuts into two parts, floor(1000 * a * n / (l * r)),
    with l and r the occurrences of the parts and n the words of the lang; of equal
    cuts the first counts.  Candidates inside a longer one that occurs as often are
    left out.  Ties: score, then a, then the phrase by its bytes.

    A null lang is `und`; null and empty texts have no words; a long text is parsed
    whole.  Repeated rows count each time, an empty table gives no rows, other
    columns are ignored.
    """
    counts, totals = phrase_counts(documents, least)
    candidates = counts.filter("k >= 2")
    parts = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "k", F.col("f").alias("a"), parts.alias("w"), cut)
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("_l"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("_r")
    )
    part = counts.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("_l"), F.col("f").alias("l")), ["lang", "_l"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    cuts = cuts.join(totals, "lang")
    # Exact: the products stay within 38 digits, and the quotient within a long.
    above = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(16,0)") * F.col("n").cast("decimal(16,0)")
    below = F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    cuts = cuts.withColumns({"_above": above, "_below": below}).withColumn("score", F.expr("_above div _below"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    size = F.size("w")
    spans = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = candidates.filter("k >= 3").select("lang", "f", parts.alias("w")).filter(size >= 3).select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    kept = scored.join(covered, ["lang", "phrase"], "left").filter(F.col("_f").isNull() | (F.col("_f") < F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
