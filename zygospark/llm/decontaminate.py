"""Benchmark decontamination: suffix arrays of the training shards, searched for every test suffix."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospark.llm.rows import long_id, map_rows, written
from zygospark.llm.text import ALNUM, Words, covered, find_words, slices, words_of

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 32 << 20  # test texts whose words are sent to the executors at once

SPANS = "array<struct<item_id:long,item_start:int,doc_start:int,length:int>>"


def build_index(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> dict:
    """Words of the test items by number, and every test suffix that can begin a window."""
    texts = pa.array([t for _, t in items], pa.large_string())
    hashes, first, words = [np.zeros(0, np.uint64)], [0], []
    for _, w in words_of(texts, ALNUM, lower=True):
        hashes.append(w.hashes)
        first += (w.first[1:] + first[-1]).tolist()
        words += w.span(0, len(w.hashes))
    vocabulary, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    bounds = np.array(first)
    item = np.repeat(np.arange(len(items)), np.diff(bounds))
    ends = bounds[item + 1]
    at = np.arange(len(ids))
    depth = np.minimum(ends - bounds[item], window)
    usable = at + depth <= ends
    return {
        "names": [i for i, _ in items],
        "words": words,
        "vocabulary": vocabulary,
        "ids": np.concatenate((ids + 1, np.zeros(window, np.int64))).astype(np.int64),
        "first": bounds,
        "item": item,
        "starts": at[usable],
        "depth": depth[usable],
        "window": window,
    }


def word_ids(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Number from 1 of each word in the ascending vocabulary, 0 if it has none."""
    out = np.zeros(len(hashes), np.int64)
    if len(vocabulary):
        near = np.zeros(1 << 16, bool)
        near[vocabulary >> np.uint64(48)] = True
        maybe = np.flatnonzero(near[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
        same = vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same] + 1
    return out


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of `ids` (0: end of a stretch) whose suffixes begin with a word, sorted to `depth` words by prefix doubling."""
    at = np.flatnonzero(ids)
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[:-1] = ids
    h = 1
    while True:
        ahead = rank[np.minimum(at + h, len(ids))] if h > 1 or depth > 1 else np.zeros(len(at), np.int64)
        key = rank[at] * (rank.max() + 1) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        h *= 2
        new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) if len(at) else np.zeros(0, bool)
        if h >= depth or new.all():
            return at[order]
        rank[at[order]] = np.cumsum(new)


def _compare(text: np.ndarray, places: np.ndarray, query: np.ndarray, starts: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: training suffix below, equal to or above the test suffix, to the given depths."""
    out = np.zeros(len(places), np.int64)
    for j in range(int(depth.max(initial=0))):
        step = np.sign(text[np.minimum(places + j, len(text) - 1)] - query[starts + j])
        out = np.where((out == 0) & (j < depth), step, out)
    return out


def search(text: np.ndarray, array: np.ndarray, query: np.ndarray, starts: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix, the range of the suffix array that begins with its first `depth` words."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(array))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            order = _compare(text, array[np.minimum(mid, len(array) - 1)], query, starts, depth)
            right = open_ & ((order <= 0) if upper else (order < 0))
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


def shard_matches(words: Words, index: dict) -> np.ndarray:
    """(text, first word in the text, item, first word in the item, length) of all longest verbatim matches, as rows.

    Only stretches of known words at least as long as the shortest window are
    sorted: no other suffix can begin like a test suffix.
    """
    none = np.zeros((0, 5), np.int64)
    if not len(index["starts"]) or not len(words.hashes):
        return none
    ids = word_ids(words.hashes, index["vocabulary"])
    apart = np.zeros(len(ids) + len(words) + 1, np.int64)  # one 0 after each text
    place = np.arange(len(ids)) + words.doc_of()
    apart[place] = ids
    breaks = np.flatnonzero(apart == 0)
    lengths = np.diff(np.concatenate(([-1], breaks))) - 1
    long = lengths >= int(index["depth"].min())
    stretch = np.repeat(long, lengths)
    text = apart.copy()
    text[np.flatnonzero(apart)[~stretch]] = 0
    deepest = int(np.diff(index["first"]).max())
    array = suffix_array(text, deepest)
    if not len(array):
        return none
    query, starts, depth = index["ids"], index["starts"], index["depth"]
    lo, hi = search(text, array, query, starts, depth)
    n = hi - lo
    which = np.repeat(np.arange(len(starts)), n)
    at = array[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    q, item = starts[which], index["item"][starts[which]]
    first, end = index["first"][item], index["first"][item + 1]
    longer = (q > first) & (at > 0) & (text[at - 1] == query[q - 1]) & (text[at - 1] > 0)
    at, q, item, first, end, length = (x[~longer] for x in (at, q, item, first, end, depth[which]))
    length = length.copy()
    active = np.arange(len(at))
    while len(active):
        more = (q[active] + length[active] < end[active]) & (text[at[active] + length[active]] == query[np.minimum(q[active] + length[active], len(query) - 1)])
        active = active[more]
        length[active] += 1
    doc = np.searchsorted(breaks_of(words), at, "right")
    start = at - doc  # among all words of the shard
    same = np.array([words.span(s, s + k) == index["words"][x : x + k] for s, x, k in zip(start.tolist(), q.tolist(), length.tolist(), strict=True)], bool)
    return np.stack((doc, start - words.first[doc], item, q - first, length), 1)[same] if len(at) else none


def breaks_of(words: Words) -> np.ndarray:
    """Places of the ends of the texts among words with one place after each text."""
    return words.first[1:] + np.arange(len(words))


def _spans(index: dict | Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index if isinstance(index, dict) else index.value
    names = np.array([-1 if i is None else i for i in index["names"]], np.int64)
    unnamed = np.array([i is None for i in index["names"]], bool)
    for batch in batches:
        for at, data, offsets in slices(batch["text"], SHARD_BYTES):
            words = find_words(data, offsets, ALNUM, lower=True)
            rows = shard_matches(words, index)
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
            ends = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
            fields = [pa.array(names[rows[:, 2]], pa.int64(), mask=unnamed[rows[:, 2]] if len(rows) else None)]
            fields += [pa.array(rows[:, k].astype(np.int32)) for k in (3, 1, 4)]
            spans = pa.StructArray.from_arrays(fields, ["item_id", "item_start", "doc_start", "length"])
            hit = np.zeros(len(words), np.int64)
            for d in np.unique(rows[:, 0]):
                some = rows[ends[d] : ends[d + 1]]
                hit[d] = covered(some[:, 1], some[:, 4], int(words.counts[d])).sum()
            yield pa.record_batch(
                [
                    batch["doc_id"].slice(at, len(words)),
                    pa.array(words.counts, pa.int64()),
                    pa.array(hit),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
                ],
                names=["doc_id", "n_words", "n_hit", "spans"],
            )


def _block_count(items: DataFrame) -> int:
    size = items.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return -(-size // BLOCK_BYTES) or 1


def _blocks(items: DataFrame, blocks: int, window: int) -> Iterator[Broadcast]:
    """Indexes of the test items, in blocks of bounded size; one is alive at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = items.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in own.collect()], window))
        yield index
        if blocks > 1:  # the only one is used by the caller's own run
            index.destroy()


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, spans) of every row of docs against the test items (item_id, text).

    Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased.
    spans are the longest verbatim matches of at least `window` words, or of
    the whole item where it is shorter: item_id, first word in the item and in
    the document, length.  n_hit words lie in some span.

    Every slice of the documents is a shard with a suffix array of its own,
    sorted by prefix doubling; every test suffix is searched in every shard.
    Nothing is shuffled.  Test items beyond 32 MB of text are searched in
    blocks, one after another, each adding its spans to every row, so that what is
    sent for one block stays bounded.  Words
    are compared by number; matches are then compared as bytes.

    Null and empty texts have no words and match nothing; a null item_id keeps
    its hits and has a null id.  Repeated rows are judged alike.
    """
    docs = long_id(docs)
    schema = f"doc_id long, n_words long, n_hit long, spans {SPANS}"
    blocks = _block_count(items)
    if blocks == 1:
        return docs.mapInArrow(partial(_spans, next(_blocks(items, 1, window))), schema)
    found = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "spans": F.array().cast(SPANS)})
    for index in _blocks(items, blocks, window):
        found = written(found.mapInArrow(partial(_more_spans, index), f"doc_id long, text string, n_words long, n_hit long, spans {SPANS}"))
    return found.drop("text")


def _more_spans(index: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with this block's spans after those of the blocks before."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = pa.Table.from_batches(list(_spans(index, [batch])))
        old = batch["spans"]
        new = found["spans"].combine_chunks().cast(old.type)
        row = np.concatenate([np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())) for x in (old, new)])
        spans = pa.concat_arrays([old.flatten(), new.flatten()]).take(pa.array(np.argsort(row, kind="stable")))
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
        n_words, hit = found["n_words"].to_numpy(), np.zeros(batch.num_rows, np.int64)
        starts, lengths = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("doc_start", "length"))
        for d in np.flatnonzero(np.diff(ends)):
            some = slice(ends[d], ends[d + 1])
            hit[d] = covered(starts[some], lengths[some], int(n_words[d])).sum()
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
        yield pa.record_batch([batch["doc_id"], batch["text"], pa.array(n_words), pa.array(hit), lists], names=["doc_id", "text", "n_words", "n_hit", "spans"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs."""
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"].cast("string"))))
    ids = F.filter(ids, lambda i: i.isNotNull())
    found = matches(docs, items, window).withColumn("ids", ids)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a benchmark window, all columns kept."""
    for index in _blocks(items, _block_count(items), window):
        docs = written(map_rows(docs, "text", partial(_clean, index)))
    return docs


def _clean(index: Broadcast, text: pa.Array, columns: list[pa.Array]) -> list[pa.Array]:
    keep = np.ones(len(text), bool)
    for at, data, offsets in slices(text, SHARD_BYTES):
        keep[at + np.unique(shard_matches(find_words(data, offsets, ALNUM, lower=True), index.value)[:, 0])] = False
    return [c.filter(pa.array(keep)) for c in columns]
