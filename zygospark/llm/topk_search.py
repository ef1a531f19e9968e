"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into `lists` runs, and every run gives each row a
local score: its part of the inner product.  Phase one gathers the best entries
of every local list; the k-th best whole score among them is a cutoff that at
least k rows reach.  Phase two sends the cutoffs back: a row that reaches the
cutoff has at least one local score of cutoff / lists or more, so only entries
above that uniform share are collected.  Phase three adds the remaining local
scores of just these entries and keeps the k best.

Queries go to the rows in passes of at most QUERY_BYTES; vectors are read from
packed blocks, a task holds one block, one tile of scores and k entries a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.llm.rows import written

SCALE = 256
QUERY_BYTES = 16 << 20  # packed query vectors of one pass
BLOCK_ROWS = 4096
TILE = 1024  # queries and rows of one tile of scores
LIMIT = 1 << 62  # components are held within this
EXACT = 1 << 53  # sums below it are exact in floating point
HIGHEST = (1 << 63) - 3  # scores are held between -HIGHEST and HIGHEST
LOWEST = -HIGHEST - 1

PACKED = "n int, dim int, ids binary, uids binary, asked binary, comps binary"
ENTRIES = "query int, vec_id long, uid long, score long"


def whole_components(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components floor(SCALE * x) padded with zeros to the longest)."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0)), 0)
    flat = column.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.zeros(len(sizes), bool)
    bad[of[~np.isfinite(values)]] = True
    rows = np.flatnonzero(np.asarray(column.is_valid()) & ~bad)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    begins = np.cumsum(sizes) - sizes
    with np.errstate(all="ignore"):
        scaled = np.floor(values * SCALE)
    whole = np.where(np.abs(scaled) < LIMIT, scaled, np.sign(scaled) * float(LIMIT))
    out[of, np.arange(len(of)) - begins[of]] = np.where(np.isfinite(whole), whole, 0).astype(np.int64)
    return rows, out[rows]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding, uid, asked) to blocks of whole vectors."""
    for batch in batches:
        for lo in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            rows, comps = whole_components(part["embedding"])
            if not len(rows):
                continue
            ids = part["vec_id"].fill_null(LIMIT).to_numpy(zero_copy_only=False)[rows]
            asked = np.asarray(part["asked"].fill_null(False))[rows]
            uids = part["uid"].to_numpy(zero_copy_only=False)[rows]
            cells = [len(rows), comps.shape[1], ids.astype(np.int64).tobytes(), uids.astype(np.int64).tobytes(), asked.tobytes(), comps.tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=["n", "dim", "ids", "uids", "asked", "comps"])


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, uids, asked, comps) of one block."""
    n, dim = batch["n"][i].as_py(), batch["dim"][i].as_py()
    ids, uids = (np.frombuffer(batch[c][i].as_buffer(), np.int64) for c in ("ids", "uids"))
    asked = np.frombuffer(batch["asked"][i].as_buffer(), bool)
    return ids, uids, asked, np.frombuffer(batch["comps"][i].as_buffer(), np.int64).reshape(n, dim)


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, uid, comps) of the vectors that are asked."""
    for batch in batches:
        for i in range(len(batch)):
            ids, uids, asked, comps = _unpack(batch, i)
            at = np.flatnonzero(asked)
            if len(at):
                yield pa.record_batch(
                    [pa.array(ids[at]), pa.array(uids[at]), pa.array([comps[j].tobytes() for j in at], pa.binary())], names=["vec_id", "uid", "comps"]
                )


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums fit, else as Python numbers."""
    if queries.shape[1] == 0:
        return np.zeros((len(queries), len(rows)))
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * queries.shape[1]
    if reach < EXACT:
        return queries.astype(np.float64) @ rows.T.astype(np.float64)
    return queries.astype(object) @ rows.T.astype(object)


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; what is beyond stays at the end of the range."""
    return (np.clip(scores, -HIGHEST, HIGHEST) if scores.dtype == object else scores).astype(np.int64)


class _Best:
    """The k best entries (score, vec_id, uid) of every query seen so far in a task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), LOWEST, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.uids = np.full((queries, k), -1, np.int64)

    def floor(self) -> np.ndarray:
        """The k-th best score of each query."""
        return self.scores[:, -1]

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Entries in any number; ties go to the smaller vec_id, an entry seen before changes nothing."""
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate((np.repeat(touched, self.k), query))
        scores = np.concatenate((self.scores[touched].ravel(), _held(scores)))
        ids = np.concatenate((self.ids[touched].ravel(), ids))
        uids = np.concatenate((self.uids[touched].ravel(), uids))
        order = np.lexsort((uids, ids, ~scores, query))  # ~score falls as the score rises, without overflow
        same = np.zeros(len(order), bool)
        q, u = query[order], uids[order]
        same[1:] = (q[1:] == q[:-1]) & (u[1:] == u[:-1]) & (u[1:] >= 0)
        order = order[~same]
        q = query[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = order[place < self.k]
        at = (query[top], place[place < self.k])
        self.scores[at], self.ids[at], self.uids[at] = scores[top], ids[top], uids[top]

    def batch(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.uids >= 0)
        cells = (self.ids[query, place], self.uids[query, place], self.scores[query, place])
        return pa.record_batch([pa.array(query.astype(np.int32)), *map(pa.array, cells)], names=["query", "vec_id", "uid", "score"])


def _tiles(asked: np.ndarray, asked_uids: np.ndarray, batch: pa.RecordBatch, lists: int) -> Iterator[tuple]:
    """(first query, local scores of each list, own places, ids, uids) of every tile of a batch of blocks."""
    for i in range(len(batch)):
        ids, uids, _, comps = _unpack(batch, i)
        dim = max(comps.shape[1], asked.shape[1])
        cuts = [dim * j // lists for j in range(lists + 1)]
        wide = np.zeros((len(comps), dim), np.int64)
        wide[:, : comps.shape[1]] = comps
        ask = np.zeros((len(asked), dim), np.int64)
        ask[:, : asked.shape[1]] = asked
        for lo in range(0, len(wide), TILE):
            for q in range(0, len(ask), TILE):
                rows, some = wide[lo : lo + TILE], ask[q : q + TILE]
                own = asked_uids[q : q + TILE, None] == uids[None, lo : lo + TILE]
                local = [_products(some[:, a:b], rows[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield q, local, own, ids[lo : lo + TILE], uids[lo : lo + TILE]


def _whole(local: list[np.ndarray], query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sums of the local scores of some entries."""
    return _held(sum(part[query, row] for part in local))


def _kth(part: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest local score of each query in a tile; own rows may be among the k counted, so one more is taken."""
    if part.shape[1] <= k + 1 or part.dtype == object:
        return np.full(len(part), LOWEST)
    return np.partition(part, -k - 1, axis=1)[:, -k - 1]


def _gather(sent: Broadcast, k: int, lists: int):
    """Phase one: the k best entries of every local list of a task, with their whole scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, asked_uids, _ = sent.value
        tops = [_Best(len(asked), k) for _ in range(lists)]
        best = _Best(len(asked), k)
        for batch in batches:
            for q, local, own, ids, uids in _tiles(asked, asked_uids, batch, lists):
                for part, top in zip(local, tops, strict=True):
                    least = np.maximum(top.floor()[q : q + len(part)], _kth(part, k))
                    query, row = np.nonzero((part >= least[:, None]) & ~own)
                    top.add(query + q, part[query, row], ids[row], uids[row])
                    best.add(query + q, _whole(local, query, row), ids[row], uids[row])
        yield best.batch()

    return run


def _collect(sent: Broadcast, cut: Broadcast, k: int, lists: int):
    """Phases two and three: entries above the uniform share of the cutoff, their whole scores, the k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, asked_uids, _ = sent.value
        cutoff = cut.value
        best = _Best(len(asked), k)
        for batch in batches:
            for q, local, own, ids, uids in _tiles(asked, asked_uids, batch, lists):
                least = np.maximum(cutoff[q : q + len(own)], best.floor()[q : q + len(own)])
                share = -(-least // lists) if lists > 1 else least  # the largest of the lists' scores reaches it
                reached = reduce(np.logical_or, (part >= share[:, None] for part in local))
                reached = (reached | (least <= -HIGHEST)[:, None]) & ~own
                query, row = np.nonzero(reached)
                score = _whole(local, query, row)
                enough = score >= least[query]
                best.add(query[enough] + q, score[enough], ids[row[enough]], uids[row[enough]])
        yield best.batch()

    return run


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, lists: int = 2) -> DataFrame:
    """The k rows with the highest inner product for each query row, over every other row.

    `vectors` has vec_id and embedding (array of numbers), `is_query` marks the
    rows that ask.  Returns (query_id, rank from 1, vec_id, score); ties go to the
    smaller vec_id.  Components count as floor(256 * x), held within 62 bits;
    scores are held within 63.

    Rows without a vector and vectors with a null or non-finite component take no
    part.  Shorter vectors count as filled up with zeros.  A repeated row is a
    row of its own: it asks for itself, and its twin is a candidate.  A row without
    vec_id never asks; it may be found, after all others in a tie, with a null
    vec_id.  Fewer candidates than k give fewer rows, an empty table none.  Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asked"))
    rows = rows.withColumn("asked", F.col("asked") & F.col("vec_id").isNotNull())
    blocks = written(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_pack, PACKED))
    asked = written(blocks.mapInArrow(_queries, "vec_id long, uid long, comps binary"))
    size = asked.agg(F.sum(F.length("comps") + 16)).first()[0] or 0
    passes = max(1, -(-size // QUERY_BYTES))
    found = []
    for number in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(passes)) == number).orderBy("uid").toArrow()  # at most about QUERY_BYTES
        comps = [np.frombuffer(c.as_buffer(), np.int64) for chunk in some["comps"].chunks for c in chunk]
        table = np.zeros((len(comps), max(map(len, comps), default=0)), np.int64)
        for at, c in enumerate(comps):
            table[at, : len(c)] = c
        ids = some["vec_id"].to_numpy()
        sent = spark.sparkContext.broadcast((table, some["uid"].to_numpy(), ids))
        gathered = blocks.mapInArrow(_gather(sent, k, lists), ENTRIES)
        cutoff = np.full(len(ids), LOWEST, np.int64)
        kth = _ranked(gathered, k).filter(F.col("rank") == k).select("query", "score").toArrow()
        cutoff[kth["query"].to_numpy()] = kth["score"].to_numpy()
        cut = spark.sparkContext.broadcast(cutoff)
        names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids), dtype=np.int32)), "query_id": pa.array(ids, pa.int64())}))
        top = _ranked(blocks.mapInArrow(_collect(sent, cut, k, lists), ENTRIES), k)
        found.append(written(top.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")))
        cut.destroy()
        sent.destroy()
    out = reduce(DataFrame.union, found)
    return out.withColumn("vec_id", F.nullif("vec_id", F.lit(LIMIT)))
