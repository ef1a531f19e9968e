"""Repeated passages: k-word edges of a De Bruijn graph, compacted into paths, verified at their source coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b, sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.llm.rows import by_group, long_id, packed, packed_schema, shuffle_groups, unpacked, written
from zygospark.llm.text import Words, covered, grams, mix, words_of

K = 20  # words of an edge; its nodes are its first and last K - 1
ANCHOR = 5  # words of a minimizer
REACH = K - ANCHOR + 1  # minimizer places in an edge

RUN = {"key": np.uint64, "doc": np.int64, "start": np.int64, "flag": np.uint8}
EDGE = {"h": np.uint64, "doc": np.int64, "start": np.int64}
PATH = {"p_doc": np.int64, "p_start": np.int64, "p_n": np.int64, "p_src": np.int64, "p_from": np.int64}
PATH_ROWS = "doc_id long, start long, n long, src_id long, src_start long"
ALONE, SHARED, KNOWN = 0, 1, 2


def minimizer_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive edges with one minimizer place: (minimizer, text, first edge, edges).

    Equal edges have equal minimizers, so only runs whose minimizer is met
    twice can hold a repeated edge.
    """
    values, _, begins = grams(words.hashes, words.first, ANCHOR)
    counts = np.maximum(words.counts - K + 1, 0)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    low = np.uint64((1 << 20) - 1)
    best = (values & ~low) | (np.arange(len(values), dtype=np.uint64) & low)
    width = 1
    while width < REACH:  # smallest of `width` neighbours, doubled
        step = min(width, REACH - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    edge_doc = np.repeat(np.arange(len(words)), counts)
    first_edge = np.concatenate(([0], np.cumsum(counts)))
    start = np.arange(first_edge[-1]) - np.repeat(first_edge[:-1], counts)
    at = start + begins[edge_doc]
    place = at + ((best[at] - at.astype(np.uint64)) & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (edge_doc[1:] != edge_doc[:-1])
    heads = np.flatnonzero(new)
    return values[place[heads]], edge_doc[heads], start[heads], np.diff(np.append(heads, len(at)))


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether null) of an id column."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _steps(values: np.ndarray, to: np.ndarray, groups: int) -> np.ndarray:
    """Values as differences inside each packed group, which shuffles compress well."""
    order = np.argsort(to, kind="stable")
    sorted_ = values[order]
    out = np.empty_like(values)
    step = np.diff(sorted_, prepend=0)
    heads = np.searchsorted(to[order], np.arange(groups))
    heads = heads[heads < len(values)]
    step[heads] = sorted_[heads]
    out[order] = step
    return out


def _pack(columns: dict[str, np.ndarray], to: np.ndarray, groups: int, names: list[str]) -> pa.RecordBatch:
    columns = {c: _steps(v, to, groups) if v.dtype == np.int64 else v for c, v in columns.items()}
    rows = packed(to.astype(np.uint64), columns, groups)
    return pa.record_batch([rows[c] if c in columns or c == "p" else pa.nulls(len(rows), pa.binary()) for c in names], names=names)


def _unsteps(table: pa.Table, name: str) -> np.ndarray:
    parts = [np.cumsum(np.frombuffer(x.as_buffer(), np.int64)) for chunk in table[name].chunks for x in chunk if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _columns(table: pa.Table, kinds: dict) -> list[np.ndarray]:
    valid = table.filter(table[next(iter(kinds))].is_valid())
    return [_unsteps(valid, c) if kind is np.int64 else unpacked(valid, c, kind) for c, kind in kinds.items()]


def _send_runs(groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimizers of every run.  Of one met twice in a batch only one goes to the minimizer's group; the rest are known and go anywhere."""
    for batch in batches:
        ids, null = _ids(batch["doc_id"])
        parts = []
        for at, words in words_of(batch["text"]):
            key, doc, start, _ = minimizer_runs(words)
            parts.append((key, doc + at, start))
        if not parts:
            continue
        key, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
        use = ~null[doc]
        key, doc, start = key[use], ids[doc[use]], start[use]
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        more = np.diff(np.append(np.flatnonzero(new), len(key))) > 1
        flag = np.full(len(key), KNOWN, np.uint8)
        flag[order[new]] = np.where(more, SHARED, ALONE)
        to = np.where(flag == KNOWN, mix(doc.astype(np.uint64), 31), key) % np.uint64(groups)
        yield _pack({"key": key, "doc": doc, "start": start, "flag": flag}, to.astype(np.int64), groups, ["p", *RUN])


def _shared_runs(table: pa.Table) -> pa.Table:
    """Runs whose minimizer is met again."""
    key, doc, start, flag = _columns(table, RUN)
    own = np.flatnonzero(flag != KNOWN)
    order = own[np.argsort(key[own], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    hit = flag > ALONE
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return pa.table({"doc_id": doc[hit], "start": start[hit]})


def _paths(doc: np.ndarray, start: np.ndarray, src: np.ndarray, src_start: np.ndarray) -> list[np.ndarray]:
    """Edges with their first occurrence, compacted where both move on by one word."""
    order = np.lexsort((start, doc))
    doc, start, src, src_start = doc[order], start[order], src[order], src_start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (src[1:] != src[:-1]) | (src_start[1:] != src_start[:-1] + 1)
    heads = np.flatnonzero(new)
    return [doc[heads], start[heads], np.diff(np.append(heads, len(doc))), src[heads], src_start[heads]]


def _first_and_rest(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first occurrences of the edges, other occurrences, their first ones), as indexes."""
    order = np.lexsort((start, doc, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    # rows that repeat a document meet their own coordinates; those are not earlier
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else order
    rest = ~new & ((doc[order] != doc[first]) | (start[order] != start[first]))
    return order[new], order[rest], first[rest]


def _send_edges(groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of shared runs to their minimizer's group; an edge met earlier in the batch is sent as part of a path instead."""
    names = ["p", *EDGE, *PATH]
    for batch in batches:
        ids, _ = _ids(batch["doc_id"])
        lists = batch["runs"]
        wanted_doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        wanted = lists.flatten().to_numpy(zero_copy_only=False)
        wanted_at = np.searchsorted(wanted_doc, np.arange(len(ids) + 1))
        parts = []
        for at, words in words_of(batch["text"]):
            key, doc, start, n = minimizer_runs(words)
            long = int(words.counts.max(initial=0)) + 1
            here = slice(wanted_at[at], wanted_at[at + len(words)])
            take = np.isin(doc * long + start, (wanted_doc[here] - at) * long + wanted[here])
            key, doc, start, n = key[take], doc[take], start[take], n[take]
            edges, _, begins = grams(words.hashes, words.first, K)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, start, key = np.repeat(doc, n), np.repeat(start, n) + step, np.repeat(key, n)
            parts.append((key, edges[begins[doc] + start], ids[doc + at], start))
        if not parts:
            continue
        key, h, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(4))
        first, rest, source = _first_and_rest(h, doc, start)
        first.sort()
        if len(first):
            yield _pack({"h": h[first], "doc": doc[first], "start": start[first]}, (key[first] % np.uint64(groups)).astype(np.int64), groups, names)
        if len(rest):
            path = _paths(doc[rest], start[rest], doc[source], start[source])
            to = (mix(path[0].astype(np.uint64), 32) % np.uint64(groups)).astype(np.int64)
            yield _pack(dict(zip(PATH, path, strict=True)), to, groups, names)


def _repeated_paths(table: pa.Table) -> pa.Table:
    """Paths of repeated edges of one group of minimizers."""
    h, doc, start = _columns(table, EDGE)
    _, rest, source = _first_and_rest(h, doc, start)
    found = _paths(doc[rest], start[rest], doc[source], start[source])
    known = _columns(table, PATH)
    return pa.table({c: np.concatenate((a, b)) for c, a, b in zip(("doc_id", "start", "n", "src_id", "src_start"), found, known, strict=True)})


def _glued(paths: DataFrame) -> DataFrame:
    """Paths joined where one ends at the edge at which the next begins, in the document and at the source."""
    in_doc = W.partitionBy("doc_id").orderBy("start")
    ends = lambda c: F.lag(F.col(c) + F.col("n")).over(in_doc)
    goes_on = (ends("start") == F.col("start")) & (ends("src_start") == F.col("src_start")) & (F.lag("src_id").over(in_doc) == F.col("src_id"))
    marked = paths.withColumn("path", F.when(goes_on, 0).otherwise(1))
    marked = marked.withColumn("path", F.sum("path").over(in_doc))
    head = [F.min(c).alias(c) for c in ("start", "src_start")]
    return marked.groupBy("doc_id", "path").agg(*head, F.sum("n").alias("n"), F.min("src_id").alias("src_id")).drop("path")


def repeated_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n, src_id, src_start): n edges from word `start` whose first occurrences lie in order at the source.

    Equality is that of 64-bit edge hashes; `remove_repeats` verifies the words.
    """
    docs = long_id(docs)
    groups = shuffle_groups(docs)
    runs = docs.mapInArrow(partial(_send_runs, groups), packed_schema(RUN))
    shared = by_group(runs, _shared_runs, "doc_id long, start long")
    shared = shared.groupBy("doc_id").agg(F.collect_set("start").alias("runs"))
    edges = docs.join(shared, "doc_id").mapInArrow(partial(_send_edges, groups), packed_schema({**EDGE, **PATH}))
    return _glued(by_group(edges, _repeated_paths, PATH_ROWS).distinct())


def _digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, own array<struct<start:long,n:long,digest:binary>>, asked array<struct<start:long,n:long,digest:binary>>"


def _remove(with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without its repeated paths, and digests of the paths and of the places others were found at."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, own, asked in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "own", "asked")), strict=True):
            words = (text or "").encode().split()
            own = [(p["start"], p["n"] + K - 1) for p in own or ()]
            keep = words
            if own:
                span = np.array(own, np.int64).reshape(-1, 2)
                keep = list(compress(words, ~covered(span[:, 0], span[:, 1], len(words))))
            joined = b" ".join(keep)
            sums = [
                [{"start": s, "n": n - K + 1, "digest": _digest(words[s : s + n])} for s, n in spans]
                for spans in (own, [(p["start"], p["n"] + K - 1) for p in asked or ()])
            ]
            out.append((doc, len(words), len(words) - len(keep), sha256(joined).hexdigest(), joined.decode() if with_text else None, *sums))
        entry = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), entry, entry]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "own", "asked"]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _applied(docs: DataFrame, paths: DataFrame, with_text: bool) -> DataFrame:
    own = paths.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("own"))
    asked = paths.select(F.col("src_id").alias("doc_id"), F.col("src_start").alias("start"), "n").distinct()
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    wanted = own.join(asked, "doc_id", "full")
    return docs.join(wanted, "doc_id", "left").select("doc_id", "text", "own", "asked").mapInArrow(partial(_remove, with_text), REMOVED)


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text) of every row: words covered by a 20-word window that starts earlier are removed.

    Earlier is a smaller doc_id, or an earlier start in the same document.
    Windows are judged on the input; kept words are joined by one space.

    Method: every 20-word window is an edge of a De Bruijn graph.  Edges are
    dealt by their minimizer (the smallest of their 5-word hashes), and only
    those whose minimizer is met twice travel at all.  In a minimizer's group
    each edge gets its first source coordinate, and unbranched stretches, where
    document and source move on together, are compacted; paths that continue
    in another group are glued by document.  Last, the words of every path are
    compared with those at its source by 128-bit digests, and paths that differ
    (hash collisions) are taken back.

    A passage that many documents share, or a large group of copies, is first
    reduced inside each batch: only the batch's first occurrence is sent on to
    the passage's group.  Each text is read three times and shuffled twice.

    Null and empty texts have no words.  Rows with a null doc_id are left
    whole and count as nobody's source.  Rows that repeat a doc_id are one
    document to each other: none is earlier than the other.
    """
    docs = long_id(docs)
    paths = written(repeated_paths(docs))
    done = written(_applied(docs, paths, with_text))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else [])]
    mine = done.select("doc_id", F.explode("own").alias("o")).select("doc_id", "o.start", "o.n", F.col("o.digest").alias("mine"))
    theirs = done.select(F.col("doc_id").alias("src_id"), F.explode("asked").alias("o")).select(
        "src_id", F.col("o.start").alias("src_start"), "o.n", F.col("o.digest").alias("theirs")
    )
    same = paths.join(mine, ["doc_id", "start", "n"]).join(theirs, ["src_id", "src_start", "n"])
    wrong = written(same.filter("mine <> theirs").select("doc_id", "start").distinct())
    if wrong.isEmpty():
        return done.select(*columns)
    again = wrong.select("doc_id").distinct()
    right = paths.join(again, "doc_id", "left_semi").join(wrong, ["doc_id", "start"], "left_anti")
    redone = _applied(docs.join(again, "doc_id", "left_semi"), right, with_text)
    return done.join(again, "doc_id", "left_anti").select(*columns).unionByName(redone.select(*columns))
