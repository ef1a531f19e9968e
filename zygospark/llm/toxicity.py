"""Toxicity by the nearest labelled examples: exact cosine over a block-max inverted index.

Weights are TF-IDF times the term's relevance for the label.  Plain TF-IDF does not
give right results on long texts: chance words that two texts share weigh more
than the words that make one toxic (README, `op6_toxicity`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.llm.rows import by_group, long_id, map_rows, packed, packed_schema, shuffle_groups, unpacked, written
from zygospark.llm.text import ALNUM, find_words, slices

#: Labelled rows of each class (clean, toxic) that the model is fitted on at most: those with the smallest hash of their id.
FIT_ROWS = (3_000, 1_000)
FIT_BYTES = 24 << 20  # ... and bytes of the texts of each class
TWIN = 1 - 1e-9  # an example this near has the text's own vector, and does not vote on it
NEIGHBOURS = 15
BLOCK = 64  # examples of one block of the index
PRIOR = 0.05  # votes of the class share beside the neighbours' squared similarities
REJECT = 0.3
EVIDENCE = 3
SHRINK = 4.0  # rows of the fitted class mix that every term is given beside its own, for its odds
COMMON, MOST_COMMON = 12, 1024  # a term that one in so many examples holds is frequent, and how many of these are at most
CENTRES = 16  # examples that others are put beside
TOGETHER = 64  # texts compared at once
SCORED_TOGETHER = 512  # texts that are put into groups
SLACK = 1e-4  # more than sums of narrow products can be off

HELD = {"at": np.int64, "n": np.int64}

SCORED = "doc_id long, raw double, known boolean, evidence array<long>"


def learns(doc_id: Column) -> Column:
    """Rows whose labels may be learnt; null ids have no remainder and may not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of every word."""
    words = find_words(data, offsets, ALNUM, lower=True)
    return words.doc_of(), words.hashes


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic rows and rows that hold each term."""
    for batch in batches:
        toxic = batch["toxic"].to_numpy(zero_copy_only=False)
        for at, data, offsets in slices(batch["text"]):
            doc, term = text_terms(data, offsets)
            names, where = np.unique(term, return_inverse=True)
            codes = np.unique(doc * max(len(names), 1) + where)
            doc, where = codes // max(len(names), 1), codes % max(len(names), 1)
            bad = np.bincount(where, weights=toxic[doc + at], minlength=len(names)).astype(np.int64)
            every = np.bincount(where, minlength=len(names))
            yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(bad), pa.array(every)], names=["term", "bad", "n"])


def relevance(bad: np.ndarray, n: np.ndarray, toxic: int, rows: int) -> np.ndarray:
    """Factor of each term's weight, above 0 and 1 for a neutral term: log2 of 1 + the odds of the label with it over the fitted rows' odds.

    A ratio of odds does not depend on how many rows of either class are fitted.
    """
    share = toxic / rows
    with_term = (bad + SHRINK * share) / (n + SHRINK)
    return np.log2(1 + with_term / (1 - with_term) * (1 - share) / share)


def find_terms(terms: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each term in the ascending `known`, or -1."""
    if not len(known):
        return np.full(len(terms), -1, np.int64)
    names, where = np.unique(terms, return_inverse=True)
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return np.where(known[at] == names, at, -1)[where]


def _vectors(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of a known term, occurrences), once for each."""
    doc, term = text_terms(data, offsets)
    at = find_terms(term, known)
    size = max(len(known), 1)
    codes, n = np.unique((doc * size + at)[at >= 0], return_counts=True)
    return codes // size, codes % size, n


def _doc_counts(sent, groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task (at the place after the last term), and how many hold each known term, packed."""
    known = sent.value
    held = np.zeros(len(known) + 1, np.int64)
    for batch in batches:
        for _, data, offsets in slices(batch["text"]):
            held += np.bincount(_vectors(data, offsets, known)[1], minlength=len(held))
            held[-1] += len(offsets) - 1
    at = np.flatnonzero(held)
    if len(at):
        yield packed(at.astype(np.uint64), {"at": at, "n": held[at]}, groups)


def _add_up(table: pa.Table) -> pa.Table:
    at, where = np.unique(unpacked(table, "at", np.int64), return_inverse=True)
    return pa.table({"at": at, "n": np.bincount(where, weights=unpacked(table, "n", np.int64)).astype(np.int64)})


def _weights(doc: np.ndarray, n: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit length TF-IDF weights."""
    w = (1 + np.log(n)) * idf[at]
    length = np.sqrt(np.bincount(doc, weights=w * w)) if len(doc) else np.zeros(0)
    return w / length[doc]


def _examples(terms, weighs, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, idf = terms.value, weighs.value
    for batch in batches:
        for at, data, offsets in slices(batch["text"]):
            count = len(offsets) - 1
            doc, term, n = _vectors(data, offsets, known)
            weight = _weights(doc, n, term, idf)
            ends = pa.array(np.searchsorted(doc, np.arange(count + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term.astype(np.int32), weight)]
            own = [batch[c].slice(at, count) for c in ("doc_id", "toxic")]
            yield pa.record_batch([*own, *lists], names=["doc_id", "toxic", "terms", "weights"])


def class_weights(taken: tuple[int, int], every: tuple[int, int]) -> np.ndarray:
    """What a fitted row of each class (clean, toxic) stands for among all learnable labels; fitted rows stand for 1 on average."""
    rows = np.array(taken, np.float64)
    stands = np.where(rows > 0, np.array(every) / np.maximum(rows, 1), 1.0)
    return stands * rows.sum() / max((stands * rows).sum(), 1e-300) if rows.sum() else np.ones(2)


def build_index(examples: list[tuple[int, int, list[int], list[float]]], known: np.ndarray, idf: np.ndarray, stands: np.ndarray | None = None) -> dict:
    """The examples' vectors, one after another; with_postings() adds postings and each term's maxima in blocks of 64 examples.

    Examples with one and the same vector are one, with the share of toxic rows among them and what they stand for together.
    """
    stands = np.ones(2) if stands is None else stands
    examples = sorted(examples, key=lambda e: e[0])
    twins: dict[bytes, list] = {}
    for e in examples:
        twins.setdefault(np.asarray(e[2], np.int32).tobytes() + np.round(np.asarray(e[3], np.float64), 9).tobytes(), []).append(e)
    full = [group[0] for group in twins.values() if len(group[0][2])]
    groups = [group for group in twins.values() if len(group[0][2])]
    empty = [e for e in examples if not len(e[2])]
    sizes = np.array([len(e[2]) for e in full], np.int64)
    terms = np.concatenate([np.zeros(0, np.int32), *(np.asarray(e[2], np.int32) for e in full)])
    weights = np.concatenate([np.zeros(0), *(np.asarray(e[3], np.float64) for e in full)])
    share = lambda rows: (sum(stands[1] for e in rows if e[1]) + 0.5) / (sum(stands[e[1]] for e in rows) + 1)
    mass = np.array([sum(stands[e[1]] for e in group) for group in groups], np.float64)
    toxic = np.array([sum(stands[1] for e in group if e[1]) for group in groups], np.float64)
    return {
        "known": known,
        "idf": idf,
        "terms": terms,
        "weights": weights,
        "first": np.append(0, np.cumsum(sizes)),
        "ids": np.array([e[0] for e in full], np.int64),
        "toxic": toxic / np.maximum(mass, 1e-300),
        "mass": mass,
        "prior": share(examples) if examples else 0.0,
        "empty": share(empty) if empty else 0.0,
    }


def with_postings(index: dict) -> dict:
    """The index with its lists by term, made once in every process that it is sent to.

    Examples that are alike in their frequent terms lie together, so that blocks of 64
    have low maxima for the terms of others.  Lists of frequent terms are kept as rows
    over all examples, with each block's maximum; the others as postings.
    """
    if "dense" in index:
        return index
    n, terms, first, weights = len(index["ids"]), index["terms"], index["first"], index["weights"]
    held = np.bincount(terms, minlength=len(index["known"]))
    frequent = np.flatnonzero(held * COMMON >= max(n, 1))
    frequent = np.sort(frequent[np.argsort(-held[frequent], kind="stable")[:MOST_COMMON]])
    row = np.full(len(index["known"]), -1, np.int64)
    row[frequent] = np.arange(len(frequent))
    example = np.repeat(np.arange(n), np.diff(first))
    of_frequent = row[terms] >= 0
    rows = np.zeros((len(frequent), n))
    rows[row[terms[of_frequent]], example[of_frequent]] = weights[of_frequent]
    if n > BLOCK:
        centres = rows[:, np.linspace(0, n - 1, CENTRES).astype(np.int64)]
        order = np.argsort(np.argmax(centres.T @ rows, axis=0), kind="stable")
    else:
        order = np.arange(n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    blocks = -(-n // BLOCK)
    dense = np.zeros((len(frequent), blocks * BLOCK))
    dense[:, :n] = rows[:, order]
    del rows
    for name in ("terms", "weights", "first"):  # they are in the lists from here on
        index.pop(name)
    rare = ~of_frequent
    by_term = np.argsort(terms[rare], kind="stable")
    index.update(
        ids=index["ids"][order],
        toxic=index["toxic"][order],
        mass=index["mass"][order],
        row=row,
        dense=dense,
        narrow=dense.astype(np.float32),
        most=dense.reshape(len(frequent), blocks, BLOCK).max(2) if n else np.zeros((len(frequent), 0)),
        example=place[example[rare]][by_term],
        share=weights[rare][by_term],
        posted=np.searchsorted(terms[rare][by_term], np.arange(len(index["known"]) + 1)),
    )
    return index


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def nearest(index: dict, doc: np.ndarray, terms: np.ndarray, weights: np.ndarray, count: int, twins: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(examples, cosines) of the nearest examples of each text, exactly.

    Ties go to the smaller id; the text's own vector counts only with `twins`.
    Postings of rare terms are added up first.  What the frequent terms can still add
    is bounded by their maxima in each block, and only blocks that can hold one of the
    nearest are gone through.  Texts are taken in groups that are alike, so that these
    blocks are few; narrow sums choose candidates, whose cosines are computed whole.
    """
    index = with_postings(index)
    n, width, blocks = len(index["ids"]), index["dense"].shape[1], index["most"].shape[1]
    none = (np.zeros(0, np.int64), np.zeros(0))
    if not n:
        return [none] * count
    row = index["row"][terms]
    common = row >= 0
    own = np.zeros((count, len(index["dense"])))
    own[doc[common], row[common]] = weights[common]
    rare_doc, rare_term, rare_weight = doc[~common], terms[~common], weights[~common]
    bounds = np.searchsorted(rare_doc, np.arange(count + 1))
    above = own @ index["most"]
    order = np.argsort(np.argmax(above, axis=1), kind="stable")
    out = [none] * count
    wanted = NEIGHBOURS + 1
    for lo in range(0, count, TOGETHER):
        some = order[lo : lo + TOGETHER]
        at = _ranges(bounds[some], bounds[some + 1] - bounds[some])
        starts, sizes = index["posted"][rare_term[at]], index["posted"][rare_term[at] + 1] - index["posted"][rare_term[at]]
        posts = _ranges(starts, sizes)
        line = np.repeat(np.repeat(np.arange(len(some)), bounds[some + 1] - bounds[some]), sizes)
        sums = np.bincount(line * width + index["example"][posts], weights=np.repeat(rare_weight[at], sizes) * index["share"][posts], minlength=len(some) * width)
        sums = sums.reshape(len(some), width)
        peaks = sums.reshape(len(some), blocks, BLOCK).max(2)
        reach = peaks + above[some]
        # As many examples as are wanted, in blocks of their own, reach this much.
        least = np.partition(peaks, -wanted, axis=1)[:, -wanted] if blocks >= wanted else np.zeros(len(some))
        narrow = own[some].astype(np.float32)
        parts, chosen = [], np.unique(np.argmax(reach, axis=1))  # the best block of each text first: its cosines raise what others have to reach
        for _ in range(2):
            columns = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            parts.append((columns, narrow @ index["narrow"][:, columns] + sums[:, columns]))
            if len(columns) >= wanted:
                least = np.maximum(least, np.partition(parts[-1][1], -wanted, axis=1)[:, -wanted] - SLACK)
            rest = ((reach >= (least - SLACK)[:, None]) & (reach > 0)).any(0)
            rest[chosen] = False
            chosen = np.flatnonzero(rest)
            if not len(chosen):
                break
        columns = np.concatenate([c for c, _ in parts])
        cosines = np.concatenate([c for _, c in parts], axis=1)
        if len(parts) > 1 and len(columns) >= wanted:
            least = np.maximum(least, np.partition(cosines, -wanted, axis=1)[:, -wanted] - SLACK)
        for i, text in enumerate(some):
            found = columns[(cosines[i] >= least[i] - SLACK) & (cosines[i] > 0)]
            used = np.flatnonzero(own[text])
            near = sums[i, found] + own[text, used] @ index["dense"][np.ix_(used, found)]
            use = near > 0 if twins else (near > 0) & (near < TWIN)
            found, near = found[use], near[use]
            top = np.lexsort((index["ids"][found], -np.round(near, 12)))[:NEIGHBOURS]
            out[text] = found[top], near[top]
    return out


def _score(index: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(votes, whether any term is known, nearest examples) of each text."""
    count = len(offsets) - 1
    votes, evidence = np.full(count, index["empty"]), [[] for _ in range(count)]
    doc, term, n = _vectors(data, offsets, index["known"])
    weight = _weights(doc, n, term, index["idf"])
    found = []
    for lo in range(0, count, SCORED_TOGETHER):  # short texts are many in a slice
        some = slice(*np.searchsorted(doc, (lo, lo + SCORED_TOGETHER)))
        found += nearest(index, doc[some] - lo, term[some], weight[some], min(SCORED_TOGETHER, count - lo))
    known = np.bincount(doc, minlength=count) > 0
    for i in np.flatnonzero(known):
        at, cosines = found[i]
        power = cosines * cosines * index["mass"][at]
        votes[i] = (power @ index["toxic"][at] + PRIOR * index["prior"]) / (power.sum() + PRIOR)
        evidence[i] = index["ids"][at[:EVIDENCE]].tolist()
    return votes, known, evidence


def _score_batches(index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in slices(batch["text"]):
            votes, known, evidence = _score(index.value, data, offsets)
            columns = [batch["doc_id"].slice(at, len(votes)), pa.array(votes), pa.array(known), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "raw", "known", "evidence"])


def rising_steps(raw: np.ndarray, label: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, shares): the rising steps nearest to the labels; pooled where shares would fall."""
    order = np.argsort(raw, kind="stable")
    steps: list[list[float]] = []
    for x, y, n in zip(raw[order], label[order], stands[label[order].astype(np.int64)], strict=True):
        steps.append([x, y * n, n])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            _, s, c = steps.pop()
            steps[-1] = [steps[-1][0], steps[-1][1] + s, steps[-1][2] + c]
    return np.array([s[0] for s in steps]), np.array([(s[1] + 0.5) / (s[2] + 1) for s in steps])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, dict]:
    """The broadcast index and the calibration, from at most FIT_ROWS labelled rows of each class and the document counts of all documents."""
    docs = long_id(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(learns(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id"), F.col("doc_id")
    marks = written(marks.withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    every = dict(marks.groupBy("toxic").count().collect())
    taken = [marks.filter(F.col("toxic") == c).orderBy(*draw).limit(most) for c, most in enumerate(FIT_ROWS)]
    fitted = written(docs.join(F.broadcast(written(taken[0].union(taken[1]))), "doc_id"))  # at most FIT_ROWS of each class and their copies
    size = F.sum(F.octet_length("text")).over(W.partitionBy("toxic").orderBy(*draw, "text").rowsBetween(W.unboundedPreceding, -1))
    fitted = written(fitted.withColumn("_before", F.coalesce(size, F.lit(0))).filter(F.col("_before") < FIT_BYTES).drop("_before"))
    kept = dict(fitted.groupBy("toxic").agg(F.count_distinct("doc_id")).collect())
    stands = class_weights(tuple(kept.get(c, 0) for c in (0, 1)), tuple(every.get(c, 0) for c in (0, 1)))

    rows, toxic = fitted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    some = fitted if 0 < toxic < rows else fitted.limit(0)
    terms = some.mapInArrow(_class_counts, "term long, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).toArrow()
    known, bad, n = (terms[c].to_numpy() for c in ("term", "bad", "n"))
    order = np.argsort(known.view(np.uint64))
    known = known.view(np.uint64)[order]

    spark, groups = docs.sparkSession.sparkContext, shuffle_groups(docs)
    terms = spark.broadcast(known)
    held = docs.mapInArrow(partial(_doc_counts, terms, groups), packed_schema(HELD))
    held = by_group(held, _add_up, "at long, n long").toArrow()
    counts = np.zeros(len(known) + 1)
    counts[held["at"].to_numpy()] = held["n"].to_numpy()
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    idf = idf * relevance(bad[order], n[order], toxic, rows) if len(known) else idf
    weighs = spark.broadcast(idf)
    examples = fitted.mapInArrow(partial(_examples, terms, weighs), "doc_id long, toxic int, terms array<int>, weights array<double>").toArrow()
    vectors = [e for b in examples.to_batches() for e in zip(b["doc_id"].to_pylist(), b["toxic"].to_pylist(), _lists(b["terms"]), _lists(b["weights"]), strict=True)]
    model = build_index(vectors, known, idf, stands)
    del examples, vectors
    terms.destroy()
    weighs.destroy()
    index = docs.sparkSession.sparkContext.broadcast(model)
    votes = fitted.join(fitted.mapInArrow(partial(_score_batches, index), SCORED), "doc_id").filter("known").select("raw", "toxic").collect()
    raw, label = (np.array([r[i] for r in votes], np.float64) for i in (0, 1))
    steps, shares = rising_steps(raw, label, stands) if len(raw) else (np.zeros(1), np.array([model["prior"]]))
    return index, {"steps": steps, "shares": shares, "empty": model["empty"], "prior": model["prior"]}


def calibrated(model: dict, votes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(model["steps"], votes, "right") - 1, 0)
    return np.where(known, model["shares"][at], model["empty"])


def _calibrate(index, model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _score_batches(index, batches):
        score = calibrated(model, batch["raw"].to_numpy(), batch["known"].to_numpy(zero_copy_only=False))
        yield pa.record_batch([batch["doc_id"], pa.array(score), batch["evidence"]], names=["doc_id", "score", "evidence"])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of docs.

    Terms are words of lower-cased letters and digits.  The vector space holds all
    of the fitted rows, weighed by TF-IDF with document counts over all documents
    and by the label's odds with a term.  A text's 15 nearest examples by cosine vote
    with their squared similarity; votes are turned into shares of toxic rows on the
    examples themselves.  evidence lists the nearest examples.  predicted is 1 from
    a score of 0.3.  An example with the text's own vector never votes, so a fitted
    row is not judged by its own label, nor is a copy of it.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2, at
    most 3,000 clean and 1,000 toxic ones (FIT_ROWS) with at most 24 MB of text for
    each class (FIT_BYTES); the index is bounded by that and broadcast.  Both classes
    are counted over all these labels, and every fitted row weighs as many of them as
    it stands for, so shares and votes keep the class mix of all labels.  Scoring is
    one map over the texts, which are taken whole, without a shuffle.

    A text without a known term (null and empty texts too) gets the share of
    toxic rows among such examples.  Null labels are not learnt, a doc_id
    labelled twice is toxic if either says so, null doc_ids are scored and not
    held out.  Without labels of both classes every score is their share.
    Repeated rows are scored alike.
    """
    index, model = fit(docs, labels)
    scored = long_id(docs).mapInArrow(partial(_calibrate, index, model), "doc_id long, score double, evidence array<long>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.3, all columns kept."""
    index, model = fit(docs, labels)
    return map_rows(docs, "text", partial(_keep_clean, index, model))


def _keep_clean(index, model: dict, text: pa.Array, columns: list[pa.Array]) -> list[pa.Array]:
    keep = np.ones(len(text), bool)
    for at, data, offsets in slices(text):
        count = len(offsets) - 1
        votes, known, _ = _score(index.value, data, offsets)
        keep[at : at + count] = calibrated(model, votes, known) < REJECT
    return [c.filter(pa.array(keep)) for c in columns]
