"""Near-equal lines: MinHash over character shingles, banding, exact Jaccard similarity, union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospark.llm.components import connected_components
from zygospark.llm.rows import by_group, long_id, packed, packed_schema, shuffle_groups, unpacked, written
from zygospark.llm.text import mix

SHINGLE = 7  # characters
PERCENT = 80  # of the union that must be shared
BANDS, ROWS = 20, 4  # a pair at the threshold shares no band with probability (1 - 0.8 ** 4) ** 20 = 3e-5
CHUNK_CHARS = 1 << 16  # hashed at once, so that the values stay in the processor's cache
PACK_CHARS = 1 << 20  # sent together
PAIRS = 1024  # confirmed at once
OTHERS, MEMBERS = 512, 1024  # of a bucket, compared in one tile
SKETCH_BITS = 512

LINE = {"high": np.uint64, "low": np.uint64, "doc": np.int64, "line": np.int32, "known": np.uint8}
MEMBER = {"key": np.uint32, "id": np.int64}

_MULTIPLY = np.random.Generator(np.random.PCG64(97)).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def lines_of(text: str | None) -> list[bytes]:
    """Lines between \\n, A-Z lower-cased; a null text has none."""
    return [] if text is None else text.encode().lower().split(b"\n")


def _digest(line: bytes) -> bytes:
    return blake2b(line, digest_size=16).digest()


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the lines with a line end between, where each line begins, its shingles); short lines are filled up with zeros."""
    text = "\n".join(line.ljust(SHINGLE, "\0") for line in lines)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    feeds = np.flatnonzero(points == 10)
    begins = np.concatenate(([0], feeds + 1))
    return points, begins, np.append(feeds, len(points)) - begins - SHINGLE + 1


def _windows(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each shingle begins."""
    return np.arange(counts.sum()) + np.repeat(begins - np.cumsum(counts) + counts, counts)


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Ascending 64-bit hashes of each line's distinct shingles."""
    points, begins, counts = _points(lines)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = points.astype(np.uint64) + step
    for width in (1, 2, 3):  # 2, 4 and 7 characters
        rolled = (rolled[:-width] * step) ^ rolled[width:] ^ (rolled[:-width] >> np.uint64(29))
    rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    for lo, n in zip(begins.tolist(), counts.tolist(), strict=True):
        one = np.sort(rolled[lo : lo + n])
        new = np.ones(n, bool)
        new[1:] = one[1:] != one[:-1]
        out.append(one[new])
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets share enough of their union."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * PERCENT:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both * 100 >= (len(a) + len(b) - both) * PERCENT


def _first_seen(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int, int, bool]]:
    """(digest, line, doc_id, number, whether an equal line came earlier in the batch) of every line with a word, in order."""
    order = sorted((d, i) for i, d in enumerate(batch["doc_id"].to_pylist()) if d is not None)
    seen: dict[bytes, tuple[int, int]] = {}
    for doc, i in order:
        for number, line in enumerate(lines_of(batch["text"][i].as_py())):
            if line.strip():
                digest = _digest(line)
                first = seen.setdefault(digest, (doc, number))
                yield digest, line, doc, number, first != (doc, number)


def _send_lines(groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all lines; of equal lines of a batch only the first goes to their group."""
    for batch in batches:
        rows = [(d, doc, number, again) for d, _, doc, number, again in _first_seen(batch)]
        if rows:
            digest = np.frombuffer(b"".join(r[0] for r in rows), np.uint64).reshape(-1, 2)
            doc, number = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int32)
            known = np.array([r[3] for r in rows], np.uint8)
            to = np.where(known == 1, mix(doc.astype(np.uint64), 41), digest[:, 0]) % np.uint64(groups)
            columns = {"high": digest[:, 0], "low": digest[:, 1], "doc": doc, "line": number, "known": known}
            yield packed(to, columns, groups)


def _first_lines(table: pa.Table) -> pa.Table:
    """Every line that repeats an earlier one (id null), and each different line's first place."""
    high, low, doc, line, known = (unpacked(table, c, kind) for c, kind in LINE.items())
    own = np.flatnonzero(known == 0)
    order = own[np.lexsort((line[own], doc[own], low[own], high[own]))]
    new = np.ones(len(order), bool)
    new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    rest = order[(doc[order] != doc[first]) | (line[order] != line[first])]
    heads, gone = order[new], np.concatenate((rest, np.flatnonzero(known == 1)))
    ids = pa.concat_arrays([pa.array(high[heads].view(np.int64)), pa.nulls(len(gone), pa.int64())])
    at = np.concatenate((heads, gone))
    return pa.table({"id": ids, "doc_id": doc[at], "line": line[at]})


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) hashes of the bands of MinHash values."""
    points, begins, counts = _points(lines)
    rolled = np.zeros(len(points) - SHINGLE + 1, np.uint32)
    for j in range(SHINGLE):
        rolled = rolled * np.uint32(0x01000193) + points[j : j + len(rolled)] * np.uint32(0x9E3779B1)
    rolled ^= rolled >> np.uint32(16)
    rolled *= np.uint32(0x85EBCA6B)
    rolled ^= rolled >> np.uint32(13)
    rolled *= np.uint32(0xC2B2AE35)
    rolled ^= rolled >> np.uint32(16)
    values = rolled[_windows(begins, counts)]
    at = np.concatenate(([0], np.cumsum(counts)))[:-1]
    room = np.empty_like(values)
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    for i in range(BANDS * ROWS):
        np.minimum.reduceat(np.multiply(values, _MULTIPLY[i], out=room), at, out=least[i])
    least = least.reshape(BANDS, ROWS, len(lines))
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), 1)
    for r in range(ROWS):
        out = mix(out + least[:, r], 6)
    return np.ascontiguousarray(out.T)


def _send_bands(groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band key, line id) of the first of equal lines of a batch."""
    for batch in batches:
        ids: list[bytes] = []
        keys: list[np.ndarray] = []
        lines: list[str] = []
        chars = packed_chars = 0
        for digest, line, _, _, again in _first_seen(batch):
            if not again:
                ids.append(digest[:8])
                lines.append(line.decode())
                chars += len(line)
                if chars > CHUNK_CHARS:
                    keys.append(band_keys(lines))
                    lines, chars, packed_chars = [], 0, packed_chars + chars
                    if packed_chars > PACK_CHARS:
                        yield _bands(ids, keys, groups)
                        ids, keys, packed_chars = [], [], 0
        if lines:
            keys.append(band_keys(lines))
        if keys:
            yield _bands(ids, keys, groups)


def _bands(ids: list[bytes], parts: list[np.ndarray], groups: int) -> pa.RecordBatch:
    keys = np.concatenate(parts).ravel()
    own = np.repeat(np.frombuffer(b"".join(ids), np.int64), BANDS)
    return packed(keys, {"key": (keys >> np.uint64(32)).astype(np.uint32), "id": own}, groups)


def _met(table: pa.Table) -> pa.Table:
    """Members of buckets that hold several different lines; `band` names the bucket."""
    key, ids = (unpacked(table, c, kind) for c, kind in MEMBER.items())
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids = key[new], ids[new]
    twin = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    group = table["p"][0].as_py() if table.num_rows else 0
    return pa.table({"band": (np.int64(group) << np.int64(32)) | key[twin].astype(np.int64), "id": ids[twin]})


def _pick_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the asked lines."""
    for batch in batches:
        ids, texts = [], []
        for text, asked in zip(batch["text"].to_pylist(), batch["asked"].to_pylist(), strict=True):
            lines = lines_of(text)
            for a in asked:
                if a["line"] < len(lines) and int.from_bytes(_digest(lines[a["line"]])[:8], "little", signed=True) == a["id"]:
                    ids.append(a["id"])
                    texts.append(lines[a["line"]].decode())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "body"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAIRS):
            some = batch.slice(at, PAIRS)
            a, b, x, y = (some[c].to_pylist() for c in ("a", "b", "x", "y"))
            bodies = dict(zip(a, x, strict=True)) | dict(zip(b, y, strict=True))
            sets = dict(zip(bodies, shingle_sets(list(bodies.values())), strict=True))
            keep = pa.array([alike(sets[i], sets[j]) for i, j in zip(a, b, strict=True)], pa.bool_())
            yield pa.record_batch([some["a"].filter(keep), some["b"].filter(keep)], names=["a", "b"])


def _odd_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of the sets."""
    line = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bit = (mix(np.concatenate(sets), 9) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount(line * SKETCH_BITS + bit, minlength=len(sets) * SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1).view(np.uint64)


def _most_apart(sizes: np.ndarray) -> np.ndarray:
    """Bits that two bitmaps of similar enough sets differ in at most, by their sizes' sum: six deviations above the threshold's mean."""
    apart = sizes * (100 - PERCENT) / (100 + PERCENT) / SKETCH_BITS
    left = np.exp(-2 * apart)
    odd = (1 - left) / 2
    return SKETCH_BITS * odd + 6 * np.sqrt(np.maximum(SKETCH_BITS * (odd * (1 - odd) - apart * left * left), 0.25)) + 1


def tile_links(labels: list[int], sides: list[int], lines: list[str]) -> list[tuple[int, int]]:
    """Pairs of places: members of side 1 with members of another component that are similar enough; one for each two components joined."""
    sets = shingle_sets(lines)
    sizes, bits = np.array([len(x) for x in sets]), _odd_bits(sets)
    side, label = np.array(sides), np.array(labels)
    every = np.flatnonzero(side == 0)
    out = []
    for a in np.flatnonzero(side == 1):
        apart = np.bitwise_count(bits[a] ^ bits[every]).sum(1, dtype=np.int64)
        near = (apart <= _most_apart(sizes[a] + sizes[every])) & (label[every] != label[a])
        for b in every[near]:
            if label[a] != label[b] and alike(sets[a], sets[b]):
                out.append((int(a), int(b)))
                label[label == label[b]] = label[a]
    return out


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of components that a tile joins."""
    for batch in batches:
        out = []
        for members in batch["members"].to_pylist():
            labels = [m["label"] for m in members]
            found = tile_links(labels, [m["side"] for m in members], [m["body"] for m in members])
            out += [(labels[a], labels[b]) for a, b in found]
        yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def line_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of the lines to remove: all but the first of each component of near-equal lines."""
    groups = shuffle_groups(docs)
    placed = docs.mapInArrow(partial(_send_lines, groups), packed_schema(LINE))
    placed = written(by_group(placed, _first_lines, "id long, doc_id long, line int"))
    bands = docs.mapInArrow(partial(_send_bands, groups), packed_schema(MEMBER))
    members = written(by_group(bands, _met, "band long, id long"))

    places = placed.filter("id is not null").join(members.select("id").distinct(), "id", "left_semi")
    places = written(places)
    asked = places.groupBy("doc_id").agg(F.collect_list(F.struct("id", "line")).alias("asked"))
    bodies = docs.join(asked, "doc_id").select("text", "asked").mapInArrow(_pick_lines, "id long, body string")
    bodies = written(bodies.dropDuplicates(["id"]))

    drawn = F.struct(F.xxhash64("id", "band").alias("draw"), F.col("id").alias("a"))
    centres = members.groupBy("band").agg(F.min(drawn).alias("centre")).select("band", "centre.a")
    stars = members.join(centres, "band").filter("id <> a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    left, right = (bodies.select(F.col("id").alias(k), F.col("body").alias(v)) for k, v in ("ax", "by"))
    links = written(stars.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long"))
    labels = connected_components(links)

    labelled = members.join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("label"))
    hashes = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    buckets = labelled.groupBy("band").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), *[F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(hashes)]
    )
    buckets = buckets.filter("lo < hi and m > 2")  # of two members, the star was the only pair
    buckets = written(buckets.groupBy("m", "h0", "h1").agg(F.min("band").alias("band")).select("band"))  # one of those with the same members
    labelled = written(labelled.join(buckets, "band"))
    parts = labelled.groupBy("band", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("m"))
    mixed = mixed.select("band", "main", F.ceil((F.col("m") - F.col("n")) / OTHERS).cast("int").alias("go"), F.ceil(F.col("m") / MEMBERS).cast("int").alias("gm"))
    inside = labelled.join(mixed, "band").join(bodies, "id")
    chunk = lambda seed, g: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(g)).cast("int")
    upto = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    every = inside.select("*", chunk(1, "gm").alias("i"), upto("go").alias("j"), F.lit(0).alias("side"))
    others = inside.filter("label <> main").select("*", upto("gm").alias("i"), chunk(2, "go").alias("j"), F.lit(1).alias("side"))
    tiles = every.union(others).groupBy("band", "i", "j").agg(F.collect_list(F.struct("id", "label", "side", "body")).alias("members"))
    more = tiles.select("members").mapInArrow(_tile_links, "a long, b long").distinct()
    moved = connected_components(written(more))  # components of components, far fewer than links

    named = places.join(labels, "id", "left").join(moved.select("id", F.lit(True).alias("joined")), "id", "left")
    named = named.filter("component is not null or joined").select(F.coalesce("component", "id").alias("label"), F.struct("doc_id", "line").alias("at"))
    firsts = named.groupBy("label").agg(F.min("at").alias("first"))
    firsts = firsts.join(moved, firsts["label"] == moved["id"], "left").select("label", F.coalesce("component", "label").alias("component"), "first")
    whole = firsts.groupBy("component").agg(F.min("first").alias("first"))
    firsts = firsts.drop("first").join(whole, "component").select("label", "first")
    later = named.join(firsts, "label").filter("at <> first").select("at.doc_id", "at.line")
    return placed.filter("id is null").select("doc_id", "line").union(later)


def _rebuild(text: str | None, gone: list[int] | None) -> tuple[int, int, str | None]:
    """(lines, removed, what is left)."""
    if text is None:
        return 0, 0, None
    lines = text.split("\n")
    drop = set(gone or ())
    kept = [line for i, line in enumerate(lines) if i not in drop]
    return len(lines), len(lines) - len(kept), "\n".join(kept) if drop else text


def _apply(with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_rebuild(t, g) for t, g in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True)]
        columns = [
            batch["doc_id"],
            pa.array([d[0] for d in done], pa.int64()),
            pa.array([d[1] for d in done], pa.int64()),
            pa.array([sha256((d[2] or "").encode()).hexdigest() for d in done], pa.string()),
            pa.array([d[2] if with_text else None for d in done], pa.string()),
        ]
        yield pa.record_batch(columns, names=["doc_id", "n_lines", "n_removed", "kept_sha256", "text"])


def dedup_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, text) of every row without its repeated lines.

    Lines (between \\n, with a word, A-Z lower-cased) are linked when at least
    80 % of the union of their sets of 7-character shingles is shared.  Of each
    component of links the line with the smallest (doc_id, line number) stays.
    Lines without a word always stay.

    Method: equal lines are found first and only the first of each goes on.
    Bands of MinHash values are shuffled packed, as 12 bytes each, and only
    buckets with several different lines become rows.  Each bucket links its
    members with one drawn member; links are confirmed on the exact sets and
    give components; in buckets that still hold several components, the members
    outside the largest one are then compared with all in tiles of bounded
    size: parity bitmaps first, then the sets (64-bit shingle hashes).  Copies of a
    frequent line are reduced to one inside each batch before any shuffle.

    Null texts have no lines and stay null; rows with a null doc_id are left
    whole.  Rows that repeat a doc_id share their lines' verdicts.
    """
    docs = long_id(docs)
    gone = written(line_classes(docs).distinct())
    gone = gone.groupBy("doc_id").agg(F.collect_list("line").alias("gone"))
    out = docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    out = out.mapInArrow(partial(_apply, with_text), "doc_id long, n_lines long, n_removed long, kept_sha256 string, text string")
    return out if with_text else out.drop("text")


def with_lines_deduped(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts, all columns kept; those of which every word went are left out."""
    gone = written(line_classes(long_id(docs)).distinct())
    gone = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("line").alias("__gone"))
    names = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    own, text = F.col(f"_{names.index('doc_id')}").cast("long"), F.col(f"_{names.index('text')}")
    joined = plain.join(gone, own == F.col("__id"), "left")
    lines = F.split(text.cast("string"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("__gone", i)), "\n")
    changed = joined.withColumn("__text", F.when(F.col("__gone").isNull(), text.cast("string")).otherwise(left))
    changed = changed.filter(F.col("__gone").isNull() | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    return changed.select(*(F.col("__text").alias(f"_{i}") if n == "text" else F.col(f"_{i}") for i, n in enumerate(names))).toDF(*names)
