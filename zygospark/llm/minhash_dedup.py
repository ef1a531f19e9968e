"""Near-duplicate documents: MinHash banding, candidates checked by odd sketches, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospark.llm.components import connected_components
from zygospark.llm.rows import written
from zygospark.llm.text import find_words, grams, mix, slices, whole_text

SHINGLE = 5  # words
PERCENT = 75  # of the union that must be shared
BANDS, ROWS = 32, 4  # a pair at the threshold shares no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6
SAMPLES = BANDS * ROWS
BIN_BITS = 12  # a sketch holds one sample (the smallest hash) of each of 4096 bins of hashes
SKETCH_BITS = 4096
DEVIATIONS = 6.0  # a candidate is dropped when its sketches share that much less than pairs at the threshold do
TILE = 256  # members of a band's bucket that are compared with as many others in one row
TILE_ITEMS = 1 << 17  # shingles of either side of a tile, about
COMPARED = 64  # sets compared at once

_seeds = np.random.Generator(np.random.PCG64(71)).integers(1, 1 << 63, (2, SAMPLES), dtype=np.uint64)
_XOR, _MULTIPLY = _seeds[0], _seeds[1] * np.uint64(2) + np.uint64(1)
_LANE = mix(np.arange(SAMPLES, dtype=np.uint64), 5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, ascending; where each text's set begins)."""
    words = find_words(data, offsets, lower=True)
    hashes, _, begins = grams(words.hashes, words.first, SHINGLE)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    sizes = np.diff(begins)
    sizes[short] = 1
    begin = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(begin[-1], np.uint64)
    is_short = np.zeros(len(words), bool)
    is_short[short] = True
    out[~np.repeat(is_short, sizes)] = hashes
    for i in short:
        out[begin[i]] = whole_text(words.hashes, words.first[i], words.first[i + 1])
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][sizes > 0]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[begin]


def minhashes(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) smallest values of each non-empty set."""
    out = np.empty((SAMPLES, len(begins)), np.uint64)
    for i in range(SAMPLES):
        out[i] = np.minimum.reduceat((sets ^ _XOR[i]) * _MULTIPLY[i], begins)
    return out.T


def odd_sketches(sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples of each set, parity bitmaps): the smallest hash of every bin flips one of SKETCH_BITS bits."""
    n = len(begins)
    doc = np.repeat(np.arange(n), np.diff(np.append(begins, len(sets))))
    place = (doc << BIN_BITS) | (sets >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    smallest = np.ones(len(sets), bool)  # the sets are in ascending order
    smallest[1:] = place[1:] != place[:-1]
    doc = doc[smallest]
    bit = (mix(sets[smallest], 9) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount(doc * SKETCH_BITS + bit, minlength=n * SKETCH_BITS)
    bitmaps = np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)
    return np.bincount(doc, minlength=n), bitmaps


def may_be_similar(apart, n_a, n_b, m_a, m_b, exp, log, sqrt, greatest, least):
    """Whether two sketches leave the threshold possible; for numpy arrays and for columns alike.

    apart: bits that differ, n: set sizes, m: samples.  With t samples apart,
    each of b bits is odd with probability (1 - exp(-2 t / b)) / 2.  At the
    threshold the union has (n_a + n_b) / (1 + s) hashes, which fill a known
    share of the bins, and s of these hold a common sample; the deviation is
    that of drawing bins without putting back, and of the bitmap.
    """
    s, bins, bits = PERCENT / 100, float(1 << BIN_BITS), float(SKETCH_BITS)
    left = greatest(1 - 2 * apart / bits, 1e-6)
    t = -bits / 2 * log(left)
    shared = (m_a + m_b - t) / 2
    union = (n_a + n_b) / (1 + s)
    filled = bins * (1 - exp(-union / bins))
    odd = (1 - left) / 2
    noise = bits * (odd * (1 - odd) - t / bits * left * left) / (left * left) / 4
    deviation = sqrt(greatest(filled * s * (1 - s) * (1 - filled / union), 0.0) + greatest(noise, 0.0))
    return (shared >= s * filled - DEVIATIONS * deviation - 1) & (least(n_a, n_b) * 100 >= greatest(n_a, n_b) * PERCENT)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hash of each band, its number included."""
    by_band = mix(samples, 3).reshape(len(samples), BANDS, ROWS)
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(samples), 0)
    for r in range(ROWS):
        key = mix(key + by_band[:, :, r], 4)
    return key.view(np.int64)


def _lists(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values.ravel(), pa.int64()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in slices(batch["text"]):
            n = len(offsets) - 1
            sets, begins = shingle_sets(data, offsets)
            sizes = np.diff(begins)
            full = np.flatnonzero(sizes > 0)
            signature = np.zeros((2, n), np.uint64)
            bands = np.zeros((0, BANDS), np.int64)
            odd = np.zeros((0, SKETCH_BITS // 64), np.int64)
            taken = np.zeros(n, np.int64)
            if len(full):
                for j in (0, 1):
                    signature[j, full] = np.add.reduceat(mix(sets, 11 + j), begins[full])
                bands = band_keys(minhashes(sets, begins[full]))
                taken[full], odd = odd_sketches(sets, begins[full])
            has = np.concatenate(([0], np.cumsum(sizes > 0)))
            yield pa.record_batch(
                [
                    batch["doc_id"].slice(at, n),
                    pa.array(sizes, pa.int64()),
                    pa.array(signature[0].view(np.int64)),
                    pa.array(signature[1].view(np.int64)),
                    _lists(bands, has * BANDS),
                    pa.array(taken),
                    _lists(odd, has * (SKETCH_BITS // 64)),
                ],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "samples", "odd"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in slices(batch["text"]):
            sets, begins = shingle_sets(data, offsets)
            yield pa.record_batch([batch["doc_id"].slice(at, len(offsets) - 1), _lists(sets.view(np.int64), begins)], names=["doc_id", "items"])


def _apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _least(a, b) -> Column:
    return F.least(a, b)


def _greatest(a, b) -> Column:
    return F.greatest(a, F.lit(b) if isinstance(b, float) else b)


def tile_links(ids, labels, side, n, m, sketch, items, begins) -> list[tuple[int, int]]:
    """Links between members of one tile: side 1 against side 0, at most one for each two components that they join.

    Sketches choose the pairs whose sets are compared; a component that a link has
    joined is not compared with again, so the links are a forest.
    """
    labels = labels.copy()
    every = np.flatnonzero(side == 0)
    out = []
    for a in np.flatnonzero(side == 1):
        near = every[labels[every] != labels[a]]
        if not len(near):
            continue
        apart = np.bitwise_count(sketch[a] ^ sketch[near]).sum(1, dtype=np.int64)
        near = near[may_be_similar(apart, n[a], n[near], m[a], m[near], np.exp, np.log, np.sqrt, np.maximum, np.minimum)]
        own = items[begins[a] : begins[a + 1]]
        for at in range(0, len(near), COMPARED):
            some = near[at : at + COMPARED]
            some = some[labels[some] != labels[a]]
            if not len(some):
                continue
            sizes = begins[some + 1] - begins[some]
            heads = np.cumsum(sizes) - sizes
            flat = items[np.arange(sizes.sum()) + np.repeat(begins[some] - heads, sizes)]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat(own[place] == flat, heads, dtype=np.int64)
            for b in some[both * 100 >= (len(own) + sizes - both) * PERCENT]:
                if labels[b] != labels[a]:
                    out.append((int(ids[a]), int(ids[b])))
                    labels[labels == labels[b]] = labels[a]
    return out


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int]] = []
        for tile in batch["members"]:
            flat = tile.values
            ids, labels, side, n, m = (np.asarray(flat.field(k)) for k in range(5))
            sketch = np.asarray(flat.field(5).flatten()).view(np.uint64).reshape(len(ids), -1)
            begins = np.concatenate(([0], np.cumsum(np.asarray(flat.field(6).value_lengths()))))
            out += tile_links(ids, labels, side, n, m, sketch, np.asarray(flat.field(6).flatten()).view(np.uint64), begins)
        yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _sets_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, items): full shingle sets of the asked documents."""
    return written(docs.join(asked, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, items array<long>"))


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    pairs = written(pairs)
    ends = [pairs.select(F.col(k).alias("doc_id")).distinct() for k in ("a", "b")]
    sets = _sets_of(docs, written(ends[0].union(ends[1]).distinct()))
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return joined.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * PERCENT).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Class of every row: (doc_id, n_shingles, component_id, kept).

    Documents are linked when at least 75 % of the union of their sets of
    distinct 5-word shingles is shared; component_id is the smallest doc_id
    reachable over links, kept is doc_id = component_id.

    Method: equal sets are one class, named by its smallest doc_id, so copies
    never meet each other.  Class representatives are put into MinHash bands.
    First each bucket links its members with one of them, drawn anew in every
    band (a star, not all pairs); the links that hold give components.  Then, in
    buckets that still hold several components, members outside the largest one
    are compared with all in tiles of bounded size: odd sketches choose the pairs of
    different components whose full sets are compared in the tile, and a tile
    gives at most one link for each two components it joins.  Sets are 64-bit shingle hashes: two different shingles of one
    pair of texts collide with probability below 1e-10 for 20,000 words.

    Fewer than five words are one shingle; null, empty and wordless texts have
    no shingles, stay alone and are kept.  A null doc_id gets a null component
    and is kept.  Rows that repeat a doc_id share their verdict.  Other columns
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, samples long, odd array<long>"
    sketches = written(docs.mapInArrow(_sketch, schema))
    usable = sketches.filter("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "s1", "s2"]
    classes = usable.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    member = written(usable.select("doc_id", *key).join(classes, key).select("doc_id", "rep").distinct())
    reps = usable.join(member.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    reps = written(reps.dropDuplicates(["doc_id", *key]).drop("s1", "s2"))

    entries = reps.select("doc_id", F.explode("bands").alias("band"))
    drawn = F.struct(F.xxhash64("doc_id", "band").alias("draw"), F.col("doc_id").alias("a"))  # another centre in every band
    centres = entries.groupBy("band").agg(F.min(drawn).alias("centre"), F.count("*").alias("m")).filter("m > 1").select("band", "centre.a")
    stars = entries.join(centres, "band").filter("doc_id <> a")
    stars = stars.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    sketch = F.struct("n_shingles", "samples", "odd")
    stars = stars.join(reps.select(F.col("doc_id").alias("a"), sketch.alias("x")), "a")
    stars = stars.join(reps.select(F.col("doc_id").alias("b"), sketch.alias("y")), "b")
    numbers = [_apart(F.col("x.odd"), F.col("y.odd")), *(F.col(c) for c in ("x.n_shingles", "y.n_shingles", "x.samples", "y.samples"))]
    stars = stars.filter(may_be_similar(*numbers, F.exp, F.ln, F.sqrt, _greatest, _least)).select("a", "b").distinct()
    links = written(_confirmed(docs, stars))
    labels = connected_components(links).select(F.col("id").alias("doc_id"), "component")

    labelled = reps.join(labels, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("label"), "bands", "n_shingles", "samples", "odd")
    labelled = written(labelled)
    entries = labelled.select("doc_id", "label", "n_shingles", F.explode("bands").alias("band"))
    hashes = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1))
    buckets = entries.groupBy("band").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), *[F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(hashes)]
    )
    buckets = buckets.filter("lo < hi and m > 2")  # of two members, the star was the only pair
    buckets = written(buckets.groupBy("m", "h0", "h1").agg(F.min("band").alias("band")).select("band"))  # one of those with the same members
    mixing = written(entries.join(buckets, "band"))
    parts = mixing.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    mixed = parts.groupBy("band").agg(F.max_by(F.struct("label", "n", "s"), F.struct("n", "label")).alias("main"), F.sum("n").alias("m"), F.sum("s").alias("s"))
    tiles = lambda n, s: F.ceil(F.greatest(n / TILE, s / TILE_ITEMS)).cast("int")
    mixed = mixed.select("band", F.col("main.label").alias("main"), tiles(F.col("m"), F.col("s")).alias("gm"), tiles(F.col("m") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("go"))
    inside = written(mixing.drop("n_shingles").join(mixed, "band"))
    sets = _sets_of(docs, inside.select("doc_id").distinct())
    inside = inside.join(labelled.select("doc_id", "n_shingles", "samples", "odd"), "doc_id").join(sets.dropDuplicates(["doc_id"]), "doc_id")
    chunk = lambda seed, g: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(g)).cast("int")
    upto = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    every = inside.select("*", chunk(1, "gm").alias("i"), upto("go").alias("j"), F.lit(0).alias("side"))
    others = inside.filter("label <> main").select("*", upto("gm").alias("i"), chunk(2, "go").alias("j"), F.lit(1).alias("side"))
    one = F.struct("doc_id", "label", "side", "n_shingles", "samples", "odd", "items")
    tiles = every.union(others).groupBy("band", "i", "j").agg(F.collect_list(one).alias("members"))
    more = tiles.select("members").mapInArrow(_tile_links, "a long, b long").distinct()
    links = written(links.union(more).distinct())
    labels = connected_components(links).select(F.col("id").alias("rep"), "component")

    named = member.join(labels, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    named = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which each group of near duplicates keeps its smallest doc_id; all columns stay."""
    names = docs.columns
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    return plain.join(gone, F.col(f"_{names.index('doc_id')}").cast("long") == F.col("gone"), "left_anti").toDF(*names)
