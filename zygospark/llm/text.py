"""Vectorised word hashing of Arrow text columns, shared by the operators.

Texts are handled as the UTF-8 bytes of an Arrow batch.  A word's 64-bit hash
is a polynomial over random byte values, taken from running sums of the whole
batch, so no Python object is made per word.  Operators that need exact
equality check the words themselves afterwards, or say that they rely on the
hash and how likely a collision is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are hashed in slices of about this many bytes; a longer text is a slice of its own

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Byte tables: True for bytes of words `[^\x20\x09-\x0D]+`.
WORDS = ~_SPACES
#: ... of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 4 + 3
_UNBASE = pow(_BASE, -1, 1 << 64)
STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n, kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, CHUNK_BYTES) + 1, np.uint64(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[: n + 1]


@dataclass
class Words:
    """Words of a run of texts: hashes, byte spans, and where each text's words begin."""

    data: np.ndarray  # bytes of the texts, as hashed
    offsets: np.ndarray  # text i has data[offsets[i]:offsets[i + 1]]
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # text i has words first[i] to first[i + 1]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def span(self, lo: int, hi: int) -> list[bytes]:
        """The words lo..hi-1 themselves."""
        return [self.data[self.starts[w] : self.ends[w]].tobytes() for w in range(lo, hi)]


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any byte span follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data))[:-1], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((running[ends] - running[starts]) * _power(_UNBASE, len(running))[starts])


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORDS, lower: bool = False, hashed: bool = True) -> Words:
    """Words of texts that lie one after another in `data`; a word never spans two texts."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    bounds = offsets[offsets < n]
    begin[bounds] |= inside[bounds]
    cut = bounds[bounds > 0] - 1
    end[cut] |= inside[cut]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = span_hash(sums(data), starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(data, offsets, hashes, starts, ends, np.searchsorted(starts, offsets))


def slices(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of whole texts of about `most` bytes."""
    data, offsets = byte_view(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(column, table: np.ndarray = WORDS, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(index of the first text, its words and those of the next ones) for a whole column."""
    for at, data, offsets in slices(column, most):
        yield at, find_words(data, offsets, table, lower)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-word windows inside each text: (hash, index of the first word, where each text's windows begin)."""
    n = len(hashes) - k + 1
    counts = np.maximum(np.diff(first) - k + 1, 0)
    begins = np.concatenate(([0], np.cumsum(counts)))
    if n <= 0 or begins[-1] == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), begins
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = rolled * STEP + hashes[j : j + n]
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    return mix(rolled[at], k), at, begins


def whole_text(hashes: np.ndarray, lo: int, hi: int) -> int:
    """Hash of words lo..hi-1 as one sequence."""
    value = 0
    for h in hashes[lo:hi].tolist():
        value = (value * int(STEP) + h) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([value], np.uint64), int(hi - lo))[0])


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def kept_text(words: Words, i: int, keep: np.ndarray) -> bytes:
    """The kept words of text i, joined by one space."""
    lo = words.first[i]
    return b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[lo:][: len(keep)][keep], words.ends[lo:][: len(keep)][keep], strict=True))
