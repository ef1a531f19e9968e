"""Cheapest repair of damaged conversations, with the audit of its edits.

A conversation's rows go one after another through a dynamic program over the
grammar (s?(ua)+)?, whose states say what the kept rows look like so far.  Each
state keeps its cheapest audit as a node of a persistent tree: a node shares its
prefix with every other audit that begins alike, and has its ancestors at powers
of two and a rolling hash.  Audits of equal cost are compared by searching their
longest common prefix over these; equal hashes are verified by letters.

Segments of a conversation combine: cheapest audits of equal cost between the
same two states are never proper prefixes of one another, since every letter
after a common prefix costs something and takes a row or is an insertion.  So the
least audit of the whole is put together from the least ones of its segments,
and conversations of more than LONG_ROWS rows are cut, worked on in parallel,
and stitched.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospark.llm.rows import written

LONG_ROWS = 10_000  # rows of a conversation that are worked on at a time
LONG_BYTES = 64 << 20  # ... and bytes of its texts
SPACES = " \t\n\x0b\x0c\r"
END_MARKS = "[.!?]"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1

# States: nothing yet, after a system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FINAL = (NONE, ASSISTANT)
LEGAL = {"su", "ua", "au"}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
MODULUS = (1 << 61) - 1
BASE = 0x5DEECE66D1234567 % MODULUS

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("rows", "low", "high", "turns", *FAULTS, "illegal")


class Edits:
    """Nodes of the audits of one conversation; node 0 is the empty audit."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... edits back
        self.letter = [""]
        self.depth = [0]
        self.hash = [0]

    def add(self, parent: int, letter: str) -> int:
        up, at, j = [parent], parent, 0
        while j < len(self.up[at]):
            at = self.up[at][j]
            up.append(at)
            j += 1
        self.up.append(up)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % self.modulus)
        return len(self.letter) - 1

    def back(self, node: int, steps: int) -> int:
        j = 0
        while steps:
            if steps & 1:
                node = self.up[node][j]
            steps >>= 1
            j += 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether two audits of one length with one hash are equal: their letters, back to the node they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit a sorts before audit b."""
        n = min(self.depth[a], self.depth[b])
        x, y = self.back(a, self.depth[a] - n), self.back(b, self.depth[b] - n)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(x) < self.text(y)  # a collision: the letters themselves decide
        for j in reversed(range(len(self.up[x]))):
            if j < len(self.up[x]) and self.hash[self.up[x][j]] != self.hash[self.up[y][j]]:
                x, y = self.up[x][j], self.up[y][j]
        if not self._same(self.up[x][0], self.up[y][0]):
            return self.text(x) < self.text(y)
        return self.letter[x] < self.letter[y]


class Repair:
    """The dynamic program over rows, from one state."""

    def __init__(self, start: int = NONE):
        self.edits = Edits()
        self.best: dict[int, tuple[int, int]] = {start: (0, 0)}  # state -> (cost, audit)

    def _offer(self, into: dict, state: int, cost: int, parent: int, letter: str) -> None:
        have = into.get(state)
        if have is None or cost < have[0]:
            into[state] = (cost, self.edits.add(parent, letter))
        elif cost == have[0]:
            node = self.edits.add(parent, letter)
            if self.edits.less(node, have[1]):
                into[state] = (cost, node)

    def insert(self) -> None:
        """Insertions before the next row; a second one can only follow the first."""
        for state in (USER, ASSISTANT):
            for before, after in NEXT[ROLE[state][0]].items():
                if before in self.best:
                    cost, node = self.best[before]
                    self._offer(self.best, after, cost + COST[INSERT], node, INSERT)

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        self.insert()
        after: dict[int, tuple[int, int]] = {}
        extra = TRUNCATED_COST if truncated else 0
        for state, (cost, node) in self.best.items():
            self._offer(after, state, cost + COST[DELETE], node, DELETE)
            if must_go:
                continue
            kept = NEXT.get(initial, {}).get(state)
            if kept is not None:
                self._offer(after, kept, cost + COST[KEEP] + extra, node, KEEP)
            for role in "ua":
                to = NEXT[role].get(state)
                if to is not None and role != initial:
                    self._offer(after, to, cost + COST[REROLE] + extra, node, REROLE)
        self.best = after

    def ends(self) -> dict[int, tuple[int, str]]:
        return {s: (cost, self.edits.text(node)) for s, (cost, node) in self.best.items()}


def audit_of(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """(cost, audit) of the best end that the grammar allows."""
    return min(ends[s] for s in FINAL if s in ends)


class Replay:
    """Applies an audit to rows in order; yields the rows of the repaired conversation."""

    def __init__(self, audit: str):
        self.letters = iter(audit)
        self.state = NONE

    def _step(self, letter: str, role: str, text: str) -> str | None:
        if letter == DELETE:
            return None
        if letter == KEEP:
            self.state = NEXT[role[0]][self.state]
            return f"{role}:{text}"
        self.state = ASSISTANT if self.state == USER else USER
        return f"{ROLE[self.state]}:{text if letter == REROLE else ''}"

    def row(self, role: str, text: str) -> Iterator[str]:
        for letter in self.letters:
            line = self._step(letter, role, "" if letter == INSERT else text)
            if line is not None:
                yield line
            if letter != INSERT:
                return

    def rest(self) -> Iterator[str]:
        for letter in self.letters:
            yield self._step(letter, "", "")


class Digest:
    """SHA-256 of lines joined by newlines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, lines: Iterable[str]) -> None:
        for line in lines:
            self.sha.update(f"\n{line}".encode() if self.any else line.encode())
            self.any = True

    def hex(self) -> str:
        return self.sha.hexdigest()


def fault_of(role: str, text: str, seen: bool) -> str | None:
    trimmed = text.rstrip(SPACES)
    if not trimmed:
        return "blank"
    if seen:
        return "duplicate"
    return None if trimmed[-1] in END_MARKS[1:-1] else "truncated"


class Tally:
    """Counts over the rows of a conversation or of one segment of it, in order."""

    def __init__(self):
        self.count = dict.fromkeys(COUNTS, 0)
        self.count["low"] = self.count["high"] = None
        self.first = self.last = None

    def row(self, turn: int | None, role: str, fault: str | None) -> None:
        c = self.count
        c["rows"] += 1
        if fault:
            c[fault] += 1
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            c["illegal"] += 1
        self.last = initial
        if turn is not None:
            if turn != c["high"]:
                c["turns"] += 1
            c["low"] = turn if c["low"] is None else c["low"]
            c["high"] = turn

    def append(self, other: dict, first: str, last: str) -> None:
        """The counts of the next segment."""
        c = self.count
        if other["rows"] == 0:
            return
        if self.first is None:
            self.first = first
        elif self.last + first not in LEGAL:
            c["illegal"] += 1
        self.last = last
        for k in ("rows", *FAULTS, "illegal"):
            c[k] += other[k]
        if other["low"] is not None:
            c["turns"] += other["turns"] - (c["high"] == other["low"])
            c["low"] = other["low"] if c["low"] is None else c["low"]
            c["high"] = other["high"]

    def values(self) -> list[int]:
        c = self.count
        gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]
        return [gaps, *(c[f] for f in FAULTS), c["illegal"]]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that each row's key asks for; `gone` rows are still there, marked."""
    space = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return conversations.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, END_MARKS, "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


def _result(rows: list[list]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]
    return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole conversations to their results; one conversation is held at a time."""
    out = []
    for conv, group in itertools.groupby(_rows(batches, "conv_id", "turn", "role", "text", "gone", "copies"), key=lambda r: r[0]):
        rows, seen, tally, repair = [], set(), Tally(), Repair()
        for _, turn, role, text, gone, copies in group:
            for _ in range(0 if gone else copies):
                fault = fault_of(role, text, (role, text) in seen)
                seen.add((role, text))
                tally.row(turn, role, fault)
                repair.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
                rows.append((role, text))
        repair.insert()
        cost, audit = audit_of(repair.ends())
        digest, replay = Digest(), Replay(audit)
        for role, text in rows:
            digest.add(replay.row(role, text))
        digest.add(replay.rest())
        out.append([conv, *tally.values(), cost, audit, digest.hex()])
        if len(out) == 1000:
            yield _result(out)
            out = []
    if out:
        yield _result(out)


SEGMENT = (
    "conv_id long, part long, seg long, first string, last string, "
    + ", ".join(f"{c} long" for c in COUNTS)
    + ", costs array<long>, audits array<string>"
)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of long conversations to segments: counts, and cost and audit from every state to every state."""
    for (conv, part), group in itertools.groupby(_rows(batches, "conv_id", "part", "turn", "role", "fault"), key=lambda r: r[:2]):
        for seg in itertools.count():
            some = list(itertools.islice(group, LONG_ROWS))
            if not some:
                break
            tally, repairs = Tally(), [Repair(s) for s in range(4)]
            for _, _, turn, role, fault in some:
                tally.row(turn, role, fault)
                for r in repairs:
                    r.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
            ends = [r.ends() for r in repairs]
            flat = [e.get(s, (None, None)) for e in ends for s in range(4)]
            cells = [conv, part, seg, tally.first, tally.last, *(tally.count[c] for c in COUNTS)]
            kinds = [*[pa.int64()] * 3, pa.string(), pa.string(), *[pa.int64()] * len(COUNTS)]
            columns = [pa.array([c], t) for c, t in zip(cells, kinds, strict=True)]
            columns += [pa.array([[c for c, _ in flat]], pa.list_(pa.int64())), pa.array([[a for _, a in flat]], pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=[c.split()[0] for c in SEGMENT.split(", ")])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order to the counts, cost and audit of their conversation."""
    names = ["conv_id", "first", "last", *COUNTS, "costs", "audits"]
    for conv, group in itertools.groupby(_rows(batches, *names), key=lambda r: r[0]):
        tally, best = Tally(), {NONE: (0, "")}
        for row in group:
            part = dict(zip(names, row, strict=True))
            tally.append({c: part[c] for c in COUNTS}, part["first"], part["last"])
            after: dict[int, tuple[int, str]] = {}
            for state, (cost, audit) in best.items():
                for to in range(4):
                    more, letters = part["costs"][state * 4 + to], part["audits"][state * 4 + to]
                    if more is not None:
                        offer = (cost + more, audit + letters)
                        after[to] = min(offer, after.get(to, offer))
            best = after
        last = [Repair(s) for s in best]
        for r in last:
            r.insert()
        whole = {}
        for (cost, audit), r in zip(best.values(), last, strict=True):
            for to, (more, letters) in r.ends().items():
                offer = (cost + more, audit + letters)
                whole[to] = min(offer, whole.get(to, offer))
        yield _result([[conv, *tally.values(), *audit_of(whole), None]])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(result first, then the rows of its conversation in order) to results with the digest; rows are streamed."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    for _, group in itertools.groupby(_rows(batches, *names, "role", "text"), key=lambda r: r[0]):
        head = next(group)
        digest, replay = Digest(), Replay(head[names.index("audit")])
        for row in group:
            digest.add(replay.row(row[-2], row[-1]))
        digest.add(replay.rest())
        yield _result([[*head[: len(names) - 1], digest.hex()]])


def _nulls_first(*columns: str) -> list[Column]:
    return [F.asc_nulls_first(c) for c in columns]


def _long(rows: DataFrame) -> DataFrame:
    """Results of conversations of any length: range-sorted segments, stitched, then one digest stream each."""
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.filter(~F.col("gone")).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).select(*order, "at", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"))
    rows = written(rows)
    place = F.struct("turn", "role", "text", "at")
    again = rows.groupBy("conv_id", F.col("digest").alias("_d")).agg(F.count("*").alias("_n"), F.min(place).getField("at").alias("_first"))
    again = again.filter("_n > 1").withColumnRenamed("conv_id", "_c").drop("_n")
    known = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    mark = F.regexp_extract("text", f"({END_MARKS})[{SPACES}]*\\z", 1)
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACES}]"), F.lit("blank"))
        .when(F.col("at") != F.col("_first"), F.lit("duplicate"))
        .when(mark == "", F.lit("truncated"))
    )
    by = _nulls_first(*order, "at")
    known = written(known.select(*order, "at", fault.alias("fault")))
    parts = max(1, -(-known.count() // LONG_ROWS))
    ranged = known.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id().cast("long"))
    segments = written(ranged.select("conv_id", "part", "turn", "role", "fault").mapInArrow(_segments, SEGMENT))
    inside = segments.repartition("conv_id").sortWithinPartitions(*_nulls_first("conv_id"), "part", "seg")
    stitched = written(inside.mapInArrow(_stitch, RESULT))
    names = stitched.columns
    blank = F.lit(None).cast("string")
    heads = stitched.select(*names, F.lit(0).alias("_k"), F.lit(None).cast("long").alias("turn"), blank.alias("role"), blank.alias("text"), F.lit(0).cast("long").alias("at"))
    empty = [F.lit(None).cast(stitched.schema[n].dataType).alias(n) for n in names[1:]]
    body = known.select("conv_id", *empty, F.lit(1).alias("_k"), "turn", "role", "text", "at")
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*_nulls_first("conv_id"), "_k", *_nulls_first("turn", "role", "text", "at"))
    return stream.select(*names, "role", "text").mapInArrow(_hashed, RESULT)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Faults, gaps, cheapest repair and its digest for every conv_id of `conversations` (conv_id, turn, role, text).

    Rows are damaged first, by a checksum of their key (see `damaged`), and then
    taken by turn, nulls first; rows of one turn by role and text, so that repeats
    lie side by side.  Returns (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256).

    Null conv_ids are one conversation, with a null conv_id; null roles and texts
    are one space.  An empty role has no initial: such a row gets a new role or goes,
    and makes both of its neighbours illegal.  A conversation whose rows were all
    dropped has zeros, an empty audit and the digest of an empty string.  Repeated
    rows are duplicates.  An empty table gives no rows; other columns are ignored.

    A conversation of more than LONG_ROWS / 2 rows or LONG_BYTES is cut into segments; only its
    digest, which depends on every byte before, is streamed in one task, and its
    audit is one cell, a letter for each edit.
    """
    rows = damaged(conversations)
    sizes = conversations.groupBy(F.col("conv_id").cast("long").alias("_big")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    big = written(sizes.filter((F.col("n") > LONG_ROWS // 2) | (F.col("bytes") > LONG_BYTES)).select("_big"))
    order = _nulls_first("conv_id", "turn", "role", "text")
    if big.isEmpty():
        return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_whole, RESULT)
    same = F.col("conv_id").eqNullSafe(F.col("_big"))
    short = rows.join(big, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_whole, RESULT)
    cut = rows.join(big, same, "left_semi")
    found = written(_long(cut))
    bare = big.join(found, F.col("_big").eqNullSafe(F.col("conv_id")), "left_anti")
    nothing = {"conv_id": F.col("_big"), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    zeros = bare.select(*[nothing.get(c, F.lit(0).cast("long")).alias(c) for c in found.columns])
    return short.unionByName(found).unionByName(zeros)
