"""Phrase mining, conversation repair and exact search against plain versions, with nulls, ties, repeats, long and empty input."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from zygospark.llm import collocations, conversation_repair, topk_search

CLASH = ("k", "f", "n", "phrase", "weight", "LANG2", "_0", "rank", "score", "uid", "asked", "fault", "at", "kind")


def with_clashes(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def phrases(df, **bounds):
    return sorted(tuple(r) for r in collocations.collocations(df, **bounds).collect())


@pytest.fixture
def texts():
    rnd = random.Random(5)
    words, gaps = ["a", "b", "c", "D", "é", "ü", "x1"], [" ", " ", " ", "  ", "\t", ". ", "\n", "!"]
    rows = [(rnd.choice([None, "en", "de"]), "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.choice([0, 1, 3, 50, 400])))) for _ in range(200)]
    rows += [("en", None), ("fr", ""), ("fr", " . "), ("en", "the quick brown fox jumps over the lazy dog " * 3000), ("", "one two")]
    return rows + [("en", "The quick brown fox jumps; over the lazy dog " * 30)] * 50


@pytest.mark.parametrize("spacing, bits", [(3, 27), (48, 27), (3, 15)])
def test_collocations(spark, texts, monkeypatch, spacing, bits):
    """Short and long chunks, and a bit filter so full that it hardly thins, give the same phrases."""
    monkeypatch.setattr(collocations, "SPACING", spacing)
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    df = spark.createDataFrame(texts, "lang string, text string")
    assert phrases(with_clashes(df), least=5, top=40) == brute.collocations(texts, 5, 40)


def test_collocations_at_their_least(spark):
    rows = [("en", "red apple pie")] * 99 + [("de", "red apple pie")] * 100 + [("de", "red apple")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    assert phrases(df) == brute.collocations(rows) and {r[0] for r in phrases(df)} == {"de"}
    assert phrases(df.limit(0)) == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = [("en", 1, "a", 4 * 10**12), ("en", 1, "b", 3 * 10**12), ("en", 2, "a b", 2 * 10**12 + 7)]
    counts = spark.createDataFrame(big, "lang string, k int, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * 10**12 + 1)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (counts, totals))
    score = 1000 * (2 * 10**12 + 7) * (9 * 10**12 + 1) // (4 * 10**12 * 3 * 10**12)
    assert [tuple(r)[-1] for r in collocations.collocations(counts).collect()] == [score]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def turns(n=900):
    rnd = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "a", "s", "u2", "user", "assistant"]
    said = ["Hi.", "ok", "", "  ", "What?", None, "x!", "a\nb", "A. \n", "long " * 3000 + "."]
    rows = [(rnd.choice([None, 1, 2, 3, 4]) if i < 200 else 5 + i // 9, rnd.choice([None, *range(-3, 12)]), rnd.choice(roles), rnd.choice(said)) for i in range(n)]
    return [*rows, *rows[:5]]


def repairs(df):
    return {r[0]: tuple(r[1:]) for r in conversation_repair.repair_conversations(df).collect()}


@pytest.mark.parametrize("rows_at_a_time", [10_000, 8])
def test_repair(spark, monkeypatch, rows_at_a_time):
    """Whole conversations and conversations stitched from segments give the plain version's repairs."""
    monkeypatch.setattr(conversation_repair, "LONG_ROWS", rows_at_a_time)
    rows = turns()
    df = with_clashes(spark.createDataFrame(rows, CONVERSATIONS))
    assert repairs(df) == brute.repaired(rows)
    assert repairs(df.limit(0)) == {}


def test_repair_of_one_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "LONG_ROWS", 40)
    rnd = random.Random(8)
    rows = [(7, i // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["A.", "b", f"{i}!", ""])) for i in range(400)]
    assert repairs(spark.createDataFrame(rows, CONVERSATIONS)) == brute.repaired(rows)


def test_repair_when_every_row_is_dropped(spark):
    rows = [(i, 0, "user", "Hi.") for i in range(60)] + [(1, 1, "assistant", "Yes.")]
    want = brute.repaired(rows)
    assert any(v[-2] == "" for v in want.values()) and repairs(spark.createDataFrame(rows, CONVERSATIONS)) == want


def test_audit_tree_with_colliding_hashes():
    """With a hash of a few values every comparison collides, and letters decide."""
    rnd = random.Random(4)
    for modulus in (1, 3, conversation_repair.MODULUS):
        tree, nodes = conversation_repair.Edits(modulus), {0: ""}
        for _ in range(300):
            parent, letter = rnd.choice(list(nodes)[-40:]), rnd.choice("DIKR")
            nodes[tree.add(parent, letter)] = nodes[parent] + letter
        for _ in range(2000):
            a, b = rnd.choice(list(nodes)), rnd.choice(list(nodes))
            assert tree.less(a, b) == (nodes[a] < nodes[b])
            assert tree.text(a) == nodes[a]


VECTORS = "vec_id long, embedding array<double>"


def found(df):
    return sorted((tuple(r) for r in topk_search.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()), key=str)


@pytest.fixture
def vectors():
    rnd = random.Random(6)
    rows = [(i % 160, [round(rnd.uniform(-1, 1), 2) for _ in range(rnd.choice([6, 6, 6, 3]))]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)] + [(50, [0.5] * 6)] * 3
    return rows + [(None, [0.9] * 6), (100, None), (150, [0.1, None]), (200, [float("nan")] * 6), (250, [float("inf")]), (300, []), (350, [1e18, 2e6, -3e6]), (351, [1e17])]


@pytest.mark.parametrize("size, lists", [(16 << 20, 2), (400, 3), (16 << 20, 1)])
def test_search(spark, vectors, monkeypatch, size, lists):
    """One pass and many, and any number of lists, find the same rows."""
    monkeypatch.setattr(topk_search, "QUERY_BYTES", size)
    df = with_clashes(spark.createDataFrame(vectors, VECTORS))
    got = sorted((tuple(r) for r in topk_search.exact_top_k(df, F.col("vec_id") % 50 == 0, lists=lists).collect()), key=str)
    assert got == brute.top_products(vectors)


def test_search_with_few_rows(spark):
    rows = [(0, [1.0, -1.0]), (50, [-1.0, 0.5]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS)
    assert found(df) == brute.top_products(rows)
    assert found(df.limit(0)) == [] and found(df.filter("vec_id = 7")) == [] and found(df.filter("vec_id = 50")) == []
