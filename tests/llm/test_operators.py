"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from hashlib import sha256

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from zygospark.llm import decontaminate, line_dedup, mixing, quality, substring_dedup, suffix_tree_lm, token_files, toxicity, url_filter
from zygospark.llm.components import connected_components
from zygospark.llm.minhash_dedup import drop_near_duplicates, near_duplicates

LONG = " ".join(f"x{i % 4001}y{i // 4001}" for i in range(30_000))
BASE = prose(1, 120)
EDITED = BASE.split()
EDITED[60] = "other"
EDGES = [
    (1, BASE),
    (2, " ".join(EDITED)),
    (3, BASE.upper()),
    (4, None),
    (5, ""),
    (6, "  \t\n "),
    (7, "two words"),
    (8, "two words"),
    (9, LONG),
    (10, LONG + " tail"),
    (11, prose(2, 45) + " " + prose(3, 40)),
    (12, prose(4, 30) + " " + prose(3, 40) + "\n" + prose(3, 40)),
    (13, "Ünï " * 30),
    (14, "naïve café " + prose(5, 25) + "\x0b" + prose(6, 25)),
]
NULL_ID = (None, prose(1, 120))


def by_id(df, *columns):
    rows = df.select("doc_id", *columns).collect()
    return {r[0]: tuple(r[1:]) for r in rows if r[0] is not None}


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 1), (8, 9), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 2)]
    edges = spark.createDataFrame(links, "src long, dst long")
    got = {r[0]: r[1] for r in connected_components(edges).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == brute.roots(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(edges.limit(0)).count() == 0


def test_near_duplicates(docs):
    got = by_id(near_duplicates(docs([*EDGES, EDGES[0], NULL_ID])), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(EDGES)


def test_near_duplicates_empty(docs):
    assert near_duplicates(docs([])).count() == 0
    rows = near_duplicates(docs([NULL_ID, (1, None)])).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in rows if r["doc_id"]) == [(1, True)] and len(rows) == 2


def test_near_copy_group(docs):
    """A large group of edited copies, whose members are not all alike, comes out as by brute force."""
    rows = []
    for i in range(150):
        w = prose(50, 60).split()
        for j in range(i % 5):
            w[(i * 13 + j * 11) % 60] = f"z{i}{j}"
        rows.append((i, " ".join(w)))
    assert by_id(near_duplicates(docs(rows)), "n_shingles", "component_id", "kept") == brute.near_duplicates(rows)


def test_drop_near_duplicates_keeps_columns(docs):
    df = docs(EDGES)
    out = drop_near_duplicates(df)
    want = {i for i, (_, _, kept) in brute.near_duplicates(EDGES).items() if kept}
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == want


def test_substring_dedup(docs):
    rows = [*EDGES, (15, "a " * 50), (16, prose(3, 40))]
    got = by_id(substring_dedup.remove_repeats(docs([*rows, NULL_ID])), "n_words", "n_removed", "text", "kept_sha256")
    want = {i: (*v, sha256(v[2].encode()).hexdigest()) for i, v in brute.without_repeats(rows).items()}
    assert got == want


def test_substring_dedup_null_and_repeated_rows(docs):
    rows = substring_dedup.remove_repeats(docs([NULL_ID, (1, BASE), (1, BASE), (2, BASE)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 120)]
    assert substring_dedup.remove_repeats(docs([])).count() == 0


def test_substring_dedup_takes_back_wrong_paths(docs, monkeypatch):
    """A path whose words differ from its source's is not removed."""
    found = substring_dedup.repeated_paths
    wrong = "named_struct('doc_id', 11L, 'start', 0L, 'n', 3L, 'src_id', 1L, 'src_start', 5L)"
    monkeypatch.setattr(substring_dedup, "repeated_paths", lambda d: found(d).unionByName(d.limit(1).selectExpr(f"inline(array({wrong}))")))
    got = by_id(substring_dedup.remove_repeats(docs(EDGES)), "n_words", "n_removed", "text")
    assert got == brute.without_repeats(EDGES)


ITEMS = [(100, prose(3, 30)), (101, "Short Item here"), (102, None), (103, "..."), (104, prose(3, 30)), (None, prose(2, 12)), (105, "two-words x")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(spark, docs):
    rows = [*EDGES, (17, "see: SHORT, item; here."), (18, "two words x two words x")]
    got = by_id(decontaminate.contamination(docs([*rows, NULL_ID]), items(spark)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = {}
    for i, (n, hit, ids) in brute.contamination(rows, ITEMS).items():
        want[i] = (n, hit, len(ids), sha256(",".join(ids).encode()).hexdigest(), hit > 0)
    assert got == want


def test_contamination_in_blocks(spark, docs, monkeypatch):
    whole = by_id(decontaminate.contamination(docs(EDGES), items(spark)), "n_words", "n_hit", "n_items", "items_sha256")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert by_id(decontaminate.contamination(docs(EDGES), items(spark)), "n_words", "n_hit", "n_items", "items_sha256") == whole
    kept = decontaminate.drop_contaminated(docs(EDGES), items(spark))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in whole.items() if not v[1]}
    assert kept.columns == docs(EDGES).columns


def test_contamination_in_blocks_row_by_row(spark, docs, monkeypatch):
    """Rows with null or repeated ids are judged each by its own text, as in a single block."""
    rows = [*EDGES, NULL_ID, (None, "see: SHORT, item; here."), (None, None), (17, "clean"), (17, prose(3, 30)), (17, prose(3, 30) + " two words x")]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    judged = lambda: sorted(map(str, decontaminate.contamination(docs(rows), items(spark)).select(*columns).collect()))
    whole = judged()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert judged() == whole and len(whole) == len(rows)


def test_contamination_longest_matches(spark, docs):
    text = "before " + " ".join(prose(3, 30).split()[4:25]) + " after"
    (row,) = decontaminate.matches(docs([(1, text)]), items(spark, [(100, prose(3, 30))])).collect()
    assert [tuple(s) for s in row["spans"]] == [(100, 4, 1, 21)]


def test_contamination_empty(spark, docs):
    assert decontaminate.contamination(docs([]), items(spark)).count() == 0
    got = by_id(decontaminate.contamination(docs(EDGES), items(spark, [])), "n_hit")
    assert set(got.values()) == {(0,)}


def test_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(20):
        ids = rng.integers(0, 4, 200)
        array = decontaminate.suffix_array(ids, 200)
        ends = np.append(np.flatnonzero(ids == 0), 200)
        tail = lambda i: tuple(ids[i : ends[np.searchsorted(ends, i)]])
        assert [tail(i) for i in array] == sorted(tail(i) for i in np.flatnonzero(ids))


LINES = [
    (1, "The quick brown fox jumps over the lazy dog today\nshared line\n\nunique one here"),
    (2, "the quick brown fox jumps over the lazy dog today!\nShared Line\nanother unique line"),
    (3, "shared line\nshared line\n   \nx"),
    (4, None),
    (5, ""),
    (6, "x\n" + LONG),
    (7, "y\n" + LONG + "z"),
    (8, "größere Zeile mit Umlauten äöü\nund noch eine"),
    (9, "größere Zeile mit Umlauten äöÜ\nund noch eine"),
    (10, "The quick brown fox jumps over the lazy cat today"),
]


def rebuilt(rows):
    gone = brute.line_classes(rows)
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in rows}


def test_line_dedup(docs):
    got = by_id(line_dedup.dedup_lines(docs([*LINES, (None, "shared line")])), "text", "kept_sha256")
    want = {i: (None if dict(LINES)[i] is None else t, sha256(t.encode()).hexdigest()) for i, t in rebuilt(LINES).items()}
    assert got == want


def test_line_dedup_family(docs):
    """Edited lines of one family, not all alike, over several documents."""
    rows = []
    for i in range(60):
        line = list("a long line of characters that many documents hold with small changes in it")
        for j in range(i % 7):
            line[(i * 17 + j * 9) % len(line)] = chr(65 + (i + j) % 26)
        rows.append((i, "".join(line) + f"\nown line number {i * 7919} {prose(i, 4)}"))
    got = by_id(line_dedup.dedup_lines(docs(rows)), "text")
    assert got == {i: (t,) for i, t in rebuilt(rows).items()}


def test_line_tiles_name_components():
    """A tile gives pairs of components, so that only these are joined again, not all lines."""
    line = "a long line of characters that many documents hold"
    members = [{"id": i, "label": label, "side": int(label == 7), "body": body} for i, label, body in ((11, 5, line), (12, 5, line + "!"), (13, 7, line + "?"))]
    batch = pa.RecordBatch.from_pylist([{"members": members + [dict(m, side=0) for m in members if m["side"]]}])
    found = pa.Table.from_batches(list(line_dedup._tile_links(iter([batch]))))
    assert found.to_pylist() == [{"a": 7, "b": 5}]


def test_line_dedup_stage(docs):
    df = docs([*LINES, (11, "shared line\nunique one here"), (None, "shared line")])
    out = line_dedup.with_lines_deduped(df)
    want = rebuilt([*LINES, (11, "shared line\nunique one here")])
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == df.columns
    assert 11 not in got and got[None] == "shared line" and got[4] is None and got[5] == ""
    assert all(got[i] == want[i] for i in got if i not in (None, 4))
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_quality_counts_and_thresholds(docs):
    junk = " ".join(f"w{i}$$$" for i in range(80))
    rows = [*EDGES, (20, junk), (21, "a b c " * 20 + prose(9, 90)), (22, "\n".join(["same line of text"] * 5) + prose(8, 80))]
    rows += [(100 + i, prose(100 + i, 80)) for i in range(120)]
    df = quality.judge(docs([*rows, (None, None)]))
    got = by_id(df, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {i: brute.quality_counts(t) for i, t in rows}
    verdict = by_id(df, "base_failed", "kept", "failed")
    assert verdict[20] == (False, False, "symbols") and verdict[4] == (True, False, "base")
    assert all(verdict[100 + i] == (False, True, None) for i in range(120))


def test_quality_null_groups(spark, docs):
    df = docs([(1, prose(1, 80)), (2, None)]).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert by_id(quality.judge(df), "kept") == {1: (True,), 2: (False,)}
    assert quality.judge(docs([])).count() == 0


def test_quantile_sketch(spark):
    values = [float(i) for i in range(1, 2001)]
    rows = spark.createDataFrame([("m", "a" if v % 2 else "b", v) for v in values], "metric string, k string, value double")
    fine = quality.sketch(rows, ["k"])
    (row,) = quality.quantiles(quality.merge(fine, []), []).collect()
    assert row["rows"] == 2000
    for got, want in ((row["lo"], 200), (row["mid"], 1000), (row["hi"], 1800)):
        assert got == pytest.approx(want, rel=0.011)


def test_mixing(spark, docs):
    rows = [(i, prose(i, 5 + i % 40), ("a", "b", "c", "d", None)[i % 5] if i % 3 else "a") for i in range(600)]
    df = docs(rows)
    out = mixing.mix_counts(df)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    stopped: set = set()
    while True:
        level = (1.5 * total - sum(2 * sizes[s] for s in stopped)) / sum(w for s, w in weight.items() if s not in stopped)
        more = {s for s in names if weight[s] * level > 2 * sizes[s]}
        if more == stopped:
            break
        stopped = more
    want = {s: float(2 * sizes[s]) if s in stopped else weight[s] * level for s in names}
    got = {r["doc_id"]: r for r in out.collect()}
    taken: dict = {}
    for i, t, s in rows:
        r = got[i]
        assert r["size"] == len(t.split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) < 0.12 * sizes[s] for s in names)
    assert sorted(map(tuple, mixing.mix_counts(df).collect())) == sorted(map(tuple, got.values()))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copy_no"]
    assert {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == {i: r["copies"] for i, r in got.items() if r["copies"]}


def test_mixing_without_words(docs):
    got = by_id(mixing.mix_counts(docs([(1, None, "a"), (2, "", None), (3, " ", "b")])), "size", "target", "copies")
    assert set(got.values()) == {(0, 0.0, 0)}
    assert mixing.mix_counts(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0


def test_language_model_base(docs):
    rows = [*EDGES, *((100 + i, prose(i % 9, 30)) for i in range(60))]
    got = by_id(suffix_tree_lm.score_texts(docs([*rows])), "n_tokens", "n_known", "train_tokens", "base_score")
    for i, want in brute.base_scores(rows).items():
        assert got[i][:3] == want[:3] and got[i][3] == pytest.approx(want[3], rel=1e-9)
    held = by_id(suffix_tree_lm.score_texts(docs([*rows, *rows[:2]])), "held_out")
    assert all(held[i] == (not brute.trained(i, 7),) for i, _ in rows)


def test_language_model_adds_up(docs):
    """The next-token distribution of every state, rare words included, adds up to 1, and contexts help held-out texts."""
    rows = [(i, " ".join(("red green blue cyan lime gold".split() * 8)[i % 6 : i % 6 + 36])) for i in range(300)]
    df = docs(rows).select("doc_id", "text", F.lit(True).alias("train"))
    model, _ = suffix_tree_lm.fit(df, 4)
    n, total = len(model["words"]), model["tokens"] + model["different"] + 1
    rare = (model["tokens"] - model["word_counts"].sum() + model["different"] - n + 1) / total
    for depth, state in model["state"].items():
        some = np.flatnonzero(state)[:20]
        assert depth > 1 or len(some)
        for c in some:
            context, word = np.full(n, c), np.arange(n)
            suffixes = {**model["suffixes"][depth], depth: np.arange(len(state))}
            p = suffix_tree_lm._probability(model, suffixes, word, context, depth)
            left = np.prod([model["left"][d][suffixes[d][c]] for d in range(1, depth + 1)])
            assert p.sum() + rare * left == pytest.approx(1.0, abs=1e-9)
    scored = suffix_tree_lm.score_texts(docs(rows)).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert scored[1] > 0.5 * scored[0]


def test_language_model_edges(docs):
    assert suffix_tree_lm.score_texts(docs([])).count() == 0
    rows = suffix_tree_lm.score_texts(docs([(None, "a b"), (3, None), (3, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["held_out"]) for r in rows) == [(0, 3, False), (3, 1, False), (3, 1, False)]


def toxic_rows(n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = prose(i, 40) + (f" you {('idiot', 'moron')[i % 2]}, such scum{i % 7}!" if bad else " kind words")
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, docs):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (0, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs([*rows, (1000, None), (None, "you idiot scum")]), marks)
    got = by_id(out, "held_out", "score", "predicted")
    for i, _, bad in labels:
        assert got[i][0] == (not brute.trained(i, 4)) and got[i][2] == bad
        assert 0 <= got[i][1] <= 1
    assert got[1000][2] == 0
    kept = toxicity.drop_toxic(docs(rows), marks)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, bad in labels if not bad}


def test_toxicity_covers_all_terms(spark, docs):
    """Evidence is the nearest by weighed TF-IDF over every term of the examples, also terms that are rare or tell nothing of the label."""
    rng = np.random.default_rng(5)
    words = [f"{'abcdefgh'[i % 8]}{i:02d}{'xyz'[i % 3] * (i % 5)}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(3, 30)))) for i in range(160)]
    marks = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score_toxicity(docs(rows), marks), "evidence")

    def terms(text):
        return text.split()

    held = {}
    for _, text in rows:
        for t in set(terms(text)):
            held[t] = held.get(t, 0) + 1
    examples = [i for i, _ in rows if brute.trained(i, 4)]
    in_terms = {i: set(terms(rows[i][1])) for i in examples}
    space = set().union(*in_terms.values())
    share = sum(i % 5 == 0 for i in examples) / len(examples)

    def factor(t):
        own = [i % 5 == 0 for i in examples if t in in_terms[i]]
        p = (sum(own) + toxicity.SHRINK * share) / (len(own) + toxicity.SHRINK)
        return np.log2(1 + p / (1 - p) * (1 - share) / share)

    factors = {t: factor(t) for t in space}

    def vector(text):
        own = [t for t in terms(text) if t in space]
        w = {t: (1 + np.log(own.count(t))) * (np.log((1 + len(rows)) / (1 + held[t])) + 1) * factors[t] for t in set(own)}
        length = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    vectors = {i: vector(text) for i, text in rows}
    for i, _ in rows:
        cosines = {e: round(sum(x * vectors[e].get(t, 0.0) for t, x in vectors[i].items()), 12) for e in examples}
        want = sorted((e for e in examples if 0 < cosines[e] < toxicity.TWIN), key=lambda e: (-cosines[e], e))[: toxicity.EVIDENCE]
        assert got[i][0] == want


def test_toxicity_keeps_the_class_mix(spark, docs, monkeypatch):
    """Scores follow the labels' class mix, also where FIT_ROWS takes as many rows of either class."""
    rows = [(i, f"{prose(i, 20)} {('even', 'odd')[i % 2]}") for i in range(600)]
    marks = spark.createDataFrame([(i, 1, int(i % 20 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    learnt = [i for i, _ in rows if brute.trained(i, 4)]
    share = sum(i % 20 == 0 for i in learnt) / len(learnt)
    monkeypatch.setattr(toxicity, "FIT_ROWS", (sum(i % 20 == 0 for i in learnt),) * 2)
    _, model = toxicity.fit(docs(rows).select("doc_id", "text"), marks)
    assert model["prior"] == pytest.approx(share, abs=0.02)
    got = by_id(toxicity.score_toxicity(docs([*rows, (1000, None)]), marks), "score")
    assert np.mean([v for (v,) in got.values()]) == pytest.approx(share, abs=0.05) and got[1000][0] < toxicity.REJECT


def test_toxicity_does_not_use_a_rows_own_label(spark, docs):
    """Turning the labels of a few clean rows leaves their scores low, whether they are fitted or not; so do their copies."""
    rows, labels = toxic_rows()
    turned = [i for i, _, bad in labels if not bad][::12]
    marks = spark.createDataFrame([(i, q, 1 if i in turned else bad) for i, q, bad in labels], "doc_id long, quality int, toxic int")
    copies = [(5000 + i, rows[i][1]) for i in turned]
    got = by_id(toxicity.score_toxicity(docs([*rows, *copies]), marks), "predicted")
    assert sum(got[i][0] + got[5000 + i][0] for i in turned) <= len(turned) // 5


def test_toxicity_of_long_texts_and_clashing_columns(spark, docs):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs([*rows, (2000, LONG), (2001, " ".join([LONG] * 3) + " you idiot"), (2002, None), (2002, "")])
    kept = toxicity.drop_toxic(df, marks)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, _, bad in labels if not bad} | {2000, 2002}


def test_toxicity_without_labels(spark, docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert by_id(toxicity.score_toxicity(docs([(1, "a"), (2, None)]), marks), "predicted") == {1: (0,), 2: (0,)}
    assert toxicity.score_toxicity(docs([]), marks).count() == 0


@pytest.mark.parametrize("common", [0, 6, 24])
def test_nearest_is_exact(monkeypatch, common):
    """The block-max search finds what a full scan finds, ties included, whether terms are frequent or rare."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = np.random.default_rng(3)
    terms, n = 40, 700
    examples = []
    for i in range(n):
        t = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        examples.append((i, int(rng.integers(2)), t.tolist(), (w / np.linalg.norm(w)).tolist()))
    seen = {}
    for e in examples:
        seen.setdefault((tuple(e[2]), tuple(np.round(e[3], 9))), e)  # one of equal vectors, as in the index
    examples = list(seen.values())
    n = len(examples)
    index = toxicity.build_index(examples, np.arange(terms, dtype=np.uint64), np.ones(terms))
    dense = np.zeros((n, terms))
    for i, (_, _, t, w) in enumerate(examples):
        dense[i, t] = w
    for q in range(50):
        t, w = np.array(examples[q][2]), np.array(examples[q][3])
        cosine = np.round(dense[:, t] @ w, 12)
        want = np.lexsort((np.arange(n), -cosine))[: toxicity.NEIGHBOURS]
        want = want[cosine[want] > 0]
        ((found, near),) = toxicity.nearest(index, np.zeros(len(t), np.int64), t, w, 1, twins=True)
        assert index["ids"][found].tolist() == [examples[i][0] for i in want] and np.allclose(near, cosine[want])


URLS = [
    (1, "http://Sub.Example.NET/en/7?x=1"),
    (2, "https://example.net/de/"),
    (3, "http://notexample.com/de/1"),
    (4, "http://a.example.com/de/1#t"),
    (5, "http://x.org/fr/2"),
    (6, "http://x.org"),
    (7, None),
    (8, "no scheme"),
    (9, ""),
    (10, "http://net/"),
    (11, "http://h.net?u=http://y.org/fr/"),
    (12, "x://a.com/" + "d" * 5000),
]


def test_url_rules(spark):
    more = [(100 + i, f"http://h{i}.example.{'com/de' if i % 2 else 'org/fr'}/{i}") for i in range(40)]
    pages = spark.createDataFrame([*URLS, *more, URLS[0]], "page_id long, url string").withColumns({"label": F.lit(1), "features": F.lit("f")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert got[1] == ("sub.example.net", "/en/7", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3][2] is None and got[4] == ("a.example.com", "/de/1", "example.com/de/", "block")
    assert got[5] == ("x.org", "/fr/2", "org/fr/", "allow") and got[6][:3] == ("x.org", "", None)
    assert got[7][:3] == got[8][:3] == got[9][:3] == ("", "", None)
    assert got[10][2:] == ("net/", "block") and got[11][:3] == ("h.net", "", None)
    assert {v[3] for v in got.values()} == {"allow", "block"}


def test_url_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.de/x")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(one).collect()} == {1: "block", 2: "block"}


def test_token_counts(docs):
    rows = [*EDGES, EDGES[0]]
    code = token_files.encoder()
    got = sorted(tuple(r) for r in token_files.count_tokens(docs(rows)).collect())
    assert got == sorted((i, len(code.encode_ordinary(t or ""))) for i, t in rows)
    assert token_files.count_tokens(docs([])).count() == 0


def test_token_scan_stitches_blocks(spark, tmp_path, monkeypatch):
    """Documents over many blocks, empty documents and a last one without an end."""
    monkeypatch.setattr(token_files, "SUPER", 3)
    lengths = [0, 5, 23, 0, 1, 64, 7]
    tokens = np.concatenate([np.append(np.arange(n) % 100, 999) for n in lengths] + [np.arange(11)]).astype("<u2")
    (tmp_path / "a.bin").write_bytes(tokens.tobytes() + b"\x01")
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(np.array([999], "<u2").tobytes())
    got = sorted(tuple(r) for r in token_files.scan_tokens(spark, str(tmp_path), 999, block_tokens=4).collect())
    starts = np.cumsum([0, *(n + 1 for n in lengths)]).tolist()
    want = [("a.bin", k, starts[k], n, True) for k, n in enumerate(lengths)] + [("a.bin", len(lengths), starts[-1], 11, False), ("c.bin", 0, 0, 0, True)]
    assert got == want
