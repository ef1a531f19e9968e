"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import cache
from hashlib import sha256


def words(text):
    return (text or "").encode().split()


def low_words(text):
    return (text or "").encode().lower().split()


def alnum_words(text):
    keep = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
    return (text or "").encode().lower().translate(keep).split()


def roots(nodes, links):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def similar(a, b, percent):
    both = len(a & b)
    return both > 0 and both * 100 >= (len(a) + len(b) - both) * percent


def shingle_set(text, k=5):
    w = low_words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_duplicates(rows):
    """doc_id -> (n_shingles, component_id, kept)."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similar(sets[a], sets[b], 75)]
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def without_repeats(rows, k=20):
    """doc_id -> (n_words, n_removed, kept text)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            gram = tuple(w[j : j + k])
            if gram in seen:
                gone[j : j + k] = [True] * k
            seen.add(gram)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), kept.decode())
    return out


def contamination(rows, items, window=10):
    """doc_id -> (n_words, n_hit, item ids)."""
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        k = min(window, len(w))
        for j in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[j : j + k]), set()).add(item)
    out = {}
    for i, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for k in {len(g) for g in windows}:
            for j in range(len(w) - k + 1):
                if (g := tuple(w[j : j + k])) in windows:
                    found |= windows[g]
                    hit.update(range(j, j + k))
        out[i] = (len(w), len(hit), sorted(map(str, found - {None})))
    return out


def line_classes(rows, k=7, percent=80):
    """(doc_id, line) of the lines to remove."""
    places = {}
    for i, text in sorted(rows):
        for n, line in enumerate([] if text is None else text.encode().lower().decode().split("\n")):
            if line.encode().strip():
                places.setdefault(line, []).append((i, n))
    sets = {}
    for line in places:
        full = line.ljust(k, "\0")
        sets[line] = {full[j : j + k] for j in range(len(full) - k + 1)}
    names = sorted(places)
    links = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :] if similar(sets[a], sets[b], percent)]
    groups = {}
    for line, root in roots(names, links).items():
        groups.setdefault(root, []).extend(places[line])
    return {at for group in groups.values() for at in sorted(group)[1:]}


def quality_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), len(inside)


def trained(doc_id, mod):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % mod != 2


def base_scores(rows):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: [*low_words(t), None] for i, t in rows}
    counts = Counter(x for i, t in tokens.items() if trained(i, 7) for x in t)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for i, t in tokens.items()}


def digest(text):
    return sha256(text.encode()).hexdigest()


def collocations(rows, least=100, top=2000, longest=5):
    """Sorted (lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= c[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (score, a, p, lower, upper) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), -a, lower, upper, n[lang], -score))
    return sorted(out)


def repaired(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        copies = {0: 0, 3: 2}.get(kind, 1)
        convs.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * copies)
    by_turn = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: repaired_one(sorted(v, key=by_turn)) for c, v in convs.items()}


def repaired_one(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state, inserted):
        """Cheapest, then least, way to finish from row i; from the end backwards, on plain strings."""
        offers = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            cost, audit, lines = best(i + 1, state, 0)
            offers.append((cost + 3, "D" + audit, lines))
            for role in {rows[i][1], "user", "assistant"} if faults[i] in ("", "truncated") else ():
                if to := step[state].get(role[:1]):
                    cost, audit, lines = best(i + 1, to, 0)
                    same = role == rows[i][1]
                    cost += (0 if same else 2) + (faults[i] == "truncated")
                    offers.append((cost, ("K" if same else "R") + audit, (f"{role}:{rows[i][2]}", *lines)))
        for role in ("user", "assistant") if inserted < 3 else ():
            if to := step[state].get(role[0]):
                cost, audit, lines = best(i, to, inserted + 1)
                offers.append((cost + 2, "I" + audit, (f"{role}:", *lines)))
        return min(offers, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def top_products(rows, every=50, k=5, held=(1 << 63) - 3):
    """Sorted (query_id, rank, vec_id, score) of (vec_id, vector) rows; scores end at `held`."""
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (q, a) in enumerate(whole):
        if q is None or q % every:
            continue
        products = [(max(-held, min(held, sum(x * y for x, y in zip(a, b, strict=False)))), i) for j, (i, b) in enumerate(whole) if j != at]
        scores = [(-s, i is None, i or 0) for s, i in products]
        out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)
