"""Near-duplicates, repeated windows and repeated line chunks against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm import linededup, neardup, substring
from larkspur.session import cut

SCHEMA = "doc_id long, text string, _lk_id string, component_id int"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=1):
    """Originals, exact and near copies, shared passages, long runs of one word, empty, null and very long texts."""
    rng = random.Random(seed)
    out = []
    passage = words(rng, 60)
    for _ in range(60):
        w = words(rng, rng.randrange(1, 300))
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        out.append(w)
    for base in [w for w in out if len(w) > 80][:12]:
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(copy)
    strings = [" ".join(w) for w in out]
    strings += [strings[0], strings[0], "A b C", "a B c", "a b", "", "   \n", None, "z " * 90, "z " * 200, "é " + strings[3], " ".join(words(rng, 30_000))]
    rows = [(i, t, "clash", 7) for i, t in enumerate(strings)]
    # a row that repeats, and ids that repeat with other texts: copies, a lone one, one without words
    return [*rows, (3, strings[3], "clash", 7), (1, strings[40], "clash", 7), (2, strings[-3], "clash", 7), (4, "", "clash", 7), (5, "only here " * 3, "clash", 7)]


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups_of(sets, linked_too=()):
    """For each key the least that it is linked with; linked_too: pairs of keys that are linked anyway."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)

    for a, b in linked_too:
        link(a, b)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                link(a, b)
    return {i: find(i) for i in sets}


def components_of(rows, k):
    """For each row: (id, size of its set, component); rows of one id are one document."""
    sets = {(i, t or ""): shingle_set(t, k) for i, t, *_ in rows}
    of = {}
    for key in sorted(sets):
        of.setdefault(key[0], []).append(key)
    root = groups_of(sets, [(keys[0], x) for keys in of.values() for x in keys[1:]])
    return Counter((i, len(sets[i, t or ""]), root[i, t or ""][0]) for i, t, *_ in rows)


def test_near_duplicates(spark):
    rows, k = texts(), 4
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=k).collect()
    assert len(got) == len(rows)
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == components_of(rows, k)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_one_text_of_each_group_stays(spark):
    """The pipeline's stage, by brute force: rows are told apart by id and text, so a text outlives its id's other texts."""
    rows = [(i, t, "clash", 7) for i, t, *_ in texts(3)] + [(None, texts(3)[7][1], "clash", 7), (None, "no id", "clash", 7), (None, "no id", "clash", 7), (9, None, "x", 1), (9, "", "x", 1)]
    keys = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    root = groups_of({n: shingle_set(t, 5) for n, (_, t) in enumerate(keys)})
    expected = {key for n, key in enumerate(keys) if root[n] == n}
    df = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns and Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter(expected)
    a, b = " ".join(words(random.Random(1), 30)), " ".join(words(random.Random(2), 30))
    four = spark.createDataFrame([(0, a, "", 0), (1, a, "", 0), (1, b, "", 0), (2, b, "", 0)], SCHEMA)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, four, "").collect()} == {(0, a), (1, b)}
    assert {(r.id, r.component_id) for r in neardup.near_duplicates(four).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert neardup.remove_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block", [neardup.BLOCK, 8])
def test_near_duplicates_across_many_unlinked_copies(spark, monkeypatch, block):
    """A group whose members are alike, but mostly not enough: no link may be lost, nor in blocks of a few members."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(5)
    base = words(rng, 150)
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.randrange(2, 9)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "", 0))
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == components_of(rows, 4)


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e f", "", 0), (None, None, "", 0), (5, "a b c d e f", "", 0), (4, "A B C D E F", "", 0)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.id, r.component_id, r.kept) for r in got if r.id) == [(4, 4, True), (5, 4, False)]
    assert all(r.component_id is None and r.kept for r in got if r.id is None)


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("strings, weak", [(substring.HOT_STRINGS, False), (2, False), (2, True)])
def test_repeated_windows(spark, monkeypatch, strings, weak):
    """Without hot minimisers, with most of them hot, and with hashes of hot windows that several windows share."""
    monkeypatch.setattr(substring, "HOT_STRINGS", strings)
    monkeypatch.setattr(substring, "BUCKET_STRINGS", strings)
    monkeypatch.setattr(substring, "AT_ONCE", 7 if strings == 2 else 20_000)
    if weak:
        strong = substring._windows_of

        def windows_of(*a):
            row, at, h1, h2 = strong(*a)
            return row, at, h1 & np.uint64(15) << np.uint64(60), h2 & np.uint64(1)

        monkeypatch.setattr(substring, "_windows_of", windows_of)
    rows, w = texts(2), 35
    counts = Counter()
    for _, t, *_ in rows:
        x = (t or "").encode().split()
        counts.update(tuple(x[i : i + w]) for i in range(len(x) - w + 1))
    expected = Counter()
    for i, t, *_ in rows:
        x = (t or "").encode().split()
        gone = [False] * len(x)
        for a in range(len(x) - w + 1):
            if counts[tuple(x[a : a + w])] > 1:
                gone[a : a + w] = [True] * w
        expected[i, len(x), sum(gone), b" ".join(v for v, g in zip(x, gone) if not g).decode()] += 1
    got = substring.remove_repeated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got) == expected
    assert any(r.n_removed for r in got)


def largest_bucket(spark, monkeypatch, n):
    """Strings in the largest bucket or join key, and rows sent, for n texts that share a passage of 40 words."""
    rng, made = random.Random(n), {}

    def kept(df, name):
        made[name] = cut(df, name)
        return made[name]

    monkeypatch.setattr(substring, "cut", kept)
    passage = " ".join(words(rng, 40))
    rows = [(i, f"{' '.join(words(rng, 30, 10**12))} {passage} {' '.join(words(rng, 30, 10**12))}", "", 0) for i in range(n)]
    out = substring.remove_repeated(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert out.filter("n_removed <> 40 or n_words <> 100").count() == 0
    strings, hot = made["super-kmers"], made["hot-windows"]
    sizes = strings.filter("bucket >= 0").groupBy("bucket").count().agg({"count": "max"}).first()[0] or 0
    places = hot.filter("n is null").selectExpr("h1", "h2", "part", "size(ats) s").groupBy("h1", "h2", "part").agg({"s": "sum"}).agg({"sum(s)": "max"}).first()[0]
    return sizes, places, strings.count() + hot.count()


def test_copies_of_a_passage_fill_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_STRINGS", 200)
    monkeypatch.setattr(substring, "BUCKET_STRINGS", 200)
    monkeypatch.setattr(substring, "AT_ONCE", 500)
    few = largest_bucket(spark, monkeypatch, 2000)
    many = largest_bucket(spark, monkeypatch, 4000)
    assert max(*few[:2], *many[:2]) < 800
    assert many[2] / few[2] < 2.1


def test_repeated_windows_edges(spark):
    assert substring.remove_repeated(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, "", 0), (1, "", "", 0), (None, "q " * 40, "", 0)]
    got = substring.remove_repeated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (0, 0), (40, 40)]


def line_chunks(text, window=linededup.WINDOW, divisor=linededup.DIVISOR):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        rolled = 0
        for k in range(window):
            j = i - (window - 1) + k
            rolled = rolled * 31 + (h[j] if j >= 0 else 0)
        if rolled % divisor == 0 or i == len(lines) - 1:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def test_line_chunks(spark):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(60)]
    rows = []
    for i in range(80):
        own = [rng.choice(lines) if rng.random() < 0.2 else f"own {rng.random()}" for _ in range(rng.randrange(1, 25))]
        at = rng.randrange(40)
        rows.append((i, "\n".join(own + lines[at : at + rng.randrange(0, 20)]), "c", 1))
    rows += [(200, None, "c", 1), (201, "", "c", 1), (3, rows[3][1], "c", 1), (None, rows[5][1], "c", 1), (202, "\n\n\n\n", "c", 1)]
    rows += [(300 + k, "\n".join([*(f"long {i % 7000}" for i in range(20_000)), *lines]), "c", 1) for k in range(2)]  # very long
    distinct = sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    seen, expected = set(), {}
    for i, t in distinct:
        kept = []
        for c in line_chunks(t):
            body = "\n".join(c)
            if len(c) >= linededup.LEAST_LINES and body in seen:
                continue
            if len(c) >= linededup.LEAST_LINES:
                seen.add(body)
            kept.append(body)
        expected[i, t] = "\n".join(kept)
    df = spark.createDataFrame(rows, SCHEMA)
    got = linededup.remove_repeated_chunks(df).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, None if t is None else expected[i, t]) for i, t, *_ in rows)
    assert sum(r.lines_removed for r in got) > 0 and got[0]._lk_id == "c" and got[0].component_id == 1
    assert linededup.remove_repeated_chunks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_runs_inside_different_texts(spark):
    """Every run of two or more lines that occurs before goes, wherever it lies; the stage of the pipeline does the same."""
    rng = random.Random(9)
    passage, rows = [f"shared {i}" for i in range(40)], []
    for i in range(60):
        own = [f"own {rng.random()}" for _ in range(rng.randrange(2, 20))]
        at, a = rng.randrange(len(own) + 1), rng.randrange(36)
        own[at:at] = passage[a : a + rng.randrange(0, 5)]
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "z\nz\nz\nz\nz"), (103, "a\nz\nz\nz\nb"), (3, rows[3][1]), (None, rows[5][1]), (104, "\n".join(f"long {i % 7000}" for i in range(20_000)))]
    distinct = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    first, expected = {}, {}
    for i, t in distinct:
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 1):
            place = first.setdefault((lines[k], lines[k + 1]), (i, t, k))
            if place not in ((i, t, k), (i, t, k - 1)):
                gone |= {k, k + 1}
        expected[i, t] = [x for k, x in enumerate(lines) if k not in gone], len(gone)
    assert expected[102, rows[62][1]] == (["z", "z"], 3) and expected[103, rows[63][1]] == (["a", "b"], 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text, r.lines_removed) for r in linededup.remove_repeated_runs(df).collect())
    want = Counter((i, None, 0) if t is None else (i, "\n".join(expected[i, t][0]), expected[i, t][1]) for i, t in rows)
    assert got == want
    stage = corpus_pipeline.line_dedup(spark, df.selectExpr("*", "length(text) n_chars"), "").collect()
    assert Counter((r.doc_id, r.text) for r in stage) == Counter({(i, t): n for (i, t, m), n in want.items() if not m or t.split()})
    assert linededup.remove_repeated_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_go_by_chunks_first(spark, monkeypatch):
    """Without any pair of lines the chunks alone take out their copies; with them the result is that of all runs."""
    rng = random.Random(9)
    passage = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join([f"own {i} {rng.random()}" for _ in range(3)] + passage + [f"end {i}"])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    runs = told(linededup.remove_repeated_runs(docs))
    assert [r[2] for r in runs] == [0] + [12] * 5
    pairs = linededup.line_pairs
    monkeypatch.setattr(linededup, "line_pairs", lambda *a: pairs(*a).filter("false"))
    chunks = told(linededup.remove_repeated_runs(docs))
    assert chunks == told(linededup.remove_repeated_chunks(docs)) and sum(r[2] for r in chunks) > 0
