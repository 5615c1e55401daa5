"""Ranked search, license scans and whitening against brute force."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import lexical, licenses, whitening
from larkspur.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, item int, score string, term long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(texts):
    return [(i, t, "x", 1, "y", 2) for i, t in texts]


def search_texts(seed=3):
    rng = random.Random(seed)
    words = ["The", "the", "Ünder", "ünder", "x1", "foo", "Foo_bar", "a", "ab", "b-a", "日本", "end.", "K"]
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    copies = [(1000 - i, "foo the foo ab") for i in range(50)]  # ties, in falling order of ids
    odd = [(500, None), (501, ""), (502, "... --"), (None, "foo the foo ab"), (3, texts[3][1]), (3, texts[3][1]), (503, "foo " * 30_000), (504, "x" * 200_000), (505, "a\x00b\x7fab")]
    return texts + copies + odd


def brute_search(docs, items, k):
    terms = [TERM.findall(fold(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for t in terms if t), sum(map(len, terms))
    df, out = Counter(w for t in terms for w in set(t)), []
    asked: dict = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, []).extend(TERM.findall(fold(text)))
    counts = [Counter(t) for t in terms]
    for item, wanted in asked.items():
        found = []
        for (ident, _), tf, own in zip(docs, counts, terms, strict=True):
            m = 100 - 25 + (25 * len(own) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in wanted if tf[w])
            if score > 0:
                found.append((-score, ident is None, ident or 0, ident))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "Foo the foo"), (1, "Foo the foo"), (1, "ünder"), (2, "日本 x1 ab"), (3, None), (4, ""), (5, "nowhere else"), (None, "b a K"), (6, "the " * 5000 + "ab")]


@pytest.mark.parametrize("block, piece, held", [(100_000, 2_000_000, 400_000), (3, 40, 30)])
def test_search(spark, monkeypatch, block, piece, held):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "SLICE", piece)
    monkeypatch.setattr(lexical, "HELD", held)
    docs = search_texts()
    frame = spark.createDataFrame(rows_of(docs), DOCS).repartition(3)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, rank int")
    got = Counter(tuple(r) for r in lexical.rank_documents(frame, items, k=7).collect())
    assert got == brute_search(docs, ITEMS, 7)


def test_search_in_integers(spark, monkeypatch):
    """Scores too large for doubles are added up in integers."""
    monkeypatch.setattr(lexical, "EXACT", 1)
    item = [(1, "foo " * 300 + "ab"), (2, "ab")]
    docs = [(i, "foo ab" if i % 9 == 0 else "ab") for i in range(40)]
    got = Counter(tuple(r) for r in lexical.rank_documents(spark.createDataFrame(rows_of(docs), DOCS), spark.createDataFrame(item, "item_id long, text string"), k=3).collect())
    assert got == brute_search(docs, item, 3)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank_documents(docs, items).count() == 0
    assert lexical.rank_documents(spark.createDataFrame(rows_of([(1, "foo")]), DOCS), items.limit(0)).count() == 0


def spoiled(text, rng):
    """A notice with some words added and left out."""
    words = text.split()
    out = []
    for w in words:
        if rng.random() < 0.03:
            out.append("Example,")
        if rng.random() > 0.03:
            out.append(w.upper() if rng.random() < 0.2 else w)
    return " ".join(out)


def license_texts(seed=5):
    rng = random.Random(seed)
    common = ["the", "of", "rights", "license", "to", "and", "software", "wood", "tree", "river", "all", "cc", "by", "public", "general", "version", "2", "0"]
    noise = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [(i, noise(rng.randrange(0, 300))) for i in range(60)]
    for i, t in enumerate(licenses.TEMPLATES):
        texts.append((100 + i, f"{noise(20)} {t.text} {noise(20)}"))
        texts.append((300 + i, f"{noise(rng.randrange(0, 30))}\n{spoiled(t.text, rng)}\n{noise(5)}"))
        texts.append((500 + i, " ".join(t.text.split()[2:])))
    both = " ".join(t.text for t in licenses.TEMPLATES[:3])
    return texts + [(800, None), (801, ""), (802, " -- "), (803, both + " " + both), (None, "All Rights Reserved. CC BY-NC 4.0"), (804, "cc cc by by cc\nby"), (805, "all rights reserved " * 20_000), (806, "x" * 300_000), (100, texts[60][1]), (807, "under the GNU General Public License, version 2. " * 40)]


def brute_scan(docs, templates):
    """By comparing every template at every offset, without an index."""
    words = [TERM.findall(fold(t)) for _, t in docs]
    vocabulary = {w for t in templates for w in TERM.findall(fold(t.text))}
    df = Counter(w for x in words for w in set(x) & vocabulary)
    index = licenses.Index(templates, {w.encode(): n for w, n in df.items()}, len(docs))
    own = [TERM.findall(fold(t.text)) for t in templates]
    # what the index takes as anchors: equal words together, the rarest first, until they hold ANCHORS of the weight
    out, s = [], licenses.SLACK
    names = {v: k.decode() for k, v in index.number.items()}
    for (ident, _), x in zip(docs, words, strict=True):
        stands = lambda p, lo, hi: [i for i in range(max(lo, 0), min(hi, len(x)) - len(p) + 1) if x[i : i + len(p)] == p]
        base = [(label, i) for phrase, label in licenses.BASE.items() for i in stands(phrase.split(), 0, len(x))]
        found = []
        for t, (template, ws) in enumerate(zip(templates, own, strict=True)):
            anchors = {names[a] for a in index.anchors[t]}
            at = {a: [q for q, w in enumerate(ws) if w == a] for a in anchors}
            begins = sorted({i - q for i, w in enumerate(x) if w in anchors for q in at[w]})
            best = None
            for b in begins:
                share = sum(float(index.weights[t][q]) for q, w in enumerate(ws) if w in x[max(0, b + q - s) : max(0, b + q + s + 1)])
                exact = sum(float(index.weights[t][q]) for q, w in enumerate(ws) if 0 <= b + q < len(x) and x[b + q] == w)
                if share < licenses.LEAST - 1e-9 or not all(stands(TERM.findall(fold(p)), b - s, b + len(ws) + s) for p in template.phrases):
                    continue
                if best and b < best[0] + len(ws):
                    best = max(best, (b, share, exact), key=lambda f: (round(f[1], 9), round(f[2], 9), -f[0]))
                else:
                    found += [(template.label, t, *best[:2])] if best else []
                    best = (b, share, exact)
            found += [(template.label, t, *best[:2])] if best else []
        out.append((ident, len(x), sorted(base), sorted((a, b, c, round(d, 9)) for a, b, c, d in found)))
    return out


def test_license_scan(spark):
    docs = [d for d in license_texts() if d[0] not in (805,)]
    frame = spark.createDataFrame(rows_of(docs), DOCS).repartition(3)
    got = [(r.id, r.n_words, sorted((b.label, b.first_word) for b in r.base), sorted((f.label, f.template, f.first_word, round(f.share, 9)) for f in r.found)) for r in licenses.scan_licenses(frame).collect()]
    want = brute_scan(docs, licenses.TEMPLATES)
    assert Counter(map(repr, got)) == Counter(map(repr, want))
    labels = {i: {f[0] for f in found} for i, _, _, found in got}
    for i, t in enumerate(licenses.TEMPLATES):
        assert t.label in labels[100 + i]
    # notices with words added and left out are found where their key phrases stand
    texts = {i: " ".join(TERM.findall(fold(t))) for i, t in docs}
    whole = [i for i, t in enumerate(licenses.TEMPLATES) if len(t.text.split()) > 25 and all(p in texts[300 + i] for p in t.phrases)]
    assert len(whole) >= 5 and all(licenses.TEMPLATES[i].label in labels[300 + i] for i in whole)


def test_license_scan_of_many_places(spark):
    docs = [(805, "all rights reserved " * 20_000), (1, "Released under the MIT License. " * 3000)]
    got = {r.id: r for r in licenses.scan_licenses(spark.createDataFrame(rows_of(docs), DOCS)).collect()}
    assert len(got[805].base) == 20_000 and not got[805].found
    assert len([f for f in got[1].found if f.template == 1]) == 3000
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_templates_of_ones_own(spark):
    own = (licenses.Template("house", "may be read by the people of the house", ("read by the people",)),)
    docs = [(1, "It may be read, by the people of this house."), (2, "may be read by all of the people of the house"), (3, "house")]
    got = {r.id: [(f.label, f.first_word) for f in r.found] for r in licenses.scan_licenses(spark.createDataFrame(rows_of(docs), DOCS), templates=own).collect()}
    assert got == {1: [("house", 1)], 2: [], 3: []}
    with pytest.raises(ValueError, match="words"):
        licenses.scan_licenses(spark.createDataFrame(rows_of(docs), DOCS), templates=(licenses.Template("x", "...", ()),))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_license_query(spark):
    got = QUERIES["op12_license_scan"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        words = TERM.findall(fold(docs[r.doc_id]))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        for notice, label in (("Released under the MIT License", "mit"), ("under the Apache License, Version 2.0", "apache"), ("CC BY-NC 4.0", "cc-by-nc")):
            assert notice not in (docs[r.doc_id] or "") or label in r.labels.split(",")


VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, n int"


def whitened_brute(vectors, ids, components):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(object) + 1_000_000
    n, sums = len(x), x.sum(0)
    t = n * x - sums
    cov = (t.T @ t) / n**3
    values, vecs = np.linalg.eigh(cov.astype(float))
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > len(values) * 2.0**-52 * np.trace(cov.astype(float))][:components]
    w = (t / n).astype(float) @ (vecs[:, order] / np.sqrt(values[order]))
    return n, [int(s) for s in (t**2).sum(1)], w, values[order] / np.trace(cov.astype(float))


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + rng.normal(size=12) * 9).astype(np.float32)
    vectors = [list(map(float, v)) for v in base] + [list(map(float, base[0]))] * 40
    rows = [(i, v, 1, "a", 2, 3) for i, v in enumerate(vectors)] + [(5, vectors[5], 1, "a", 2, 3), (None, vectors[6], 1, "a", 2, 3)]
    fit = [r[1] for r in rows]
    rows += [(900, None, 1, "a", 2, 3), (901, [1.0] * 11 + [None], 1, "a", 2, 3), (902, [float("nan")] * 12, 1, "a", 2, 3), (903, [float("inf")] * 12, 1, "a", 2, 3), (904, [1.0] * 5, 1, "a", 2, 3), (905, [], 1, "a", 2, 3)]
    out, model, error = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3), components=8)
    n, deviations, want, explained = whitened_brute(fit, None, 8)
    assert model.n == n and error < 1e-9
    assert np.allclose(model.values / model.trace, explained, rtol=1e-9)
    got = {(r.id, int(r.deviation)): r.whitened for r in out.collect()}
    for r, d, w in zip(rows, deviations, want, strict=False):
        mine = np.array(got[r[0], d])
        assert np.allclose(np.abs(mine), np.abs(w), atol=1e-7)
    signs = [np.sign(got[r[0], d][0] * w[0]) for r, d, w in zip(rows, deviations, want, strict=False) if abs(w[0]) > 1e-3]
    assert len(set(signs)) == 1


def test_sums_are_exact_for_large_entries():
    rng = np.random.default_rng(4)
    for most in (1 << 20, 1 << 40, 1 << 61):
        y = rng.integers(-most, most, size=(50, 5))
        z = y.astype(object)
        assert whitening._column_sums(y) == list(z.sum(0))
        pairs = [int(((z[:, i] + z[:, j]) ** 2).sum()) for i in range(5) for j in range(i + 1, 5)]
        assert [int(v) for v in whitening._square_sums(y)] == [int(v) for v in (z * z).sum(0)] + pairs
    for total in (0, 5, -7, 1 << 150, -(1 << 150) - 12345):
        limbs = whitening._limbs(total)
        assert sum(v << (whitening.LIMB * k) for k, v in enumerate(limbs)) == total and all(abs(v) < 1 << 31 for v in limbs)


def test_whitening_of_extreme_entries(spark):
    rows = [(i, [float(1e30 * (i % 3)), float(i), 7.0], 1, "a", 2, 3) for i in range(30)]
    out, model, error = whitening.whiten(spark.createDataFrame(rows, VECTORS))
    assert model.n == 30 and len(model.values) >= 1 and out.count() == 30


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "a", 2, 3)], [(1, [], 1, "a", 2, 3)], [(1, [1.0, 2.0], 1, "a", 2, 3)] * 3])
def test_whitening_without_spread(spark, rows, tmp_path):
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_embedding_whitening"](spark, str(tmp_path))
    assert got.count() == 0
    assert [c for c, _ in got.dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviations, want, explained = whitened_brute([v for _, v in rows], None, 32)
    got = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    assert len(got) == 32 * len(rows) and {r.n for r in got} == {n} and all(r.identity_error < 1e-4 for r in got)
    place = {i: k for k, (i, _) in enumerate(rows)}
    for r in got:
        assert r.deviation == deviations[place[r.vec_id]]
        assert abs(abs(r.whitened) - abs(want[place[r.vec_id], r.component - 1])) < 1e-6
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-4
