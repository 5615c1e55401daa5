"""The queries opN_ at the smallest scale: contracts, and SQL where there is some."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from larkspur.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame, expected = QUERIES[name](spark, SF), db.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    assert Counter(tuple(r[n] for n in order) for r in frame.collect()) == Counter(tuple(dict(zip(names, r))[n] for n in order) for r in expected.fetchall())


def test_there_are_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def linked(documents, k=4, percent=80):
    """Component of each id, by comparing the shingle sets of all pairs, and the sets."""
    sets = {}
    for i, t in documents.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    least[y] = x
    return {i: find(i) for i in ids}, sets


def test_near_duplicates_by_brute_force(spark, documents):
    components, sets = linked(documents)
    got = QUERIES["op7_minhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in components.items()}
    assert len(set(components.values())) < len(components)


def test_near_duplicates_and_windows(spark, documents):
    near = QUERIES["op7_minhash_near_dedup"](spark, SF)
    assert set(near.columns) >= {"doc_id", "n_shingles", "component_id", "kept"}
    assert {r.doc_id for r in near.collect()} == set(documents)
    w, counts = 35, Counter()
    split = {i: t.encode().split() for i, t in documents.items()}
    for x in split.values():
        counts.update(tuple(x[k : k + w]) for k in range(len(x) - w + 1))
    for r in QUERIES["op9_substring_dedup"](spark, SF).collect():
        x = split[r.doc_id]
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if counts[tuple(x[k : k + w])] > 1:
                gone[k : k + w] = [True] * w
        kept = b" ".join(v for v, g in zip(x, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(x), sum(gone), hashlib.sha256(kept).hexdigest())


def test_sharding(spark, documents):
    rows = QUERIES["op6_sharding"](spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in documents.items()}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    ids = set(documents)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
            out = corpus_pipeline.cut(out, f"test-{k}")
            now = {r.doc_id for r in out.select("doc_id").collect()}
            assert now <= ids
            if k in (0, 2):
                assert len(now) < len(ids)
            if k == 3:
                assert now == ids
            ids, docs = now, out
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
