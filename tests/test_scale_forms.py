"""Forms of operators that hold at size, against brute force: snapshots by digest, places by range, key-wise similarity, prefix search, the ledger's table function."""

from __future__ import annotations

import bisect
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import context, ledger, placing, search, snapshots

MEMORY = "id int, content string, archived_at string, bucket int"


def files_read(frame):
    """Files of each scan of the executed plan."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    todo, out = [plan], []
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.metrics().contains("numFiles"):
            out.append(p.metrics().apply("numFiles").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_changes_between_snapshots_read_changed_buckets_only(spark):
    rows = [(i, f"c{i}", None, 1) for i in range(400)]
    before = spark.createDataFrame(rows, MEMORY)
    changed = {3: (3, "new", None, 1), 7: (7, "c7", "now", 1)}
    after = spark.createDataFrame([changed.get(r[0], r) for r in rows if r[0] != 5] + [(900, "added", None, 1)], MEMORY).repartition(3)
    a, b = (snapshots.write_snapshot(x, buckets=64) for x in (before, after))
    buckets = snapshots.changed_buckets(a, b)
    assert 1 <= len(buckets) <= 4
    got = snapshots.changes_between(a, b)
    assert {(r.id, r.operation) for r in got.collect()} == {(3, "update"), (7, "archive"), (5, "delete"), (900, "create")}
    want = {tuple(r) for r in ledger.change_log(before, after).collect()}
    assert {tuple(r) for r in got.collect()} == want
    whole = len(a.rows.inputFiles())
    assert whole > 50 and all(n <= len(buckets) for n in files_read(a.of(buckets)))
    assert sorted(files_read(got)) == sorted(len({f for f in s.of(buckets).select(F.input_file_name()).distinct().collect()}) for s in (a, b))
    same = snapshots.write_snapshot(before.repartition(7), buckets=64)
    assert snapshots.changed_buckets(a, same) == [] and snapshots.changes_between(a, same).count() == 0


def test_odd_snapshots(spark):
    none = snapshots.write_snapshot(spark.createDataFrame([], MEMORY), buckets=4)
    rows = spark.createDataFrame([(1, None, None, 1), (None, "x", None, 1), (2, "y" * 100_000, None, 1)], MEMORY)
    some = snapshots.write_snapshot(rows, buckets=4)
    twice = snapshots.write_snapshot(rows.unionByName(rows.filter("id = 2")), buckets=4)
    assert {r.operation for r in snapshots.changes_between(none, some).collect()} == {"create"}
    assert snapshots.changes_between(none, none).count() == 0 and len(snapshots.changed_buckets(some, twice)) == 1
    with pytest.raises(ValueError, match="dealt"):
        snapshots.changes_between(none, snapshots.write_snapshot(rows, buckets=8))
    with pytest.raises(ValueError, match="columns"):
        snapshots.changes_between(none, snapshots.write_snapshot(rows.drop("content"), buckets=4))
    with pytest.raises(ValueError, match="buckets"):
        snapshots.write_snapshot(rows, buckets=0)


@pytest.mark.parametrize("part", [7, 1_000_000])
def test_places(spark, part):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(40), "x") for i in range(300)]
    got = {r.id: r.at for r in placing.placed(spark.createDataFrame(rows, "id int, key string, seq int, other string"), "key", ["seq", "id"], "at", part).collect()}
    want = {}
    for key in {r[1] for r in rows}:
        want.update({r[0]: n for n, r in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])))})
    assert got == want
    assert placing.placed(spark.createDataFrame([], "id int, key string, seq int"), "key", ["seq", "id"], "at").count() == 0


VECTORS = "id int, key string, vector array<double>"


def near_rows(seed=8, n=240, d=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, d))
    v = base[rng.integers(20, size=n)] + rng.normal(size=(n, d)) * 0.35
    keys = ["hot"] * (n * 2 // 3) + [f"k{i % 5}" for i in range(n - n * 2 // 3)]
    return [(i, keys[i], [float(x) for x in v[i]]) for i in range(n)]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.mark.parametrize("most", [10, 4096])
def test_similar_by_key(spark, monkeypatch, most):
    monkeypatch.setattr(context, "ROUND", most)
    rows = near_rows()
    frame = spark.createDataFrame([*rows, (900, None, [1.0] * 6), (902, "hot", [0.0] * 6)], VECTORS)
    new, old = frame.filter("id % 3 = 0"), frame.filter("id % 3 <> 0")
    got = {r.id for r in context.similar_existing(new, old, "key", 0.85).collect()}
    want = {i for i, k, v in rows if i % 3 == 0 and all(cosine(v, w) <= 0.85 for j, o, w in rows if j % 3 and o == k)}
    assert got == want | {900}
    hashed = {r.id for r in context.similar_existing(new, old, "key", 0.85, bits=8).collect()}
    assert hashed >= got
    similar = sum(i % 3 == 0 for i, _, _ in rows) - len(want)
    assert len(hashed - got) <= 0.05 * similar  # recall of 0.95 or more


def test_hyperplanes_find_pairs_at_the_threshold(spark):
    """Pairs at a cosine of exactly 0.85 are found in 0.95 of the cases or more, those at 0.2 hardly compared."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        a, b = rng.normal(size=(2, 16))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = 0.8501 if i < 300 else 0.2
        rows += [(2 * i, f"p{i}", [float(x) for x in a]), (2 * i + 1, f"p{i}", [float(x) for x in c * a + math.sqrt(1 - c * c) * b])]
    frame = spark.createDataFrame(rows, VECTORS)
    new, old = frame.filter("id % 2 = 0"), frame.filter("id % 2 = 1")
    left = {r.id for r in context.similar_existing(new, old, "key", 0.85, bits=8).collect()}
    assert sum(i in left for i in range(0, 600, 2)) <= 15 and all(i in left for i in range(600, 1200, 2))
    tables = context.tables_for(0.85, 8)
    a, b = (context.signed(x, tables, 8) for x in (new, old))
    met = a.join(b.select("key", "table", "signature"), ["key", "table", "signature"]).filter("id >= 600").select("id").distinct().count()
    assert met < 300 * 0.35


def test_a_hot_key_leaves_other_keys_rows_alone(spark, monkeypatch):
    """How often a row of a small key travels doesn't depend on the largest key."""
    monkeypatch.setattr(context, "ROUND", 10)
    made = []
    keep = context.cut
    monkeypatch.setattr(context, "cut", lambda df, name: made.append(keep(df, name)) or made[-1])
    rows = near_rows()
    frame = spark.createDataFrame(rows, VECTORS)
    context.similar_existing(frame.filter("id % 3 = 0"), frame.filter("id % 3 <> 0"), "key", 0.85).collect()
    blocks = {r["_lk_k0"]: (r["_lk_na"], r["_lk_nb"]) for r in made[0].collect()}
    assert blocks.pop("hot") == (6, 11) and max(max(b) for b in blocks.values()) <= 2


@pytest.mark.parametrize("most, bits", [(7, None), (7, 8), (4096, None)])
def test_greedy_dedup_in_order(spark, monkeypatch, most, bits):
    monkeypatch.setattr(context, "ROUND", most)
    rows = [(i, k, (i * 7) % 50, v) for i, k, v in near_rows(n=90)]
    rows += [(500 + i, None, i, rows[i][3]) for i in range(20)]
    got = {r.id for r in context.greedy_dedup(spark.createDataFrame(rows, "id int, key string, seq int, vector array<double>"), "key", "seq", 0.85, bits).collect()}
    kept: dict = {}
    for i, k, s, v in sorted(rows, key=lambda r: (r[2], r[0])):
        if all(cosine(v, w) <= 0.85 for _, w in kept.setdefault(k, [])):
            kept[k].append((i, v))
    want = {i for some in kept.values() for i, _ in some}
    assert got == want if bits is None else len(got ^ want) <= 0.1 * len(rows)


@pytest.mark.parametrize("queries, held, rows_at_once", [(4096, 1_000_000, 1024), (7, 20, 9)])
def test_vector_join(spark, monkeypatch, queries, held, rows_at_once):
    """In one block and in several, with ties, odd vectors, other lengths and ids of text."""
    for name, value in (("QUERY_BLOCK", queries), ("HELD", held), ("ROW_BLOCK", rows_at_once)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(4)
    vectors = [(f"r{i:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    vectors += [(f"s{i}", vectors[5][1]) for i in range(6)] + [(f"t{i}", [float(x) for x in rng.normal(size=3)]) for i in range(20)]
    odd = [("n1", None), ("n2", [0.0] * 4), ("n3", [float("nan")] * 4), ("n4", [1.0, None, 1.0, 1.0]), ("n5", [])]
    asked = vectors[::4] + odd
    frame = lambda rows, name: spark.createDataFrame([(i, v, 1) for i, v in rows], f"{name} string, vector array<double>, score int").repartition(3)
    got: dict = {}
    for r in sorted(search.vector_join_top_k(frame(asked, "query_id"), frame(vectors + odd, "id"), 8).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    want = {q: [i for i, w in sorted(((i, w) for i, w in vectors if len(w) == len(v)), key=lambda x: (-round(cosine(v, x[1]), 12), x[0]))[:8]] for q, v in vectors[::4]}
    assert got == want
    assert search.vector_join_top_k(frame(asked, "query_id").limit(0), frame(vectors, "id"), 3).count() == 0
    assert search.vector_join_top_k(frame(asked, "query_id"), frame(vectors, "id").limit(0), 3).count() == 0


@pytest.mark.parametrize("part", [5, 1_000_000])
def test_prefix_search(spark, part):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab/é日") for _ in range(rng.randrange(1, n)))
    roots = sorted({word(6) for _ in range(60)} | {"a", "aa", "aaa", "a" * 50})
    paths = sorted({word(12) for _ in range(300)} | set(roots[:10]) | {"", "zzz", "a" * 200, "aab" * 3000})
    got = {r.path: r.root for r in context.prefix_search(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(r,) for r in roots], "root string"), part).collect()}
    want = {p: max((r for r in roots if p.startswith(r)), key=len) for p in paths if any(p.startswith(r) for r in roots)}
    assert got == want


def test_prefix_without_boundary(spark):
    paths = spark.createDataFrame([("/a/bc", 1), ("/a/bc", 2), (None, 3), ("/x", 4), ("", 5), ("/a", 6)], "path string, id int")
    roots = spark.createDataFrame([("one", "/a/b/"), ("two", "/a/b"), ("top", "/a"), ("all", "/"), ("none", None), ("empty", "")], "slug string, root string")
    got = {r.id: r.slug for r in context.longest_prefix(paths, roots, boundary=False).collect()}
    assert got == {1: "two", 2: "two", 3: None, 4: None, 5: None, 6: "top"}
    assert context.longest_prefix(paths, roots.limit(0), boundary=False).filter("slug is null").count() == 6


FIELDS = ["seq", "memory_id", "operation", "actor", "project_slug", "payload_hash", "prev_hash", "row_hash"]


@pytest.mark.parametrize("stretch", [10, 100_000])
def test_verify_chain_in_sql(spark, monkeypatch, stretch):
    """The table function against a walk over the rows, for ranges, gaps and tampered rows."""
    monkeypatch.setattr(ledger, "STRETCH", stretch)
    ledger.register_functions(spark)
    before, rows = None, []
    for seq in range(1, 46):
        own = ledger._hash_of(seq, f"m{seq}", "update", "bot", "p", f"h{seq}", before)
        rows.append((seq, f"m{seq}", "update", "bot", "p", f"h{seq}", before, own))
        before = own
    hashes = {r[0]: r for r in rows}

    def walk(data, start, end):
        have = {r[0]: r for r in data}
        previous = None
        if start > 1:
            if start - 1 not in have:
                return (0, None, None, "gap-before-start")
            previous = have[start - 1][7]
        for r in sorted(have.values()):
            if r[0] < start or (end is not None and r[0] > end):
                continue
            if r[6] != previous:
                return (r[0], previous or "", r[6] or "", "prev_hash-mismatch")
            own = ledger._hash_of(*r[:7])
            if own != r[7]:
                return (r[0], own, r[7], "row_hash-mismatch")
            previous = r[7]
        return None

    tampered = [(*r[:5], "other", *r[6:]) if r[0] == 23 else r for r in rows]
    cut_out = [r for r in rows if r[0] not in (10, 20, 31)]
    cases = [(rows, 1, None), (rows, 11, None), (rows, 20, 30), (rows, 100, None), (tampered, 1, None), (tampered, 1, 22), (tampered, 24, None), (cut_out, 1, None), (cut_out, 11, None), (cut_out, 21, 25), (cut_out, 12, 30), (rows[:1], 1, None), ([], 1, None), ([], 5, None)]
    seqs = sorted(hashes)
    assert bisect.bisect(seqs, 45) == 45
    for data, start, end in cases:
        spark.createDataFrame(data, "seq long, " + ", ".join(f"{f} string" for f in FIELDS[1:])).createOrReplaceTempView("whole_ledger")
        ledger.stretches(spark.table("whole_ledger"), start).createOrReplaceTempView("dealt_ledger")
        got = spark.sql(f"SELECT * FROM verify_chain(TABLE(dealt_ledger) PARTITION BY stretch ORDER BY seq, start_seq => {start}, end_seq => CAST({'NULL' if end is None else end} AS BIGINT)) ORDER BY broken_at_seq LIMIT 1").collect()
        assert [tuple(r) for r in got] == [w for w in [walk(data, start, end)] if w], (start, end)


def test_chains_take_no_nulls(spark):
    changes = spark.createDataFrame([(1, "m", "update", "bot", "p", "h"), (2, None, "update", "bot", "p", "h")], "seq long, memory_id string, operation string, actor string, project_slug string, payload_hash string")
    with pytest.raises(Exception, match="null"):
        ledger.build_chain(changes).collect()


ASKED, LOCKS = "job_id int, project_id string, file_path string", "project_id string, file_path string, job_id int, expires_at timestamp"
NOW = datetime.datetime(2026, 1, 1)


def granted_in_order(wants, locks):
    """Brute force: jobs one after the other."""
    taken = {}
    for p, f, j, until in locks:
        if until >= NOW and p is not None and f is not None:
            taken.setdefault((p, f), set()).add(j)
    got = set()
    for job in sorted({w[0] for w in wants if w[0] is not None}):
        mine = {w[1:] for w in wants if w[0] == job}
        if all(taken.get(m, {job}) == {job} for m in mine):
            got |= {(job, *m) for m in mine if m not in taken}
            taken.update({m: {job} for m in mine})
    return got


def most_rows(frame):
    """The most rows that an operator of the executed plan puts out."""
    frame.collect()
    todo, most = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.mark.parametrize("alone", [200_000, 60, 0])
def test_locks_go_in_order(spark, monkeypatch, alone):
    """By one task, by rounds and then one task, and by rounds only; with several holders of a path, and without a path or a job."""
    monkeypatch.setattr(context, "ALONE", alone, raising=False)
    rng = random.Random(7)
    path = lambda: ("p" if rng.random() < 0.8 else "q", None if rng.random() < 0.02 else f"f{rng.randrange(50)}")
    wants = [(None if rng.random() < 0.01 else rng.randrange(120), *path()) for _ in range(300)]
    wants += wants[:40]
    locks = [("p", f"f{i % 3}", rng.randrange(120), NOW) for i in range(5)] + [("q", "f9", 7, NOW), ("p", "f8", 7, NOW - datetime.timedelta(1)), ("p", "f20", wants[0][0], NOW)]
    got = context.grant_locks(spark.createDataFrame(wants, ASKED), spark.createDataFrame(locks, LOCKS), F.lit(NOW)).collect()
    assert len(got) == len({(r.job_id, r.project_id, r.file_path) for r in got})
    assert {(r.job_id, r.project_id, r.file_path) for r in got} == granted_in_order(wants, locks)


@pytest.mark.parametrize("alone, most", [(200_000, 2), (100, 40)])
def test_a_chain_of_waiting_jobs_takes_few_rounds(spark, monkeypatch, alone, most):
    """Each job waits for the one before, which is 150 rounds of two tables each if nothing but rounds decides."""
    made = []
    keep = context.cut
    monkeypatch.setattr(context, "ALONE", alone, raising=False)
    monkeypatch.setattr(context, "cut", lambda df, name: made.append(name) or keep(df, name))
    wants = [(i, "p", f"f{i + k}") for i in range(300) for k in (0, 1)]
    got = context.grant_locks(spark.createDataFrame(wants, ASKED), spark.createDataFrame([], LOCKS), F.lit(NOW)).collect()
    assert {(r.job_id, r.project_id, r.file_path) for r in got} == granted_in_order(wants, []) and {r.job_id for r in got} == set(range(0, 300, 2))
    assert len(made) <= most


def test_holders_and_requests_of_a_path_make_no_pairs(spark, monkeypatch):
    """300 jobs ask for what 300 jobs hold: 90,000 pairs, none of which is needed to refuse them."""
    most = []
    keep = context.cut
    monkeypatch.setattr(context, "cut", lambda df, name: most.append(most_rows(df)) or keep(df, name))
    wants = [(i, "p", "hot") for i in range(300)] + [(i, "p", f"f{i}") for i in range(600)]
    locks = [("p", "hot", i, NOW) for i in range(300, 600)]
    got = context.grant_locks(spark.createDataFrame(wants, ASKED), spark.createDataFrame(locks, LOCKS), F.lit(NOW)).collect()
    assert {r.job_id for r in got} == set(range(300, 600))
    assert 0 < max(most) <= 900
