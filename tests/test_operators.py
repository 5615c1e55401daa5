"""Operators on small tables, against sequential versions where order matters."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from larkspur.operators import chunking, context, jobs, ledger, merge, ports, search
from larkspur.plans.catalog import select_only

NOW = dt.datetime(2024, 5, 1)


def stamp(h):
    return NOW + dt.timedelta(hours=h)


def test_plan_sources():
    assert search.plan_sources(None) == search.SearchPlan(None, None, True)
    assert search.plan_sources(["session"]) == search.SearchPlan(("chunk", "session_summary"), ("session",), False)
    assert search.plan_sources(["codebase"]) == search.SearchPlan((), None, True)
    assert search.plan_sources(["unknown"]) == search.SearchPlan((), None, False)


def _search_tables(spark):
    m = "id string, project_id string, kind string, title string, content string, embedding array<float>, provenance_id string, archived_at timestamp"
    memory = spark.createDataFrame([
        ("m1", "p", "chunk", "t", "c", [1.0, 0.0], "c1", None), ("m2", "p", "chunk", "t", "c", [0.9, 0.1], "gone", None), ("m3", "p", "decision", "t", "c", [0.8, 0.6], None, None),
        ("m4", "q", "chunk", "t", "c", [1.0, 0.0], "c2", None), ("m5", "p", "chunk", "t", "c", [1.0, 0.0], "c1", NOW), ("m6", "p", "issue", "t", "c", None, None, None), ("m7", "p", "pattern", "t", "c", [0.0, 0.0], None, None)], m)
    chunks = spark.createDataFrame([("c1", "session", "s1", 1, 2), ("c2", "note", None, None, None)], "id string, source_type string, source_id string, source_line_start int, source_line_end int")
    code = spark.createDataFrame([("f1", "p", "a.py", "sum", [0.7, 0.7])], "id string, project_id string, file_path string, summary string, embedding array<float>")
    sessions = spark.createDataFrame([("s1", "\n".join("abcdef"))], "id string, text string")
    return memory, chunks, code, sessions


def test_deep_search(spark):
    tables = _search_tables(spark)
    run = lambda **o: [r.id for r in search.deep_search(*tables, [1.0, 0.0], 10, **o).orderBy(F.desc("score"), "id").collect()]
    assert run(project_id="p") == ["m1", "m2", "m3", "f1"]
    assert run() == ["m1", "m4", "m2", "m3", "f1"]
    assert run(source_types=["session"], project_id="p") == ["m1"]
    assert run(source_types=["decision"]) == ["m3"] and run(source_types=["codebase"]) == ["f1"] and run(source_types=["nothing"]) == []
    hit = search.deep_search(*tables, [1.0, 0.0], 1, project_id="p", around=1).first()
    assert (hit.score, hit.reference, hit.context.text) == (1.0, "session_s1:1-2", "a\nb\nc")
    assert search.deep_search(*tables, [1.0, 0.0], 1, project_id="p", depth="none").first().context is None
    assert search.source_context(tables[1], tables[3], "c1", 1).first().context.total == 6


def test_merges(spark):
    target = spark.createDataFrame([(1, "a", "k", 5), (2, "b", "k", None)], "id int, p string, k string, v int")
    rows = spark.createDataFrame([(3, "a", "k", 9), (4, "c", "k", 7), (5, "c", "k", 8), (6, None, "k", 1), (7, None, "k", 2)], "id int, p string, k string, v int")
    new = merge.insert_ignore(target, rows, ["p", "k"], [F.col("id")])
    assert sorted(r.id for r in new.collect()) == [4, 6, 7]
    assert sorted(r.id for r in merge.insert_ignore(target.union(new), rows.filter("p is not null"), ["p", "k"], [F.col("id")]).collect()) == []
    up = {r.p: r.v for r in merge.upsert(target.select("p", "v"), spark.createDataFrame([("a", None, 1), ("b", 3, 1), ("b", 4, 2), ("z", 1, 1)], "p string, v int, t int"), ["p"], F.col("t"), keep_old=["v"]).collect()}
    assert up == {"a": 5, "b": 4, "z": 1}
    kept = merge.upsert(target.select("p", "v"), spark.createDataFrame([("a", 0, 1), ("z", 1, 1)], "p string, v int, t int"), ["p"], F.col("t"), overwrite=False)
    assert {r.p: r.v for r in kept.collect()} == {"a": 5, "b": None, "z": 1}
    assert {r.p: r.v for r in merge.fill_nulls(target, spark.createDataFrame([("a", 0), ("b", 2)], "p string, v int"), ["p"], ["v"]).collect()} == {"a": 5, "b": 2}
    found = merge.get_or_create(target, rows, ["p"])
    assert {(r.p, r.id, r.created) for r in found.filter("p is not null").collect()} == {("a", 1, False), ("c", 4, True), ("c", 4, False)}
    assert sorted((r.id, r.created) for r in found.filter("p is null").collect()) == [(6, True), (7, True)]
    twice = merge.get_or_create(target, spark.createDataFrame([("k1", 5), ("k1", 5), ("k1", 6)], "p string, id int"), ["p"])
    assert sorted(tuple(r) for r in twice.collect()) == [("k1", 5, False), ("k1", 5, False), ("k1", 5, True)]
    again = spark.createDataFrame([("a", None, 1), ("a", 9, 2), ("a", 7, 3), ("b", 4, 1)], "p string, v int, t int")
    assert sorted((r.p, r.v) for r in merge.coalesce_update(target.select("p", "v"), again, ["p"], ["v"], ["t"]).collect()) == [("a", 9), ("b", 4)]
    assert sorted((r.p, r.v) for r in merge.fill_nulls(target.select("p", "v"), again, ["p"], ["v"]).collect()) == [("a", 5), ("b", 4)]
    edges = spark.createDataFrame([("a", "b", "t")], "from_id string, to_id string, edge_type string")
    more = spark.createDataFrame([("a", "b", "t"), ("a", "a", "t"), ("b", "a", "t"), ("b", "a", "t")], "from_id string, to_id string, edge_type string")
    assert [tuple(r) for r in merge.insert_edges(edges, more).collect()] == [("b", "a", "t")]
    flags = merge.set_flag(spark.createDataFrame([], "key string, reasons array<string>, updated_at timestamp"), "k", ["r"], F.lit(NOW))
    assert merge.set_flag(flags, "k", ["s"], F.lit(NOW)).first().reasons == ["s"] and merge.clear_flag(flags, "k").count() == 0
    ranges = "project string, range_start int, range_end int"
    acted = merge.ensure_ranges(spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], ranges), spark.createDataFrame([("a", 1, 2), ("b", 3, 5), ("c", 6, 6)], ranges), ["project"])
    assert {r.project: r.action for r in acted.collect()} == {"a": "existing", "b": "update", "c": "insert"}
    leases = spark.createDataFrame([(1, stamp(-1)), (2, NOW), (3, stamp(1))], "id int, expires_at timestamp")
    assert sorted(r.id for r in merge.delete_expired(leases, F.lit(NOW)).collect()) == [2, 3]
    js = spark.createDataFrame([(1, "approved", None), (2, "qa", None), (3, "failed", NOW)], "id int, status string, archived_at timestamp")
    done = {r.id: r.archived_at for r in merge.soft_archive(js, js, F.lit(stamp(1)), jobs.TERMINAL).collect()}
    assert done == {1: stamp(1), 2: None, 3: NOW}
    memory = spark.createDataFrame([("m1", "x"), ("m2", "x"), ("y", None)], "id string, provenance_id string")
    ids = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    assert {r.id: r.memory_id for r in merge.resolve_memory_ids(memory, ids).collect()} == {"x": "m1", "y": "y", "z": None}
    summary = spark.range(1).select(merge.session_summary(done=F.lit("a"), next=F.lit(""), files=F.lit(None).cast("string"), notes=F.lit("b"))).first()[0]
    assert summary == "Done: a\nNotes: b"


def test_import(spark):
    target = spark.createDataFrame([("p1", "x", "chunk")], "project_id string, provenance_id string, kind string")
    rows = spark.createDataFrame([("x", "chunk", "s"), ("y", "chunk", "s"), ("z", "chunk", "new"), ("w", "chunk", None)], "provenance_id string, kind string, project_slug string")
    out = merge.import_rows(target, rows, spark.createDataFrame([("s", "p1")], "slug string, id string"), ["provenance_id", "kind"], [F.col("provenance_id")])
    assert {(r.provenance_id, r.project_id) for r in out["insert"].collect()} == {("y", "p1"), ("z", "new:new")}
    assert [r.slug for r in out["projects"].collect()] == ["new"]
    c = out["counters"].first()
    assert (c.rows, c.inserted, c.skipped_no_slug, c.skipped_dup) == (4, 2, 1, 1)


def test_backfill(spark):
    """Counts by reason, one failing batch doesn't stop the others, and a second run inserts nothing."""
    rows = spark.createDataFrame([(f"r{i}", None if i % 10 == 0 else "p", f"c{i}", "" if i % 10 == 1 else "text") for i in range(100)], "id string, project_id string, title string, content string")
    store = [spark.createDataFrame([("p", "t", "x", "r2", "chunk"), ("p", "t", "x", "r3", "decision")], "project_id string, title string, content string, provenance_id string, kind string")]
    calls = []

    def append(new):
        calls.append(new.count())
        if len(calls) == 2:
            raise OSError("full")
        store[0] = store[0].unionByName(new)

    run = lambda: merge.backfill(rows, lambda: store[0], "chunk", F.col("content") != "", append, 20)
    first = run()
    assert (first["scanned"], first["skipped_no_project"], first["skipped_invalid"], first["batch_failures"]) == (100, 10, 10, 1) and len(calls) == 4
    assert first["inserted"] == sum(calls) - calls[1] and first["skipped_dup"] <= 1
    second, third = run(), run()
    assert second["inserted"] == calls[1] and second["batch_failures"] == 0 and (third["inserted"], third["skipped_dup"]) == (0, 80)
    assert store[0].filter("kind = 'chunk'").count() == 80


def test_project_context(spark):
    projects = spark.createDataFrame([("s", "p", "S", "d")], "slug string, id string, name string, description string")
    memory = spark.createDataFrame([(i, "p", ["decision", "issue", "pattern"][i % 3], f"t{i}", f"c{i}", stamp(i), NOW if i == 3 else None) for i in range(24)], "id int, project_id string, kind string, title string, content string, created_at timestamp, archived_at timestamp")
    states = ["queued", "approved", "failed", "reviewing"]
    job = spark.createDataFrame([(i, "p" if i != 8 else "q", f"j{i}", states[i % 4], "x", "b", 0, stamp(i), stamp(-i), stamp(-30) if i == 1 else stamp(-2) if i in (2, 4) else None) for i in range(16)], "id int, project_id string, title string, status string, current_phase string, branch_name string, error_count int, created_at timestamp, updated_at timestamp, archived_at timestamp")
    locks = spark.createDataFrame([("p", stamp(1)), ("p", NOW), ("q", stamp(1))], "project_id string, expires_at timestamp")
    r = context.project_context(projects, memory, job, locks, "s", F.lit(NOW)).collect()
    assert len(r) == 1 and r[0].project.asDict() == {"name": "S", "description": "d"} and r[0].active_file_locks == 1
    assert [d.title for d in r[0].recent_decisions] == ["t21", "t18", "t15", "t12", "t9"] and r[0].recent_decisions[0].rationale is None
    assert [d.description for d in r[0].recent_issues] == ["c22", "c19", "c16", "c13", "c10"] and [d.name for d in r[0].relevant_patterns][0] == "t23"
    assert [j.title for j in r[0].active_jobs] == ["j15", "j12", "j11", "j7", "j3"]
    assert [j.title for j in r[0].recent_completed_jobs] == ["j2", "j5", "j6", "j9", "j10"]
    with pytest.raises(ValueError):
        context.project_context(projects, memory, job, locks, "other", F.lit(NOW))


def _chain(n=300):
    rows, prev = [], None
    for seq in range(1, n + 1):
        r = [seq, f"m{seq % 7}", "create", "bot", "p" if seq % 2 else "q", hashlib.sha256(str(seq).encode()).hexdigest(), prev]
        own = hashlib.sha256("|".join([str(r[0]), *r[1:6], prev or ""]).encode()).hexdigest()
        rows.append([*r, own])
        prev = own
    return rows


LEDGER = "seq long, memory_id string, operation string, actor string, project_slug string, payload_hash string, prev_hash string, row_hash string"


@pytest.mark.parametrize("stretch", [100_000, 40])
def test_ledger(spark, monkeypatch, stretch):
    monkeypatch.setattr(ledger, "STRETCH", stretch)
    rows = _chain()
    verify = lambda data, *a: [tuple(r) for r in ledger.verify_chain(spark.createDataFrame(data, LEDGER), *a).collect()]
    assert verify(rows) == [] and verify(rows, 100, 200) == [] and verify([]) == []
    changed = [list(r) for r in rows]
    changed[99][3] = "other"
    assert [(r[0], r[3]) for r in verify(changed)] == [(100, "row_hash")]
    assert [(r[0], r[1], r[2], r[3]) for r in verify([r for r in rows if r[0] != 150])] == [(151, rows[148][7], rows[149][7], "prev_hash")]
    changed = [list(r) for r in rows]
    changed[49][7] = "0" * 64
    assert [(r[0], r[3]) for r in verify(changed)] == [(50, "row_hash")]
    assert verify([r for r in rows if r[0] != 150], 151) == [(0, None, None, "gap-before-start")]
    df = spark.createDataFrame(rows, LEDGER)
    assert [tuple(r) for r in ledger.build_chain(df.drop("prev_hash", "row_hash")).orderBy("seq").collect()] == [tuple(r) for r in rows]
    assert tuple(ledger.slug_range(df, "q").first()) == (2, 300) and ledger.range_count(df, 10, 20, "p").first().n == 5


def test_a_stretch_is_read_by_itself(spark, monkeypatch):
    """Building a chain of many stretches reads each change twice, once to deal it and once to chain it, and no row of the chain."""
    monkeypatch.setattr(ledger, "STRETCH", 10)
    read, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **options: read.append(found := parquet(self, *paths, **options)) or found)
    rows = _chain(95)
    got = ledger.build_chain(spark.createDataFrame(rows[::-1], LEDGER).drop("prev_hash", "row_hash"))
    assert [tuple(r) for r in got.orderBy("seq").collect()] == [tuple(r) for r in rows]
    # the changes for their stretches' numbers, ten stretches, and the result
    assert len(read) == 12 and sum(len(d.inputFiles()) for d in read[1:-1]) == 10


def test_rows_that_ask_for_a_key_are_not_sorted(spark):
    """The rows of get_or_create stream past their keys, without a window that sorts them; rows that repeat, nulls and known keys come out as said."""
    target = spark.createDataFrame([("a", -1)], "k string, id int")
    rows = spark.createDataFrame([("a", 5), ("b", 3), ("b", 2), ("b", 2), (None, 7), (None, 7), ("c", None), ("d", None), ("d", 4)], "k string, id int")
    got = merge.get_or_create(target, rows, ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", -1, False), ("b", 2, False), ("b", 2, False), ("b", 2, True), (None, 7, True), (None, 7, True), ("c", None, True), ("d", 4, False), ("d", 4, True)], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("pairs", [4_000_000, 50])
def test_overlaps_follow_the_pairs(spark, monkeypatch, pairs):
    """Many ranges in one place are dealt over many tasks, though they have few bytes; each pair comes once, also of long, single, reversed and negative ranges."""
    monkeypatch.setattr(ports, "PAIRS", pairs)
    rng = random.Random(3)
    starts = [rng.randrange(-20, 60) for _ in range(150)]
    rows = [(i, "hot" if i % 5 else "b", a, a + rng.choice([-2, 0, 1, 7, 40])) for i, a in enumerate(starts)] + [(200, None, 1, 2), (201, "b", None, 2)]
    df = spark.createDataFrame(rows, "id int, host string, range_start int, range_end int")
    joined = ports.overlap_join(df, df, "host")
    got = [(r.left_id, r.right_id) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and None not in (a[2], b[2]) and a[2] <= b[3] and b[2] <= a[3]}
    assert pairs > 50 or joined.rdd.getNumPartitions() > 50


def test_change_log(spark):
    s = "id int, content string, archived_at timestamp"
    before = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", NOW), (4, "d", None), (5, "e", None)], s)
    after = spark.createDataFrame([(1, "a", None), (2, "b", NOW), (3, "c", None), (4, "x", None), (6, "f", None)], s)
    assert {r.id: r.operation for r in ledger.change_log(before, after).collect()} == {2: "archive", 3: "restore", 4: "update", 5: "delete", 6: "create"}


@pytest.mark.parametrize(("base", "size", "occupied", "cap", "expected"), [
    (3000, 1, [], 65535, 3000), (3000, 1, [(8000, 8000)], 65535, 3000), (3000, 1, [(3000, 3010)], 65535, 3011), (3000, 5, [(3000, 3010), (3050, 3060)], 65535, 3011),
    (20000, 50, [(20050, 20100)], 65535, 20000), (3000, 10, [(3000, 3009), (3015, 3020)], 65535, 3021), (3000, 1, [(3000, 3050)], 3050, None), (3000, 5, [(3050, 3060), (3000, 3010), (3030, 3035)], 65535, 3011)])
def test_first_free(spark, base, size, occupied, cap, expected):
    df = spark.createDataFrame([("h", 1, 1), *[("h", a, b) for a, b in occupied]], "host string, range_start int, range_end int")
    got = [tuple(r) for r in ports.first_free(df, base, size, cap).collect()]
    assert got == ([] if expected is None else [("h", expected, expected + size - 1)])


def test_ports(spark):
    with pytest.raises(ValueError):
        ports.first_free(spark.createDataFrame([("h", 1, 1)], "host string, range_start int, range_end int"), 3000, 0)
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), s, s + rng.randrange(300)) for i in range(120) for s in [rng.randrange(1, 3000)]]
    df = spark.createDataFrame(rows, "id int, host string, range_start int, range_end int")
    got = {(r.left_id, r.right_id) for r in ports.overlap_join(df, df, "host").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    s = "host string, range_start int, range_end int"
    active, archived = spark.createDataFrame([("h", 3000, 65500)], s), spark.createDataFrame([("h", 65501, 65535)], s)
    assert [tuple(r) for r in ports.suggest(active, archived, 3000, 10).collect()] == [("h", 65501, 65510, True)]
    assert [tuple(r) for r in ports.suggest(active.filter("false").union(spark.createDataFrame([("h", 5000, 5001)], s)), archived, 3000, 10).collect()] == [("h", 3000, 3009, False)]
    held = spark.createDataFrame([("p", "h", "web", 1, 2, NOW, None), ("q", "h", "db", 1, 2, stamp(-5), stamp(-1))], "project_id string, host string, purpose string, range_start int, range_end int, assigned_at timestamp, archived_at timestamp")
    after = ports.reclaim(held, "h", 1, 2, "z", F.lit(stamp(1))).collect()
    assert {(r.project_id, r.purpose, r.archived_at) for r in after} == {("p", "web", stamp(1)), ("q", "db", stamp(-1)), ("z", "web", None)}


ART = "id int, job_id int, phase string, artifact_type string, content string, findings_count int, blocking_count int, created_at timestamp"


def test_jobs(spark):
    rows = [(1, 1, "planning", "plan_doc", "", 0, 0, stamp(0)), (2, 1, "reviewing", "arch_review", "BLOCKING: old", 3, 2, stamp(1)), (3, 1, "reviewing", "security_review", "", 0, 0, stamp(2)), (4, 1, "fix_loop", "diff", "", 0, 0, stamp(3)),
            (5, 1, "reviewing", "arch_review", "BLOCKING: new", 1, 1, stamp(4)), (6, 1, "reviewing", "security_review", "", 0, 0, stamp(5)), (7, 2, "review", "arch_review", "", 1, 1, stamp(0)), (8, 3, "qa", "qa_report", "", None, None, stamp(0))]
    a = spark.createDataFrame(rows, ART)
    p = {r.job_id: r for r in jobs.phase_counts(a).collect()}
    assert p[1].phase_counts == {"planning": 1, "reviewing": 4, "fix_loop": 1} and p[1].phases == ["planning", "reviewing", "fix_loop"] and (p[1].total_findings, p[1].total_blocking) == (4, 3) and p[3].total_blocking == 0
    assert {r.job_id: r.category for r in jobs.failure_category(a).collect()} == {1: "qa_failure", 2: "persistent_blocking", 3: "unknown"}
    assert {r.job_id: r.converging for r in jobs.fix_convergence(a).collect()} == {1: True, 2: False, 3: False}
    assert sorted(r.id for r in jobs.last_round(a).collect()) == [2, 3]
    assert sorted(r.id for r in jobs.since_marker(a, jobs.FIXES).filter("job_id = 1").collect()) == [4, 5, 6]
    assert [(r.job_id, r.item) for r in jobs.prior_items(a).collect()] == [(1, "old")]
    j = spark.createDataFrame([(1, "queued", 0, 1, NOW, None), (2, "queued", 0, 5, stamp(1), None), (3, "queued", 0, 5, NOW, None), (4, "qa", 2, 9, NOW, None), (5, "queued", 0, 9, NOW, NOW), (6, "blocked", 0, 0, NOW, None)], "id int, status string, error_count int, priority int, created_at timestamp, archived_at timestamp")
    assert jobs.next_queued(j).first().id == 3
    moved = {r.id: (r.status, r.error_count) for r in jobs.transition(j, spark.createDataFrame([(4, "fix_loop"), (1, "qa"), (2, "planning")], "id int, new_status string")).collect()}
    assert moved[4] == ("fix_loop", 3) and moved[1] == ("queued", 0) and moved[2] == ("planning", 0)
    resolved = jobs.resolve_blocked(j.withColumn("blocked_resolution", F.lit(None).cast("string")), spark.createDataFrame([(6, "replan"), (1, "cancel")], "id int, resolution string"))
    assert {r.id: (r.status, r.blocked_resolution) for r in resolved.collect() if r.id in (1, 6)} == {1: ("queued", None), 6: ("planning", "replan")}
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "planning"), (1, 3, "qa"), (1, 4, "failed"), (1, 5, "queued")], "job_id int, seq int, status string")
    assert [(r.seq, r.before) for r in jobs.illegal_transitions(log).collect()] == [(3, "planning")]
    conflicts = spark.createDataFrame([(10, 4), (11, 20), (12, 21)], "job_id int, blocking_job_id int")
    others = spark.createDataFrame([(4, "qa"), (20, "deployed"), (21, "failed")], "id int, status string")
    assert {r.job_id: r.recommendation for r in jobs.blocked_recommendation(conflicts, others).collect()} == {10: "wait", 11: "replan", 12: "proceed"}
    gate = "job_id int, round int, blocking_count int, warning_count int, malformed_multiple boolean, error_count int, repeating boolean"
    reviews = spark.createDataFrame([(1, 1, 1, 0, False, 0, False), (2, 1, 0, 2, False, 0, False), (3, 1, 0, 2, False, 1, True), (4, 1, 0, 0, True, 0, False), (5, 1, 0, 0, False, 0, False)], gate)
    verdicts = {r.job_id: (r.next_status, r.reason) for r in jobs.review_gate(reviews, True).collect()}
    assert verdicts == {1: ("fix_loop", "blocking"), 2: ("fix_loop", "warnings"), 3: ("failed", "warning_oscillation"), 4: ("fix_loop", "malformed_review"), 5: ("qa", "clean")}
    assert {r.job_id: r.next_status for r in jobs.review_gate(reviews, False).collect()}[2] == "qa"


def test_context(spark):
    paths = spark.createDataFrame([("/code/foo/sub/x/",), ("/code/foo",), ("/code/foobar",), ("/none",), ("",)], "path string")
    roots = spark.createDataFrame([("foo", "/code/foo"), ("sub", "/code/foo/sub")], "slug string, root string")
    assert {r.path: r.slug for r in context.longest_prefix(paths, roots).collect()} == {"/code/foo/sub/x/": "sub", "/code/foo": "foo", "/code/foobar": None, "/none": None, "": None}
    assert {r.path: r.slug for r in context.longest_prefix(paths, roots, boundary=False).collect()}["/code/foobar"] == "foo"
    rows = spark.createDataFrame([(1, None, "/code/foo/a"), (2, "own", "/x"), (3, None, None)], "id int, project string, path string")
    assert {r.id: (r.project, r.outcome) for r in context.attribute_orphans(rows, roots).collect()} == {1: ("foo", "attributed"), 2: ("own", "kept"), 3: (None, "unrecoverable")}
    locks = spark.createDataFrame([("p", "shared", 1, stamp(1)), ("p", "only1", 1, stamp(1)), ("p", "old", 1, stamp(-1)), ("p", "edge", 1, NOW)], "project_id string, file_path string, job_id int, expires_at timestamp")
    asked = spark.createDataFrame([(2, "p", "shared"), (2, "p", "only2"), (3, "p", "old"), (3, "p", "free"), (4, "p", "free"), (5, "q", "shared"), (6, "p", "edge")], "job_id int, project_id string, file_path string")
    assert {(r.job_id, r.file_path, r.owner_job_id) for r in context.lock_conflicts(asked, locks, F.lit(NOW)).collect()} == {(2, "shared", 1), (6, "edge", 1)}
    assert {(r.job_id, r.file_path) for r in context.grant_locks(asked, locks, F.lit(NOW)).collect()} == {(3, "old"), (3, "free"), (5, "shared")}
    # a job that is refused takes nothing, so a later one gets what both want; and so along a chain
    wants = [(1, "p", "a"), (1, "p", "b"), (2, "p", "b"), (3, "q", "x"), (4, "q", "x"), (4, "q", "y"), (5, "q", "y"), (5, "q", "z"), (6, "q", "z"), (7, "q", "y")]
    held = locks.limit(0).unionByName(spark.createDataFrame([("p", "a", 9, stamp(1))], locks.schema))
    got = context.grant_locks(spark.createDataFrame(wants, asked.schema), held, F.lit(NOW)).collect()
    assert {(r.job_id, r.file_path) for r in got} == {(2, "b"), (3, "x"), (5, "y"), (5, "z")}
    rng = random.Random(3)
    wants = [(rng.randrange(60), "p", f"f{rng.randrange(40)}") for _ in range(150)]
    taken = {f"f{k}": -1 for k in range(3)}
    for job in sorted({w[0] for w in wants}):
        mine = {w[2] for w in wants if w[0] == job}
        if not mine & taken.keys():
            taken.update(dict.fromkeys(mine, job))
    held = spark.createDataFrame([("p", f"f{k}", -1, stamp(1)) for k in range(3)], locks.schema)
    got = context.grant_locks(spark.createDataFrame(wants, asked.schema), held, F.lit(NOW)).collect()
    assert {r.file_path: r.job_id for r in got} == {f: j for f, j in taken.items() if j >= 0}
    devs = spark.createDataFrame([("a", [("mail", "a@x"), ("sms", "1")], ["done"]), ("b", [("mail", "b@x")], [])], "dev_id string, channels array<struct<type:string,address:string>>, event_subscriptions array<string>")
    events = spark.createDataFrame([(1, "done", "a"), (2, "odd", "a"), (3, "done", "zz"), (4, "done", "b")], "event_id int, event_type string, recipient string")
    assert {(r.event_id, r.channel, r.outcome) for r in context.route(events, devs, ["mail"], ["done"]).collect()} == {(1, "mail", "send"), (2, None, "skipped"), (3, None, "unknown_dev"), (4, None, "not_subscribed")}
    two = spark.createDataFrame([(1, "blocked", "a", "b"), (2, "blocked", "a", "a"), (3, "done", "a", "b")], "event_id int, event_type string, recipient string, blocking_dev string")
    assert sorted((r.event_id, r.recipient) for r in context.fan_out(two).collect()) == [(1, "a"), (1, "b"), (2, "a"), (3, "a")]
    same = devs.select(context.add_channel(F.col("channels"), "mail", "a@x").alias("c"), context.remove_channel(F.col("channels"), "mail", "a@x").alias("r"), "dev_id").filter("dev_id = 'a'").first()
    assert len(same.c) == 2 and len(same.r) == 1
    assert context.write_drift(locks.limit(0), locks) and not context.write_drift(locks, locks)


@pytest.mark.parametrize("most", [context.ROUND, 12])
def test_greedy_dedup(spark, monkeypatch, most):
    """In one round and in several."""
    monkeypatch.setattr(context, "ROUND", most)
    rng = random.Random(3)
    rows = [(i, f"k{i % 3}", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    got = {r.id for r in context.greedy_dedup(spark.createDataFrame(rows, "id int, key string, seq int, vector array<double>"), "key", "seq", 0.5).collect()}
    kept = {}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for i, k, _, v in rows:
        if all(cos(v, w) <= 0.5 for _, w in kept.setdefault(k, [])):
            kept[k].append((i, v))
    assert got == {i for v in kept.values() for i, _ in v}
    df = spark.createDataFrame([*rows, (100, None, 0, [0.0] * 4)], "id int, key string, seq int, vector array<double>")
    old = df.filter("id % 4 > 0")
    new = {r.id for r in context.similar_existing(df.filter("id % 4 = 0"), old, "key", 0.5).collect()}
    assert new == {i for i, k, _, v in rows if i % 4 == 0 and all(cos(v, w) <= 0.5 for j, o, _, w in rows if j % 4 and o == k)} | {100}


def chunks_of(text, most, carry):
    """Sequential: a chunk ends with the line that fills it, the next starts with the lines that carry enough."""
    lines, out, start, size = text.split("\n"), [], 0, 0
    for i, line in enumerate(lines):
        size += len(line) + 1
        if size >= most:
            out.append((start, i))
            start, size = i, len(line) + 1
            while size < carry and start > out[-1][0]:
                start -= 1
                size += len(lines[start]) + 1
    out.append((start, len(lines) - 1))
    join = lambda a, b: "\n".join(lines[a : b + 1])
    rows = [(join(a, b), a, b, len(join(a, b)) // 4) for a, b in out]
    return rows if rows[-1][0].strip() else rows[:-1]


def test_chunks(spark):
    rng = random.Random(4)
    texts = ["", "short", "x" * 1700, "x" * 1700 + "\nab\ncd", "y" * 1599, "a\n" * 900, "\n \n"] + ["\n".join("w" * rng.choice([0, 3, 50, 300, 900]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id int, text string")
    got = {}
    for r in chunking.chunk_lines(df, "id", "text").orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append((r.content, r.line_start, r.line_end, r.token_count))
    assert {i: got.get(i, []) for i in range(len(texts))} == {i: chunks_of(t, 1600, 320) for i, t in enumerate(texts)}


def test_select_only():
    assert select_only("```sql\nselect 1;\n```") == "select 1"
    for bad in ("drop table x", "with a as (select 1) select * from a", ""):
        with pytest.raises(ValueError):
            select_only(bad)
