"""Transcripts, files, exports and streams."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import render_session, session_json
from larkspur.operators import merge
from larkspur.sources import files, registry, transcripts
from larkspur.streaming import ingest


def _write(folder, name, *entries):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries))
    return str(folder)


def test_format_a(spark, tmp_path):
    path = _write(
        tmp_path / "a", "s1.jsonl", "{broken", "", "[1, 2]",
        {"type": "summary", "timestamp": "0"}, {"type": "user", "timestamp": "2024-01-02", "message": {"role": "user", "content": " hello "}},
        {"type": "assistant", "timestamp": "2024-01-01", "message": {"model": "m2", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "edit", "input": {"file_path": "/x/b.py", "path": 3, "file": "a"}}, {"type": "tool_result", "content": "r" * 700}, {"type": "tool_result", "content": [1]}, "loose"]}},
        {"type": "message", "model": "m1", "message": {"role": "user", "content": "   "}}, {"type": "user", "message": "no object"},
    )
    r = transcripts.format_a(transcripts.read_lines(spark, path), "app").collect()
    assert len(r) == 1
    s = r[0]
    assert (s.session_id, s.model, s.started_at, s.ended_at, s.files_changed) == ("s1", "m1", "2024-01-02", "2024-01-01", ["/x/b.py", "a"])
    assert [(m.role, m.content) for m in s.messages] == [("user", "hello"), ("assistant", "one\n[tool_result] " + "r" * 500)]
    assert s.messages[1].tool_calls[0].tool == "edit" and json.loads(s.messages[1].tool_calls[0].args)["path"] == 3
    empty = _write(tmp_path / "none", "s.jsonl", {"type": "user", "message": {"content": ""}})
    assert transcripts.format_a(transcripts.read_lines(spark, empty), "app").count() == 0


def test_format_b(spark, tmp_path):
    item = lambda ts, **p: {"type": "response_item", "timestamp": ts, "payload": p}
    path = _write(
        tmp_path / "b", "f.jsonl", {"type": "session_meta", "timestamp": "t0", "payload": {"id": "sid", "model_provider": "prov"}},
        item("t1", role="developer", content="hidden"), item("t2", role="user", content=[{"type": "input_text", "text": "hi"}, {"type": "input_text", "text": ""}]),
        item("t3", role="assistant", content=[{"type": "function_call", "name": "run", "arguments": '{"path": "/p/q", "file": "noslash"}'}, {"type": "function_call_output", "output": "o" * 600}]), item("t4", role="other", content="plain"),
    )
    s = transcripts.format_b(transcripts.read_lines(spark, path), "app").first()
    assert (s.session_id, s.model, s.started_at, s.ended_at, s.files_changed) == ("sid", "prov", "t0", "t4", ["/p/q"])
    assert [(m.role, m.content) for m in s.messages] == [("user", "hi"), ("assistant", "[tool_result] " + "o" * 500), ("assistant", "plain")]


def test_format_c_d_and_markdown(spark, tmp_path):
    whole = lambda p: spark.read.text(p, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    doc = {"sessionId": "g", "startTime": "a", "lastUpdated": "b", "messages": [{"type": "user", "content": "q", "timestamp": "1"}, {"type": "gemini", "content": [{"text": "x"}, "y", {"text": ""}]}, {"type": "info", "content": "z"}, {"type": "user", "content": " "}]}
    s = transcripts.format_c(whole(_write(tmp_path / "c", "f.json", doc)), "app").first()
    assert (s.session_id, s.started_at, s.ended_at, [(m.role, m.content) for m in s.messages]) == ("g", "a", "b", [("user", "q"), ("assistant", "x\ny")])
    assert transcripts.format_c(whole(_write(tmp_path / "c2", "f.json", "{bad")), "app").count() == 0
    lines = transcripts.read_lines(spark, _write(tmp_path / "d", "d.jsonl", {"type": "user", "message": {"content": "no"}}, {"type": "message", "timestamp": "t", "message": {"role": "assistant", "model": "m", "content": [{"type": "thinking", "thinking": "h" * 1200}, {"type": "function_call", "function": {"name": "go"}, "arguments": {"target": "/t/x", "path": "flat"}}]}}))
    s = transcripts.format_d(lines, "app").first()
    assert s.messages[0].content == "[thinking] " + "h" * 1000 and s.messages[0].tool_calls[0].tool == "go" and s.files_changed == ["/t/x"]
    folder = _write(tmp_path / "m", "2026-03-23-note.md", "# hi\ntext")
    _write(tmp_path / "m", "blank.md", "  \n")
    s = transcripts.format_markdown(whole(folder), "app").collect()
    assert len(s) == 1 and s[0].started_at == "2026-03-23T00:00:00Z" and s[0].messages[0].content == "# hi\ntext"
    text = spark.createDataFrame(s, transcripts.format_markdown(whole(folder), "app").schema).select(render_session(F.col("messages")).alias("t"), session_json(app=F.col("source_app"), model=F.col("model")).alias("j")).first()
    assert text.t == "[2026-03-23T00:00:00Z] [assistant] # hi\ntext" and json.loads(text.j) == {"app": "app", "model": None}
    found = spark.createDataFrame([("/a/x.jsonl",), ("/b/y.md",), ("/c",)], "p string").select(transcripts.detect(F.col("p"), [("one", r"\.jsonl$"), ("two", r"\.md$")]).alias("a")).collect()
    assert [r.a for r in found] == ["one", "two", None]


def test_scans(spark, tmp_path):
    _write(tmp_path / "t", "a.py", "import os")
    _write(tmp_path / "t" / "node_modules", "b.py", "x")
    _write(tmp_path / "t", "big.py", "x" * 200_000)
    _write(tmp_path / "t", "c.bin", "x")
    rows = files.source_tree(spark, str(tmp_path / "t"))
    assert [r.path.rsplit("/", 1)[1] for r in rows.collect()] == ["a.py"]
    assert files.source_tree(spark, str(tmp_path / "t"), changed=rows.select("path").limit(0)).count() == 0
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_files(spark, [str(tmp_path / "t")], "*.py").collect()] == ["big.py"]
    seen = spark.createDataFrame([("app", "h1")], "source_app string, content_hash string")
    new = spark.createDataFrame([("app", "h1"), ("app", "h2"), ("app", "h2"), ("other", "h1")], "source_app string, content_hash string")
    assert files.unseen(new, seen).count() == 2


def test_stores(spark, tmp_path):
    with sqlite3.connect(tmp_path / "m.db") as db:
        db.execute("create table mem (key text, text text, content text)")
        db.executemany("insert into mem values (?, ?, 'other')", [("a", "x" * 30), ("b", "short"), ("c", None), ("d", "y\0" * 20), ("e", "z" * 6000), ("f", 7)])
    for page in (2, 10_000):
        got = files.read_sqlite(spark, str(tmp_path / "m.db"), "mem", most_chars=5000, page=page)
        assert sorted((r.text, len(r.embed_text), r.token_count) for r in got.collect()) == [("x" * 30, 30, 7), ("y" * 20, 20, 5), ("z" * 5000, 2000, 1500)]
    assert files.read_sqlite(spark, str(tmp_path / "m.db"), "missing").count() == 0


def test_exports(spark, tmp_path):
    """Parts come back bit by bit, plain and compressed; the header decides whether they fit; a dry run writes nothing and a second import nothing new."""
    data = spark.createDataFrame([(1, "a", [0.1, 1e-6], "s"), (2, None, None, "s"), (3, "z" * 5000, [1.5], "new"), (4, "x", None, None)], "id int, t string, v array<double>, project_slug string")
    sizes = {}
    for gz in (False, True):
        out = str(tmp_path / f"e{gz}")
        assert files.write_export(out, "015.sql", "postgresql://u:secret@h/db", gz, memory=data) == {"memory": 4}
        header = files.export_header(spark, out)
        assert header["version"] == 1 and header["source"] == {"database_url": "postgresql://u:***@h/db", "schema_migration_top": "015.sql"} and header["exported_at"]
        back = files.read_export(spark, out, {"memory": "id int, t string, v array<double>, project_slug string"}, "015.sql")
        assert sorted(map(tuple, back["memory"].collect())) == sorted(map(tuple, data.collect()))
        sizes[gz] = sum(p.stat().st_size for p in (tmp_path / f"e{gz}" / "memory").iterdir())
    assert sizes[True] < sizes[False] / 2
    for migration in ("014.sql", None):
        with pytest.raises(ValueError):
            files.read_export(spark, str(tmp_path / "eTrue"), {}, migration)
    files.write_export(str(tmp_path / "old"), None, memory=data)
    with pytest.raises(ValueError):
        files.read_export(spark, str(tmp_path / "old"), {}, "015.sql")
    (tmp_path / "other" / "header").mkdir(parents=True)
    (tmp_path / "other" / "header" / "x.json").write_text('{"version": 2, "source": {"schema_migration_top": "015.sql"}}')
    with pytest.raises(ValueError):
        files.read_export(spark, str(tmp_path / "other"), {}, "015.sql")
    store = {"memory": spark.createDataFrame([(1, "own", None, "p1")], "id int, t string, v array<double>, project_id string"), "projects": spark.createDataFrame([("s", "p1")], "slug string, id string")}
    written = []

    def append(writes):
        written.append(writes)
        store["memory"] = store["memory"].unionByName(writes["memory"])
        store["projects"] = store["projects"].unionByName(writes["projects"].selectExpr("slug", "concat('new:', slug) id"))

    def run(dry_run):
        return merge.import_export(back, {"memory": store["memory"]}, store["projects"], {"memory": ["id"]}, append, dry_run)

    first = {"memory": {"rows": 4, "skipped_no_slug": 1, "inserted": 2, "skipped_dup": 1}, "projects": {"inserted": 1}}
    assert run(True) == first and not written and run(False) == first and len(written) == 1
    assert {(r.id, r.project_id) for r in store["memory"].collect()} == {(1, "p1"), (2, "p1"), (3, "new:new")}
    again = run(False)
    assert again["memory"]["inserted"] == 0 and again["memory"]["skipped_dup"] == 3 and again["projects"]["inserted"] == 0


def test_grown_sessions_are_replaced(spark):
    """A session is known by its application and id: from another file, or grown several times, it stays one."""
    schema = "source_app string, session_id string, path string, content_hash string, modified int, value string, project string"
    sessions = spark.createDataFrame([("x", "s1", "/a", "h1", 1, "one", "p"), ("x", "s2", "/b", "h2", 1, "two", "p"), ("y", "s2", "/b", "h2", 1, "other", None), ("x", None, "/n", "h9", 1, "loose", None)], schema)
    chunks = spark.createDataFrame([("x", "s1", "one"), ("x", "s2", "two"), ("y", "s2", "other"), ("x", "note", "kept")], "source_app string, source_id string, content string")
    read = [("x", "s1", "/moved", "h1", 5, "one", None), ("x", "s2", "/c", "h3", 2, "two more", "q"), ("x", "s2", "/b", "h4", 3, "two more yet", "q"), ("x", "s2", "/b2", "h4", 3, "two more yet", "q"), ("x", "s3", "/d", "h5", 1, "new", None), ("x", None, "/n", "h9", 1, "loose", None), ("x", None, "/n", "h8", 1, "loose end", None)]
    seen = spark.createDataFrame(read, schema)
    rebuild = lambda rows: rows.select("source_app", F.coalesce("session_id", "content_hash").alias("source_id"), F.explode(F.split("value", " ")).alias("content"))
    kept, built = merge.replace_grown(sessions, chunks, seen, rebuild, F.col("modified"), keep=["project"])
    rows = {(r.source_app, r.session_id, r.content_hash, r.value, r.project) for r in kept.collect()}
    assert rows == {("x", "s1", "h1", "one", "p"), ("x", "s2", "h4", "two more yet", "p"), ("y", "s2", "h2", "other", None), ("x", "s3", "h5", "new", None), ("x", None, "h9", "loose", None), ("x", None, "h8", "loose end", None)}
    assert kept.count() == 6
    want = [("x", "s1", "one"), ("x", "s2", "two"), ("x", "s2", "more"), ("x", "s2", "yet"), ("y", "s2", "other"), ("x", "note", "kept"), ("x", "s3", "new"), ("x", "h8", "loose"), ("x", "h8", "end")]
    assert sorted(tuple(r) for r in built.collect()) == sorted(want)
    same = merge.replace_grown(kept, built, seen.filter("content_hash <> 'h3'"), rebuild, F.col("modified"), keep=["project"])
    assert sorted(tuple(r) for r in same[1].collect()) == sorted(want) and same[0].count() == 6


REGISTRY = {"projects": {
    "p": {"name": "P", "team": "t", "status": " Inactive ", "path": "/p", "compose_project": "c", "ports": {"web": "3000-3010", "db": 5432, "bad": "9-1", "odd": "x", "none": None, "list": [1]}},
    "portless": {}, "named": {"name": ""}, "text": "x", "nothing": None, "number": 5, "gone": {"status": "lost", "ports": {"web": 80}}, "list": {"ports": [80]}}}


@pytest.mark.parametrize("yaml", [False, True])
def test_registries(spark, yaml):
    texts = [json.dumps(REGISTRY), "", "[]", "{\"projects\": []}", "{broken", None, json.dumps({"projects": {"p": {"name": "second", "ports": {"web": "1-2", "new": "7"}}}})]
    if yaml:
        texts[0] = "projects:\n" + "".join(f"  {k}: {json.dumps(v)}\n" for k, v in REGISTRY["projects"].items())
    found = registry.read_registry(spark.createDataFrame([(f"{i}", t) for i, t in enumerate(texts)], "path string, value string"), yaml=yaml)
    assert {tuple(r)[1:] for r in found.projects.filter("source = '0'").collect()} == {("p", "P", "t", "inactive", "/p", "c"), ("portless", "portless", None, "active", None, None), ("named", "named", None, "active", None, None), ("list", "list", None, "active", None, None)}
    assert {(r.slug, r.purpose, r.range_start, r.range_end) for r in found.ranges.filter("source = '0'").collect()} == {("p", "web", 3000, 3010), ("p", "db", 5432, 5432)}
    assert sorted(r.message for r in found.skipped.collect()) == sorted(["p/bad: bad port spec '9-1'", "p/odd: bad port spec 'x'", "p/none: bad port spec 'null'", "p/list: bad port spec '[1]'", "text: config is not a mapping", "nothing: config is not a mapping", "number: config is not a mapping", "gone: unknown status 'lost'", "list: ports are not a mapping"])
    have = spark.createDataFrame([("p", "web", 3000, 3010), ("p", "db", 1, 2)], "slug string, purpose string, range_start int, range_end int")
    out = registry.import_registry(found, spark.createDataFrame([("p",), ("else",)], "slug string"), have)
    assert out["counts"].first().asDict() == {"projects_created": 3, "projects_existing": 1, "ports_created": 1, "ports_existing": 2, "skipped": 9}
    assert {(r.purpose, r.action) for r in out["ranges"].collect()} == {("web", "existing"), ("db", "update"), ("new", "insert")}
    assert {(r.slug, r.name, r.action) for r in out["projects"].filter("slug = 'p'").collect()} == {("p", "P", "update")}


def test_changed_files(spark, tmp_path):
    listing = spark.createDataFrame([("M\ta.py",), ("A\tsub/b.py",), ("D\tgone.py",), ("R100\told.py\tnew.py",), ("C75\ta.py\tcopy.py",), ("plain.py",), ("",)], "value string")
    found = files.changed_files(listing)
    assert {(r.path, r.removed) for r in found.collect()} == {("a.py", False), ("sub/b.py", False), ("gone.py", True), ("old.py", True), ("new.py", False), ("copy.py", False), ("plain.py", False)}
    for name in ("a.py", "sub/b.py", "vendor/c.py", "d.py", "e.go"):
        _write((tmp_path / "vendor" / "tree" / name).parent, name.rsplit("/", 1)[-1], "x")
    root = str(tmp_path / "vendor" / "tree")
    names = lambda df: sorted(r.path.split("/tree/", 1)[1] for r in df.collect())
    assert names(files.source_tree(spark, root)) == ["a.py", "d.py", "sub/b.py"]
    assert names(files.source_tree(spark, root, types=["go", "py"], ignored=["sub"])) == ["a.py", "d.py", "e.go"]
    assert names(files.source_tree(spark, root, changed=found.filter("not removed"))) == ["a.py", "sub/b.py"]


def test_streaming_ingest(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    _write(source, "a.txt", "one")

    def merge(batch, batch_id):
        known = spark.read.parquet(out).select("content_hash") if (tmp_path / "out").exists() else None
        new = batch.dropDuplicates(["content_hash"])
        (new.join(known, "content_hash", "left_anti") if known is not None else new).write.mode("append").parquet(out)

    def run():
        q = ingest.ingest(ingest.watch_text(spark, str(source), "*.txt"), merge, str(tmp_path / "cp"))
        q.awaitTermination(60)
        return sorted(r.value for r in spark.read.parquet(out).collect())

    assert run() == ["one"]
    _write(source, "b.txt", "two")
    _write(source, "copy.txt", "one")
    assert run() == ["one", "two"]
    known = spark.read.parquet(out).select("path", "content_hash")
    _write(source, "a.txt", "one, grown")
    assert {r.value for r in ingest.rescan(spark, str(source), known).collect()} >= {"one, grown"}


def test_streaming_states(spark, tmp_path):
    source = tmp_path / "log"
    _write(source, "1.json", {"job_id": "a", "seq": 1, "status": "planning"}, {"job_id": "a", "seq": 2, "status": "approved"}, {"job_id": "b", "seq": 1, "status": "qa"})

    def run():
        stream = spark.readStream.schema("job_id string, seq int, status string").json(str(source))
        q = ingest.job_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, i: got.update({r.job_id: (r.status, r.moves, r.rejected) for r in b.collect()})).trigger(availableNow=True).start()
        q.awaitTermination(90)

    got = {}
    run()
    assert got == {"a": ("planning", 1, 1), "b": ("queued", 0, 1)}
    _write(source, "2.json", {"job_id": "a", "seq": 3, "status": "implementing"})
    run()
    assert got["a"] == ("implementing", 2, 1)


def test_streaming_windows(spark, tmp_path):
    source = tmp_path / "ev"
    _write(source, "1.json", *[{"t": f"2024-01-01T00:{m:02d}:00", "k": "x", "i": m % 3} for m in range(30)])
    stream = spark.readStream.schema("t timestamp, k string, i int").json(str(source))
    q = ingest.windowed_counts(stream, "t", "k", "10 minutes", "5 minutes").writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.n for r in spark.table("w").collect()} == {10}
    q = ingest.first_seen(stream, ["i"], "t", "1 hour").writeStream.outputMode("append").format("memory").queryName("f").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("f").count() == 3
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3))], "id int, expires_at timestamp")
    assert [r.id for r in ingest.live_leases(rows, "2024-01-02").collect()] == [2] and [r.id for r in ingest.tail(rows, 1).collect()] == [2]
