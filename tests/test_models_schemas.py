"""Plug-in models, schemas and migrations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.functions import models


def test_embedding_falls_back(spark):
    def fragile(texts):
        if any("bad" in t for t in texts):
            raise ValueError("model down")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None), (4, "abcd")], "id int, content string")
    got = {r.id: r.e for r in models.embed(df, "content", "e", fragile, 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 1.0], 4: [4.0, 1.0]}
    again = models.reembed(df.withColumn("embedding", F.array(F.lit(1.0))), "content")
    assert all(abs(sum(x * x for x in r.embedding) - (r.content is not None)) < 1e-5 for r in again.collect())


def test_summaries(spark):
    s = spark.createDataFrame([("a", "p", "One. Two. Three.", None), ("b", "p", "x", "kept"), ("c", None, "", None)], "id string, project_id string, raw_content string, summary string")
    filled, chunks = models.fill_summaries(s)
    assert {r.id: r.summary for r in filled.collect()} == {"a": "One. Two", "b": "kept", "c": None}
    assert [(r.source_id, r.content) for r in chunks.collect()] == [("a", "One. Two")]
    assert models.plugin("extract") is models.extract


def test_schemas(spark):
    for t in schemas.TABLES:
        assert spark.createDataFrame([], schemas.ddl(t)).columns
    assert "created_at" in schemas.required("memory") and "title" not in schemas.required("memory")
    rows = spark.createDataFrame([("1", "p", "chunk", "c", [0.0] * 4, "memory"), ("2", None, "odd", "c", [0.0] * 3, "rule"), ("3", "p", "issue", "c", None, "none")], "id string, project_id string, kind string, content string, embedding array<float>, tier string")
    got = {r.id: r.broken for r in schemas.violations(rows, "memory", 4).collect()}
    assert got == {"2": ["project_id is null", "kind not in list", "embedding not of 4"], "3": ["tier not in list"]}
    ranges = spark.createDataFrame([(1, 5, 4), (2, 1, 65535)], "id int, port_start int, port_end int")
    assert [r.id for r in schemas.violations(ranges, "port_assignments").collect()] == [1]


def test_migrations(spark):
    applied = spark.createDataFrame([("001.sql", dt.datetime(2024, 1, 1), "x"), ("000.sql", dt.datetime(2024, 1, 1), "y")], "filename string, applied_at timestamp, checksum string")
    disk = spark.createDataFrame([("001.sql",), ("003.sql",), ("002.sql",)], "filename string")
    todo, gone = schemas.pending_migrations(applied, disk)
    assert [r.filename for r in todo.collect()] == ["002.sql", "003.sql"] and [r.filename for r in gone.collect()] == ["000.sql"]
    more = schemas.record_migration(applied, "002.sql", "z", F.lit(dt.datetime(2024, 1, 2)))
    assert more.count() == 3 and schemas.record_migration(more, "002.sql", "z", F.lit(dt.datetime(2024, 1, 2))).count() == 3
    assert schemas.merge_settings({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": 2}, "d": {"e": 1}}


def test_lessons(spark):
    rows = spark.createDataFrame([(1, 2, "b", "second"), (1, 1, "a", "first"), (2, 1, "c", "x" * 9000)], "job_id int, created_at int, id string, content string")
    got = models.extract_lessons(rows, lambda t: f"LESSON: {t.splitlines()[0][:5]} of {len(t)}\nCATEGORY: C")
    assert sorted(map(tuple, got.collect())) == [(1, "first of 12", "c", None), (2, "xxxxx of 8000", "c", None)]
