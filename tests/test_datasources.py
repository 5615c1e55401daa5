"""The data sources: SQLite in ranges, changed files as a stream, ordered exports; each with restarts or failures."""

from __future__ import annotations

import gzip
import json
import os
import random
import sqlite3
import stat

import pytest
from pyspark.sql import functions as F

from larkspur.sources import datasources, files
from larkspur.streaming import ingest


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    datasources.register_sources(spark)


def test_sqlite_is_read_in_ranges_of_row_ids(spark, tmp_path):
    path = str(tmp_path / "m.db")
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-50, 5000), 300))
    with sqlite3.connect(path) as db:
        db.execute('create table "odd ""name""" (key text, "the text" text)')
        db.executemany('insert into "odd ""name""" (rowid, "the text") values (?, ?)', [(i, None if i % 7 == 0 else f"t{i}" * 3) for i in ids])
        db.execute("create table empty (content text)")
        db.execute("insert into \"odd \"\"name\"\"\" (rowid, \"the text\") values (9999, x'00ff')")
    rows = spark.read.format("sqlite_rows").option("table", 'odd "name"').option("column", "the text").option("rowsPerPartition", 40).load(path)
    assert rows.rdd.getNumPartitions() == 8
    assert {(r.id, r.text) for r in rows.collect()} == {(i, f"t{i}" * 3) for i in ids if i % 7}
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == rows.count() and len(sizes) > 4
    assert files.read_sqlite(spark, path, "empty").count() == 0 and files.read_sqlite(spark, path, "none").count() == 0


def test_a_changed_file_comes_again_once(spark, tmp_path):
    source, out = tmp_path / "in", []
    (source / "sub").mkdir(parents=True)
    (source / "a.txt").write_text("one")
    (source / "sub" / "b.txt").write_text("two")
    (source / "c.log").write_text("other pattern")

    def run():
        got = []
        stream = spark.readStream.format("changed_files").option("pattern", "*.txt").option("listings", str(tmp_path / "listings")).option("bytesPerPartition", 4).load(str(source))
        q = ingest.ingest(stream, lambda b, i: got.extend((os.path.basename(r.path), r.value) for r in b.collect()), str(tmp_path / "cp"))
        q.awaitTermination(90)
        assert q.exception() is None
        out.append(sorted(got))
        return out[-1]

    assert run() == [("a.txt", "one"), ("b.txt", "two")]
    assert run() == []
    (source / "a.txt").write_text("one, grown")
    (source / "new.txt").write_text("three")
    (source / "sub" / "b.txt").unlink()
    assert run() == [("a.txt", "one, grown"), ("new.txt", "three")]
    assert run() == []
    os.utime(source / "new.txt", ns=(1, 1))  # an older time is a change, too
    assert run() == [("new.txt", "three")]


def test_offsets_are_the_same_for_the_same_files(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("x")
    reader = datasources.ChangedFilesReader({"path": str(tmp_path / "in"), "listings": str(tmp_path / "l")})
    first = reader.latestOffset()
    assert reader.latestOffset() == first and reader.partitions(first, first) == []
    assert [p.paths for p in reader.partitions(reader.initialOffset(), first)] == [[str(tmp_path / "in" / "a")]]
    (tmp_path / "in" / "a").unlink()
    assert list(reader.read(datasources.Files([str(tmp_path / "in" / "a")]))) == []
    reader.commit(first)
    assert reader.latestOffset() != first and reader.partitions(first, reader.latestOffset()) == []


def lines_of(folder):
    out = []
    for p in sorted(folder.glob("part-*")):
        out += [json.loads(x) for x in (gzip.open(p, "rt") if p.suffix == ".gz" else p.open()).read().splitlines()]
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_an_export_is_ordered_and_its_owners(spark, tmp_path, packed):
    rng = random.Random(4)
    rows = [(i, None if i % 50 == 0 else f"2024-01-{1 + rng.randrange(28):02d}", "text\n" * (i % 3)) for i in rng.sample(range(2000), 700)]
    frame = spark.createDataFrame(rows, "id int, created_at string, t string").repartition(5)
    path = str(tmp_path / "e")
    assert files.write_export(path, "1", compress=packed, part_rows=90, memory=frame, empty=frame.limit(0)) == {"memory": 700, "empty": 0}
    folder = tmp_path / "e" / "memory"
    got = lines_of(folder)
    assert [(r["created_at"], r["id"]) for r in got] == sorted(((r[1], r[0]) for r in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert len(list(folder.glob("part-*"))) == 8 and json.loads((folder / "_manifest.json").read_text())["rows"] == 700
    for p in [folder, *folder.iterdir()]:
        assert stat.S_IMODE(p.stat().st_mode) == (0o700 if p.is_dir() else 0o600)
    back = files.read_export(spark, path, {"memory": "id int, created_at string, t string", "empty": "id int, created_at string, t string"}, "1")
    assert sorted(map(tuple, back["memory"].collect()), key=str) == sorted(rows, key=str) and back["empty"].count() == 0
    assert not [p for p in (tmp_path / "e").iterdir() if p.name.startswith("_")]


def test_a_failed_export_leaves_the_one_before(spark, tmp_path):
    frame = spark.range(100).selectExpr("id", "cast(id as string) t")
    files.write_export(str(tmp_path / "e"), "1", memory=frame)
    before = lines_of(tmp_path / "e" / "memory")
    bad = frame.withColumn("t", F.when(F.col("id") == 70, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    lines = bad.repartition(4).select(F.to_json(F.struct("id", "t")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        lines.write.format("ordered_export").mode("overwrite").save(str(tmp_path / "e" / "memory"))
    assert lines_of(tmp_path / "e" / "memory") == before
    assert sorted(p.name for p in (tmp_path / "e").iterdir()) == ["header", "memory"]
    with pytest.raises(Exception, match="memory"):
        frame.select(F.col("t").alias("value")).write.format("ordered_export").mode("append").save(str(tmp_path / "e" / "memory"))
    assert lines_of(tmp_path / "e" / "memory") == before
