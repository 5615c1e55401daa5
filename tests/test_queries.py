"""Every registered query against its DuckDB counterpart, at the smallest scale."""

from __future__ import annotations

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import larkspur.plans.import_queries  # noqa: F401
import larkspur.plans.queries  # noqa: F401
import larkspur.plans.source_queries  # noqa: F401
import larkspur.plans.state_queries  # noqa: F401
import larkspur.plans.write_queries  # noqa: F401
from larkspur.plans.catalog import TABLES
from larkspur.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(value):
    if value is None or value != value or type(value).__name__ in ("NAType", "NaTType"):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def same(spark, run, sql):
    db = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    frame = run(spark, SF)
    expected = db.execute(sql)
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(frame.columns)
    rows = lambda data, have: sorted(tuple(plain(r[have.index(n)]) for n in sorted(have)) for r in data)
    assert rows([tuple(r) for r in frame.collect()], frame.columns) == rows(expected.fetchall(), names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_greedy_semantic_dedup_compares_all_of_a_label(spark):
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    dot, kept = lambda a, b: sum(x * y for x, y in zip(a, b)), {}
    for i, label, v in rows:
        own, norm = kept.setdefault(str(label), []), dot(v, v) ** 0.5
        if all(dot(v, w) <= 0.4 * norm * n for _, w, n in own):
            own.append((i, v, norm))
    got = QUERIES["greedy_semantic_dedup"](spark, SF).collect()
    assert {(r.batch, r.id) for r in got} == {(k, i) for k, own in kept.items() for i, _, _ in own} and len(got) < len(rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["larkspur/llm", "tests/llm"], ["larkspur/llm", "tests/llm", "corpus_pipeline.py"], []])
def test_the_entry_works_without_the_llm_package(tmp_path, gone):
    """Without the folders, without the pipeline too, and without a library that they need."""
    top = pathlib.Path(larkspur.plans.queries.__file__).parents[2]
    for name in ("larkspur", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (top / name).is_dir() else shutil.copy)(top / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    block = "import sys; sys.modules['xxhash'] = None; " if not gone else ""
    code = block + "import __spark_entry__ as e; names = set(e.queries()); print(len(names), 'vector_topk' in names, 'pipeline' in names, any(n[:2] == 'op' and n[2].isdigit() for n in names), e.__file__)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    n, core, pipeline, ops, file = done.stdout.split()
    assert (int(n), core, pipeline, ops) == (len(QUERIES), "True", "False", "False") and file.startswith(str(tmp_path))


def test_scans_read_only_what_they_need(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES["notification_history"](spark, SF)._jdf.queryExecution().toString()
    assert "In(event_type" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in QUERIES["vector_topk"](spark, SF)._jdf.queryExecution().toString()


def test_nothing_imports_the_llm_package():
    top = pathlib.Path(larkspur.plans.queries.__file__).parents[1]
    for p in top.rglob("*.py"):
        assert "llm" in p.parts or "larkspur.llm" not in p.read_text(), p
