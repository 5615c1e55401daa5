"""The inverted file against brute force: exact mode, probes, new rows, pruned cells, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from larkspur.operators.vector_index import build_vector_index, recall

ROWS = "id long, vector array<float>, cell int, score string"


def clustered(n=1500, d=8, clusters=30, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 3
    return (centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)) * 0.3).astype(np.float32)


def brute(vectors, ids, queries, k):
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    score = unit(np.float64(queries)) @ unit(np.float64(vectors)).T
    out = []
    for row in score:
        out.append([ids[i] for i in sorted(range(len(ids)), key=lambda i: (-round(row[i], 12), ids[i]))[:k]])
    return out


@pytest.fixture(scope="module")
def data():
    v = clustered()
    v[700:740] = v[3]  # copies: ties
    return v


@pytest.fixture(scope="module")
def index(spark, data):
    odd = [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [1.0, None] + [1.0] * 6), (9005, [float("inf")] * 8), (9006, [1.0] * 3), (9007, [])]
    rows = [(i, [float(x) for x in v], 5, "x") for i, v in enumerate(data)]
    half = spark.createDataFrame(rows[:900], ROWS)
    out = build_vector_index(half.unionByName(spark.createDataFrame([(i, v, 5, "x") for i, v in odd], ROWS)), cells=25)
    out.add(spark.createDataFrame(rows[900:], ROWS))
    return out


def asked(spark, data, step=50):
    return spark.createDataFrame([(i, [float(x) for x in data[i]]) for i in range(0, len(data), step)], "query_id long, vector array<float>")


def test_exact_join(spark, data, index):
    assert index.rows.count() == len(data)
    got: dict = {}
    for r in sorted(index.join(asked(spark, data), 6).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == dict(zip(range(0, len(data), 50), brute(data, list(range(len(data))), data[::50], 6), strict=True))


def files_read(frame):
    """Files and partitions that the executed plan's scans have read."""
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    scan = plan.collectLeaves().apply(0)
    return [scan.metrics().apply(m).value() for m in ("numFiles", "numPartitions")]


def test_exact_search_reads_few_cells(data, index):
    found = index.search([float(x) for x in data[3]], 45)
    assert [r.id for r in found.collect()] == brute(data, list(range(len(data))), data[3:4], 45)[0]
    files, cells = files_read(found)
    assert 0 < files < len(index.rows.inputFiles()) / 2 and 0 < cells < 12
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [(cell" in plan


def test_probes(spark, data, index):
    queries = asked(spark, data, 40)
    exact = index.join(queries, 10)
    n = index.probes_for(queries, 10, 0.95)
    assert n < 12
    assert recall(index.join(queries, 10, probes=n), exact) >= 0.95
    assert recall(index.join(queries, 10, probes=10_000), exact) == 1.0
    some = index.search([float(x) for x in data[10]], 5, probes=1)
    assert some.count() == 5 and len(some.collect()) == 5 and files_read(some)[1] == 1


def test_growth(spark, data, index):
    assert index.growth() == pytest.approx(len(data) / 900)


def test_odd_queries(spark, index):
    rows = [(1, None), (2, [0.0] * 8), (3, [1.0] * 5), (4, [float("nan")] * 8)]
    assert index.join(spark.createDataFrame(rows, "query_id long, vector array<float>"), 3).count() == 0
    assert index.search([0.0] * 8, 3).count() == 0 and index.search([1.0], 3).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "x")], [(1, [1.0, 0.0], 1, "x")], [(None, [1.0, 2.0], 1, "x"), (None, [1.0, 2.0], 1, "x")]])
def test_small_indexes(spark, rows):
    index = build_vector_index(spark.createDataFrame(rows, ROWS), cells=4)
    n = sum(r[1] is not None for r in rows)
    queries = spark.createDataFrame([(7, [2.0, 1.0])], "query_id long, vector array<float>")
    assert index.search([2.0, 1.0], 5).count() == n and index.join(queries, 5).count() == n
    assert index.growth() == 1.0


def test_cells_are_bounded(spark):
    with pytest.raises(ValueError, match="cells"):
        build_vector_index(spark.createDataFrame([], ROWS), cells=0)
