"""Whitening of embeddings from covariances by polarisation.

Entries are scaled to whole numbers, x = floor(scale c) + shift, so every sum below is exact. A first pass adds up the vectors; a second one
squares centred values only: of each dimension, and of each sum of two dimensions. The covariance of two dimensions
is half of what the variance of their sum has over the two variances; d (d + 1) / 2 sums of squares so give the whole matrix. Values are
centred at the whole number nearest the mean, and what that leaves of the mean is taken off in exact integers. The matrix of d by d numbers is
assembled on the driver for eigh; its eigenvectors project all rows in a third pass. Sums travel in limbs of LIMB bits, one row for each sum and task, so neither
rows nor sums overflow.

A component whose eigenvalue is not above the rounding of the matrix (d * 2^-52 of the trace) has no whitened value and is left out. Of each eigenvector the entry of the largest
magnitude, the first of equal ones, is positive. How near the whitened covariance is to the identity is measured on the whitened rows themselves.

Defined results: vectors that are null, hold a null, NaN or infinite entry, or have another length than most (the longer one of equally common lengths) take no part; a null id and
rows that repeat are rows each; x beyond 62 bits stays at that bound; a deviation beyond 38 digits is null; fewer rows or
dimensions than components give fewer components, one row or equal rows none; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb of a sum, and limbs: 2^32 tasks' sums of 2^190 fit.
LIMB, LIMBS = 31, 7
#: Rows that are worked on at once, and dimensions of the matrix that the driver assembles.
ROWS, MOST_DIMENSIONS = 4096, 4096
_BOUND = 1 << 62


@dataclass
class Whitening:
    """How rows are whitened: n, the sums and the trace of the fit, and the components with their eigenvalues, by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # a column each


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    given = rows.select(F.col(id_col).alias("id"), v.alias("v")).filter("v is not null")
    given = given.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = given.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return given.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as whole numbers."""
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            batch = whole.slice(at, ROWS)
            v = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy().reshape(len(batch), -1)
            with np.errstate(over="ignore"):
                scaled = np.clip(np.floor(scale * v), -float(_BOUND), float(_BOUND))
            yield batch, np.clip(scaled.astype(np.int64) + shift, -_BOUND, _BOUND)


def _limbs(total: int) -> list[int]:
    """A sum as limbs, the last of which has the sign; adding limbs up adds the sums."""
    out = [total >> (LIMB * k) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*out, total >> (LIMB * (LIMBS - 1))]


def _added(rows: DataFrame, work, size: int, scale: int, shift: int) -> list[int]:
    """The exact sums over all rows of what work gives for blocks of vectors: lists of whole numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * size
        for _, x in _blocks(batches, scale, shift):
            for i, n in enumerate(work(x)):
                totals[i] += n
        limbs = [_limbs(t) for t in totals]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), *[pa.array([x[k] for x in limbs], pa.int64()) for k in range(LIMBS)]], ["at", *[f"l{k}" for k in range(LIMBS)]])

    summed = rows.select("v").mapInArrow(partial, "at long, " + ", ".join(f"l{k} long" for k in range(LIMBS))).groupBy("at").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    found, out = summed.toArrow(), [0] * size  # one row a sum
    limbs = [found.column(f"l{k}").to_pylist() for k in range(LIMBS)]
    for i, at in enumerate(found.column("at").to_pylist()):
        out[at] = sum(limbs[k][i] << (LIMB * k) for k in range(LIMBS))
    return out


def _column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if len(x) and int(max(-x.min(initial=0), x.max(initial=0))) * len(x) >= _BOUND:
        return [int(s) for s in x.astype(object).sum(0)]
    return x.sum(0).tolist()


def _square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of the squares of each dimension, then of each sum of dimensions i < j."""
    d = y.shape[1]
    most = 2 * int(max(-y.min(initial=0), y.max(initial=0)))
    if most * most * max(len(y), 1) >= _BOUND:
        y = y.astype(object)
    out = (y * y).sum(0).tolist()
    for i in range(d - 1):
        pair = y[:, i : i + 1] + y[:, i + 1 :]
        out += (pair * pair).sum(0).tolist()
    return out


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """From usable rows (id, v); None without any."""
    first = rows.select(F.size("v").alias("d")).first()
    if first is None or not first["d"]:
        return None
    d = first["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have more than {MOST_DIMENSIONS} dimensions")
    n, *sums = _added(rows, lambda x: [len(x), *_column_sums(x)], d + 1, scale, shift)
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the whole number nearest the mean
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    near = np.array(centre, np.int64)
    squares = _added(rows, lambda x: _square_sums(x - near), d * (d + 1) // 2, scale, shift)
    own, pairs = [n * q - s * s for q, s in zip(squares[:d], left, strict=True)], iter(squares[d:])  # n^2 times the variances
    cov = np.zeros((d, d))
    for i in range(d):
        cov[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            of_sum = n * next(pairs) - (left[i] + left[j]) ** 2
            cov[i, j] = cov[j, i] = float(Fraction(of_sum - own[i] - own[j], 2 * n * n))
    trace = float(Fraction(sum(own), n * n))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > d * 2.0**-52 * trace][:components]
    vectors = vectors[:, order]
    top = np.abs(vectors).argmax(0)
    return Whitening(n, sums, trace, values[order], vectors * np.sign(vectors[top, np.arange(len(order))]))


def whiten_rows(rows: DataFrame, model: Whitening, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, deviation, whitened) of usable rows, as a table; deviation: the sum of (n x - S)^2, exact."""
    n, sums = model.n, model.sums
    project = model.vectors / np.sqrt(model.values)
    schema = T.StructType([rows.schema["id"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, scale, shift):
            most = n * int(max(-x.min(initial=0), x.max(initial=0))) + max(map(abs, sums))
            t = n * x - np.array(sums, np.int64) if most < _BOUND else n * x.astype(object) - np.array(sums, object)
            far = int(np.abs(t).max(initial=0))
            squares = (t * t if far * far * len(sums) < _BOUND else t.astype(object) ** 2).sum(1).tolist()
            centred = (t / n).astype(float)
            told = [Decimal(s) if s < 10**38 else None for s in squares]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.decimal128(38, 0)), pa.array(list(centred @ project), pa.list_(pa.float64()))], schema.names)

    return cut(rows.select("id", "v").mapInArrow(projected, schema), "whitened")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from the rows' values."""
    k = len(model.values)
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            for at in range(0, len(b), ROWS):
                w = b.column(0).slice(at, ROWS).flatten().to_numpy().reshape(-1, k)
                total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["at", "s"])

    found = whitened.select("whitened").mapInArrow(partial, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()  # k (k + 1) rows
    total = np.zeros((k + 1) * k)
    total[found.column("at").to_numpy()] = found.column("s").to_numpy()
    mean, squares = total[:k] / model.n, total[k:].reshape(k, k) / model.n
    return float(np.abs(squares - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Whitening | None, float]:
    """(id, deviation, whitened) of every usable row; what was fitted; and the identity error. Without usable rows the table is empty and nothing fitted."""
    rows = _usable(table, id_col, vector_col)
    model = fit_whitening(rows, components, scale, shift)
    if model is None:
        empty = rows.select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).limit(0)
        return empty, None, 0.0
    out = whiten_rows(rows, model, scale, shift)
    return out, model, identity_error(out, model)
