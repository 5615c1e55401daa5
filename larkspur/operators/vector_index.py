"""An inverted file of k-means cells for vector search by cosine.

Vectors of length 1 are dealt into cells by the nearest centre; rows lie in the shared folder as Parquet partitioned by cell, so a search
reads the cells that it probes and no others. Of each cell the index knows its centre and the least cosine of a member to it, its radius. By the triangle
inequality on the sphere no member can come nearer to a query than its angle to the centre less the radius. That bound is the stop rule of the exact mode: the likeliest
cells are searched first, then only those whose bound reaches the k-th score found. With `probes` given the nearest cells are all that is read.

Centres are fitted by MLlib on at most SAMPLE vectors, those whose ids have the least hashes; all rows are dealt. New rows are dealt to the centres there are and appended, their cells' radii
with them; when `growth` says that the index has grown much, it is time to build it anew.

Defined results: vectors that are null, zero, empty, hold a null, NaN or infinite component, or have another length than the first of the sample, aren't in the index; a query without
a usable vector finds nothing; a null id is a row, and rows that repeat are rows each; ties go to the smaller id, null last; an index of no rows gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.vectors import dot, norm
from larkspur.session import cut, shared_dir, ship

#: Vectors that the centres are fitted to, at most; cells at most, whose centres travel to every task; rows of a cell in one file.
SAMPLE, MOST_CELLS, FILE_ROWS = 50_000, 16_384, 500_000
#: Queries and rows that one task compares.
QUERY_BLOCK, ROW_BLOCK = 1024, 16_384
#: Bounds and scores are compared with this much to spare for rounding.
ROUNDING = 1e-9


def unit(vector: Column) -> Column:
    """The vector with length 1; null for one that has no direction or isn't finite."""
    v = vector.cast("array<double>")
    length = norm(v)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (length > 0) & (length < float("inf"))
    return F.when(good, F.transform(v, lambda x: x / length))


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), d)


def _bounds(cosines: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """The largest cosine that a query can have with a member of each cell, from its cosines to the centres and the cells' radii."""
    away = np.arccos(np.clip(cosines, -1, 1)) - np.arccos(np.clip(lows, -1, 1))
    return np.cos(np.maximum(away, 0))


@dataclass(frozen=True)
class VectorIndex:
    """A written index: `rows` (id, v, cell), partitioned by cell, `cells` (cell, centre), `radii` (cell, low, n, built), all below path."""

    spark: SparkSession
    path: str
    id_type: T.DataType

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def rows(self) -> DataFrame:
        return self._read("rows", T.StructType([T.StructField("id", self.id_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())]))

    def cells(self) -> DataFrame:
        """(cell, centre, low, n) of the cells that have rows; MOST_CELLS rows at most."""
        centres = self._read("cells", T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))]))
        radii = self._read("radii", T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("built", T.BooleanType())]))
        return centres.join(radii.groupBy("cell").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.sum(F.when(F.col("built"), F.col("n")).otherwise(0)).alias("n_built")), "cell", "left")

    def growth(self) -> float:
        """Rows now by rows when the centres were fitted."""
        r = self.cells().agg(F.sum("n").alias("n"), F.sum("n_built").alias("b")).first()
        return (r["n"] or 0) / r["b"] if r["b"] else 1.0

    def add(self, rows: DataFrame, built: bool = False) -> None:
        """Append rows (id, vector), which the index is taken not to have."""
        ship(self.spark)
        found = self.cells().orderBy("cell").toArrow()
        if not len(found):
            return
        d = len(found.column("centre")[0])
        centres, numbers = _matrix(found.column("centre"), d), found.column("cell").to_numpy()
        schema = T.StructType([T.StructField("id", self.id_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("cosine", T.DoubleType())])

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = _matrix(b.column(1), d) @ centres.T
                best = near.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(numbers[best].astype(np.int32)), pa.array(near[np.arange(len(best)), best])], schema.names)

        usable = rows.select(F.col("id").cast(self.id_type).alias("id"), unit(F.col("vector")).alias("v")).filter(F.size("v") == d)
        placed = cut(usable.mapInArrow(dealt, schema), "cells")
        sizes = cut(placed.groupBy("cell").agg(F.min("cosine").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("built", F.lit(built)), "radii")
        # a cell's rows are spread over as many files as it needs, so that a large cell is no task of its own
        files = sizes.select("cell", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("files"))
        spread = placed.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("v"), F.col("files")))
        spread.repartition("cell", "file").select("id", "v", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        sizes.write.mode("append").parquet(f"{self.path}/radii")

    def _known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centres and least cosines of the cells that have rows."""
        found = self.cells().filter("n > 0").orderBy("cell").toArrow()
        d = len(found.column("centre")[0]) if len(found) else 0
        return found.column("cell").to_numpy(), _matrix(found.column("centre"), d), found.column("low").to_numpy()

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(id, score): the k best rows by cosine, of the `probes` nearest cells, or of all where probes is None."""
        numbers, centres, lows = self._known()
        q = np.array(query, float)
        length = np.linalg.norm(q)
        if not len(numbers) or len(q) != centres.shape[1] or not np.isfinite(length) or not length:
            return self.rows.select("id", F.lit(0.0).alias("score")).limit(0)
        cosines = centres @ (q / length)
        score = dot(F.col("v"), F.lit([float(x) for x in q / length]))

        def best(cells: np.ndarray) -> DataFrame:
            scored = self.rows.filter(F.col("cell").isin([int(c) for c in cells])).select("id", score.alias("score"))
            return scored.orderBy(F.desc("score"), F.asc_nulls_last("id")).limit(k)

        if probes is not None:
            return best(numbers[np.argsort(-cosines, kind="stable")[:probes]])
        hopes = _bounds(cosines, lows)
        order = np.argsort(-hopes, kind="stable")
        first = order[: max(1, math.isqrt(len(order)))]
        found = [r["score"] for r in best(numbers[first]).collect()]  # k rows
        floor = found[-1] if len(found) == k else -2.0
        return best(numbers[(hopes >= floor - ROUNDING) | np.isin(np.arange(len(hopes)), first)])

    def join(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, id, score): each query's k best rows, for queries (query_id, vector); a query_id is one query.

        With probes None a first round searches a few cells of each query, and a second one only those that its k-th score doesn't rule out.
        """
        ship(self.spark)
        numbers, centres, lows = self._known()
        q_type, d = queries.schema["query_id"].dataType, centres.shape[1]
        asked = queries.select("query_id", unit(F.col("vector")).alias("v")).filter(F.size("v") == d)
        few = max(1, math.isqrt(len(numbers))) if probes is None else probes
        given = asked.withColumn("floor", F.lit(None).cast("double"))
        found = self._round(self._cells_of(given, numbers, centres, lows, few, probes is None), k, q_type)
        if probes is None:
            found = cut(found, "first-round")
            floors = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
            rest = asked.join(floors, "query_id", "left").select("query_id", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
            more = self._round(self._cells_of(rest, numbers, centres, lows, few, True), k, q_type)
            found = self._ranked(found.drop("rank").unionByName(more.drop("rank")), k)
        return found.select("query_id", "rank", "id", "score")

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.95) -> int:
        """How many probes find the share `target` of the exact k best rows of some queries (query_id, vector): a sample of those to come, as it costs an exact search."""
        ship(self.spark)
        numbers, centres, _ = self._known()
        if not len(numbers):
            return 1
        asked = queries.select("query_id", unit(F.col("vector")).alias("v")).filter(F.size("v") == centres.shape[1])
        schema = T.StructType([T.StructField("of", queries.schema["query_id"].dataType), T.StructField("cells", T.ArrayType(T.IntegerType()))])

        def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = np.argsort(-(_matrix(b.column(1), centres.shape[1]) @ centres.T), axis=1, kind="stable")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(numbers[near].astype(np.int32)), pa.list_(pa.int32()))], schema.names)

        exact = self.join(queries, k).join(self.rows.select(F.col("id").alias("member"), "cell"), F.col("id").eqNullSafe(F.col("member")))
        places = exact.join(asked.mapInArrow(ordered, schema), F.col("query_id") == F.col("of")).groupBy("query_id", "id").agg(F.min(F.array_position("cells", F.col("cell"))).alias("place"))
        counts = places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # a row a cell at most
        total, seen = sum(r["n"] for r in counts), 0
        for r in counts:
            seen += r["n"]
            if seen >= target * total:
                return int(r["place"])
        return 1

    @staticmethod
    def _cells_of(asked: DataFrame, numbers: np.ndarray, centres: np.ndarray, lows: np.ndarray, few: int, bounded: bool) -> DataFrame:
        """(query_id, v, cell): the first few cells of each query, by bound or by nearness; where floor is known, the others whose bound reaches it."""
        schema = T.StructType([*asked.schema.fields[:2], T.StructField("cell", T.IntegerType())])

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), QUERY_BLOCK):
                    b = whole.slice(at, QUERY_BLOCK)
                    near = _matrix(b.column(1), centres.shape[1]) @ centres.T
                    hopes = _bounds(near, lows) if bounded else near
                    place = np.argsort(np.argsort(-hopes, axis=1, kind="stable"), axis=1)
                    floor = b.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
                    taken = np.where(np.isnan(floor), place < few, (place >= few) & (hopes >= floor - ROUNDING))
                    row, cell = np.nonzero(taken)
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(numbers[cell].astype(np.int32))], schema.names)

        return cut(asked.mapInArrow(named, schema), "probes")

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def _round(self, pairs: DataFrame, k: int, q_type: T.DataType) -> DataFrame:
        """The k best rows of each query in the cells it is paired with. Rows and queries of a cell meet in blocks, as many as that cell needs."""
        wanted = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(self.cells().select("cell", "n"), "cell")
        blocks = cut(wanted.select("cell", F.ceil(F.col("n") / ROW_BLOCK).cast("int").alias("row_blocks"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("query_blocks")), "blocks")
        few = F.broadcast(blocks)  # MOST_CELLS rows at most
        part = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["cell", "row_block", "query_block"]
        asked = pairs.join(few, "cell").withColumn("query_block", part("query_id", "query_blocks")).withColumn("row_block", every("row_blocks")).select("query_id", "v", *keys)
        given = self.rows.join(few, "cell").withColumn("row_block", part("v", "row_blocks")).withColumn("query_block", every("query_blocks")).select("id", "v", *keys)
        schema = T.StructType([T.StructField("query_id", q_type), T.StructField("id", self.id_type), T.StructField("score", T.DoubleType())])

        def compared(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not (left.num_rows and right.num_rows):
                return pa.table({"query_id": left.column("query_id").slice(0, 0), "id": right.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
            right = right.sort_by("id")
            d = len(left.column("v")[0])
            score = _matrix(left.column("v"), d) @ _matrix(right.column("v"), d).T
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # rows stand in the order of their ids
            row = np.repeat(np.arange(len(score)), best.shape[1])
            return pa.table({"query_id": left.column("query_id").take(pa.array(row)), "id": right.column("id").take(pa.array(best.reshape(-1))), "score": score[row, best.reshape(-1)]})

        return self._ranked(asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(compared, schema), k)


def build_vector_index(rows: DataFrame, cells: int = 100, sample: int = SAMPLE, seed: int = 7, path: str | None = None) -> VectorIndex:
    """An index of rows (id, vector), in a new folder below the shared one unless path names one."""
    spark = rows.sparkSession
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"cells must be between 1 and {MOST_CELLS}")
    out = VectorIndex(spark, path or f"{shared_dir(spark)}/tables/vector-index-{uuid.uuid4().hex}", rows.schema["id"].dataType)
    usable = rows.select("id", unit(F.col("vector")).alias("v")).filter("size(v) > 0")
    fitted = cut(usable.orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
    first = fitted.select(F.size("v").alias("d")).first()
    centres: list[tuple[int, list[float]]] = []
    if first:
        fitted = fitted.filter(F.size("v") == first["d"])
        model = KMeans(k=max(2, min(cells, fitted.count())), seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="f").fit(fitted.select(array_to_vector("v").alias("f")))
        for i, c in enumerate(model.clusterCenters()[:cells]):
            length = float(np.linalg.norm(c))
            if length > 0:
                centres.append((i, [float(x) / length for x in c]))
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{out.path}/cells")
    for name, schema in (("radii", "cell int, low double, n long, built boolean"), ("rows", T.StructType([T.StructField("id", out.id_type), T.StructField("v", T.ArrayType(T.DoubleType()))]))):
        spark.createDataFrame([], schema).write.parquet(f"{out.path}/{name}")
    out.add(rows, built=True)
    return out


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact pairs (query_id, id) that were found; 1 without any."""
    n = exact.select("query_id", "id").distinct()
    hit, total = n.join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").count(), n.count()
    return hit / total if total else 1.0
