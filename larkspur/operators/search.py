"""Vector search over memory and code, with drill-down into sources."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import line_window, source_reference
from larkspur.functions.vectors import cosine
from larkspur.session import cut, ship

# Which kinds a source type stands for.
SOURCE_KINDS = {"session": ("chunk", "session_summary"), "note": ("chunk",), "imported": ("chunk",), "decision": ("decision",), "pattern": ("pattern",), "issue": ("issue",)}
CODE = "codebase"
#: Queries that travel at once, rows that they are compared with at once, and pairs that a task holds before it keeps the best.
QUERY_BLOCK, ROW_BLOCK, HELD = 4096, 1024, 1_000_000


@dataclass(frozen=True)
class SearchPlan:
    """Which branches to read: kinds of memory (None: all), chunk source types (None: all), and whether code is searched."""

    kinds: tuple[str, ...] | None
    chunk_types: tuple[str, ...] | None
    code: bool


def plan_sources(source_types: list[str] | None) -> SearchPlan:
    if not source_types:
        return SearchPlan(None, None, True)
    known = [t for t in source_types if t in SOURCE_KINDS]
    kinds = tuple(dict.fromkeys(k for t in known for k in SOURCE_KINDS[t]))
    chunk_types = tuple(t for t in known if "chunk" in SOURCE_KINDS[t]) or None
    return SearchPlan(kinds, chunk_types, CODE in source_types)


def top_k(rows: DataFrame, score: Column, ident: str, k: int) -> DataFrame:
    """The k best rows by score; ties go to the smaller id; rows without a score take no part."""
    return rows.withColumn("score", score).filter("score is not null").orderBy(F.desc("score"), F.asc(ident)).limit(k)


def vector_top_k(rows: DataFrame, query: list[float], k: int, ident: str = "id", vector: str = "embedding") -> DataFrame:
    """Exact search with one query vector, which travels as a literal: a scan and a partition-wise top k."""
    return top_k(rows, cosine(F.col(vector), F.lit([float(x) for x in query])), ident, k)


def _units(vectors: list[list[float] | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length the places of the vectors that have one, and the vectors at length 1; rows that aren't finite stand for vectors without a direction."""
    sizes = np.array([-1 if v is None else len(v) for v in vectors], np.int64)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        v = np.array([vectors[i] for i in own], float).reshape(len(own), size)
        with np.errstate(all="ignore"):
            out[size] = own, v / np.linalg.norm(v, axis=1, keepdims=True)
    return out


def _first(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query q, by falling score, then id."""
    found = found.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = found.column("q").to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def vector_join_top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows by cosine: (query_id, rank, id, score), for queries (query_id, vector) and rows (id, vector).

    Queries go in blocks of about QUERY_BLOCK, which travel to the rows: each block is one pass over the rows where they lie, a matrix product for ROW_BLOCK rows, and a task gives the k best of all its
    rows for each query. So rows aren't shuffled, however many queries there are. A null, zero or non-finite vector, or one of another length than the query's, has no score; ties
    go to the smaller id, null last.
    """
    spark = rows.sparkSession
    ship(spark)
    vector = F.col("vector").cast("array<double>").alias("vector")
    asked, given = cut(queries.select("query_id", vector), "asked"), rows.select("id", vector)
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()  # about QUERY_BLOCK rows
        if not len(some):
            continue
        sent = spark.sparkContext.broadcast((some.column("query_id").combine_chunks(), _units(some.column("vector").to_pylist())))

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, units = sent.value  # noqa: B023
            held: list[pa.Table] = []
            for batch in (b.slice(at, ROW_BLOCK) for b in batches for at in range(0, len(b), ROW_BLOCK)):
                for size, (row, v) in _units(batch.column(1).to_pylist()).items():
                    if size not in units:
                        continue
                    query, q = units[size]
                    with np.errstate(all="ignore"):
                        score = q @ v.T
                    score = np.where(np.isfinite(score), score, -np.inf)
                    least = np.partition(score, -k, axis=1)[:, -k :][:, :1] if score.shape[1] > k else -np.inf
                    at, of = np.nonzero((score >= least) & (score > -np.inf))
                    held.append(pa.table({"q": query[at], "id": batch.column(0).take(pa.array(row[of])), "score": score[at, of]}))
                if sum(map(len, held)) > HELD:
                    held = [_first(pa.concat_tables(held), k)]
            for b in _first(pa.concat_tables(held), k).combine_chunks().to_batches() if held else []:
                yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(1), b.column(2)], schema.names)

        found = found.unionByName(cut(given.mapInArrow(compared, schema), "nearest"))
        sent.destroy()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def memory_branch(memory: DataFrame, chunks: DataFrame, plan: SearchPlan, project_id: str | None = None) -> DataFrame:
    """Live memory with a vector; chunks bring their source, and only chunks of the wanted types stay.

    A chunk-kind row whose chunk is missing has no source type, so a type filter drops it, as three-valued logic does.
    """
    source = chunks.select(F.col("id").alias("chunk_id"), "source_type", "source_id", "source_line_start", "source_line_end")
    joined = memory.join(source, (F.col("kind") == "chunk") & (F.col("provenance_id") == F.col("chunk_id")), "left").filter("archived_at is null and embedding is not null")
    if project_id is not None:
        joined = joined.filter(F.col("project_id") == project_id)
    if plan.kinds is not None:
        joined = joined.filter(F.col("kind").isin(list(plan.kinds)))
    if plan.chunk_types is not None:
        joined = joined.filter((F.col("kind") != "chunk") | F.col("source_type").isin(list(plan.chunk_types)))
    return joined.select("id", "kind", "title", "content", "embedding", "chunk_id", "source_type", "source_id", "source_line_start", "source_line_end")


def code_branch(code: DataFrame, project_id: str | None = None) -> DataFrame:
    rows = code.filter("embedding is not null")
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    none = lambda t="string": F.lit(None).cast(t)
    return rows.select("id", F.lit(CODE).alias("kind"), F.col("file_path").alias("title"), F.col("summary").alias("content"), "embedding", none().alias("chunk_id"), F.lit(CODE).alias("source_type"), none().alias("source_id"), none("int").alias("source_line_start"), none("int").alias("source_line_end"))


def deep_search(memory: DataFrame, chunks: DataFrame, code: DataFrame, sessions: DataFrame, query: list[float], limit: int = 10, source_types: list[str] | None = None, project_id: str | None = None, depth: str = "auto", around: int = 25) -> DataFrame:
    """The best rows of both branches with score (4 digits), reference and, where depth asks for it, the lines around.

    Lines come from the sessions' rendered text (id, text). depth: 'full' for every session hit, 'auto' for those scored above 0.6, 'none'.
    """
    plan = plan_sources(source_types)
    branches = memory_branch(memory, chunks, plan, project_id)
    if plan.kinds == () and not plan.code:
        branches = branches.limit(0)
    if plan.code:
        branches = branches.unionByName(code_branch(code, project_id))
    best = vector_top_k(branches, query, limit).drop("embedding")
    deep = F.lit(depth == "full") | (F.lit(depth == "auto") & (F.col("score") > 0.6))
    drilled = best.join(sessions.select(F.col("id").alias("session_id"), "text"), (F.col("source_id") == F.col("session_id")) & (F.col("source_type") == "session") & deep, "left")
    window = F.when(F.col("text").isNotNull(), line_window(F.col("text"), F.col("source_line_start"), F.col("source_line_end"), around))
    return drilled.select("id", "kind", "title", "content", F.round("score", 4).alias("score"), source_reference(F.coalesce("source_type", "kind"), F.coalesce("source_id", "id"), F.col("source_line_start"), F.col("source_line_end")).alias("reference"), window.alias("context"))


def source_context(chunks: DataFrame, sessions: DataFrame, chunk_id: str, around: int = 50) -> DataFrame:
    """The lines around one chunk in its session."""
    hit = chunks.filter(F.col("id") == chunk_id).join(sessions.select(F.col("id").alias("session_id"), "text"), F.col("source_id") == F.col("session_id"), "left")
    return hit.select("id", line_window(F.col("text"), F.col("source_line_start"), F.col("source_line_end"), around).alias("context"))
