"""Nearest neighbours by inner product: anisotropic product quantisation, four-bit table scans, exact reranking.

Each two dimensions get a codebook of 16 centres. Centres and codes minimise a loss that weighs the residual's part
along the vector `eta` times as much as the rest, since that part is what moves large inner products. The codebooks are fitted
on at most SAMPLE vectors, those whose ids have the least hashes; every vector is coded. A query's inner products with all
centres make its tables; a block of codes is scanned two codes a look-up, and the best distinct vectors are scored again from the original vectors in double
precision, products added in the order of the dimensions: first RERANK of them, then twice as many, until the next
one's approximate score, raised by the mean and MARGIN deviations of the errors seen, is below the k-th best. So a
dense cluster whose codes are alike is reranked whole.

Queries go in blocks of about QUERY_BLOCK, which travel to the tasks (some MB); each block scans the index where it lies, ROW_BLOCK rows at a time, and a task gives each query's best k
of all its rows. So rows aren't shuffled, and what is grows with queries times tasks. Equal vectors of a block are scanned once, so copies can't crowd out others.

Defined results: vectors that are null, zero, hold a null, NaN or infinite component, or have another length than most, take no part,
nor do rows with a null id; of rows with the same id and different vectors each is a candidate, and the least vector is the
query; an id is found once; ties go to the smaller id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import bucket_count
from larkspur.session import cut

SAMPLE, RERANK, MARGIN = 20_000, 128, 3.0
ROW_BLOCK, QUERY_BLOCK, AT_ONCE = 16_384, 8_192, 32
#: Inner products under this share of the norms count little; it sets eta.
THRESHOLD = 0.2


def _usable(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = docs.select(F.col(id_col).alias("id"), v.alias("v")).filter("id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(good)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _loss_parts(x: np.ndarray, eta: float) -> tuple[np.ndarray, float]:
    return x / np.linalg.norm(x, axis=1, keepdims=True), eta - 1


def assign_codes(x: np.ndarray, books: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes (n, parts) of the vectors, part after part with the others held, from the nearest centres on."""
    parts = books.shape[0]
    u, w = _loss_parts(x, eta)
    xs, us = x.reshape(len(x), parts, 2), u.reshape(len(x), parts, 2)
    plain = ((xs[:, :, None, :] - books[None]) ** 2).sum(-1)
    codes = plain.argmin(2)
    along = (xs * us).sum(2)[:, :, None] - np.einsum("npd,pcd->npc", us, books)  # of the residual, along x
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(passes):
        for p in range(parts):
            rest = total - along[rows, p, codes[:, p]]
            codes[:, p] = (plain[:, p] + w * (rest[:, None] + along[:, p]) ** 2).argmin(1)
            total = rest + along[rows, p, codes[:, p]]
    return codes


def fit_codebooks(x: np.ndarray, rounds: int = 4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Codebooks (parts, 16, 2) and eta for vectors of an even length."""
    n, d = x.shape
    parts, rng = d // 2, np.random.default_rng(seed)
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    xs = x.reshape(n, parts, 2)
    books = np.stack([xs[rng.integers(n, size=16), p] for p in range(parts)])
    for _ in range(8):
        for p in range(parts):
            near = ((xs[:, p, None] - books[p]) ** 2).sum(2).argmin(1)
            hits = np.bincount(near, minlength=16)
            sums = np.stack([np.bincount(near, xs[:, p, k], minlength=16) for k in (0, 1)], 1)
            books[p][hits > 0] = (sums / np.maximum(hits, 1)[:, None])[hits > 0]
    u, w = _loss_parts(x, eta)
    us = u.reshape(n, parts, 2)
    for _ in range(rounds):
        codes = assign_codes(x, books, eta)
        residual = xs - books[np.arange(parts), codes]
        along = (residual * us).sum(2)
        total = along.sum(1)
        for p in range(parts):
            rest = total - along[:, p]
            target = xs[:, p] + w * us[:, p] * (rest + (xs[:, p] * us[:, p]).sum(1))[:, None]
            outer = w * us[:, p, :, None] * us[:, p, None, :] + np.eye(2)
            for c in range(16):
                own = codes[:, p] == c
                if own.any():
                    books[p, c] = np.linalg.solve(outer[own].sum(0), target[own].sum(0))
            along[:, p] = ((xs[:, p] - books[p, codes[:, p]]) * us[:, p]).sum(1)
            total = rest + along[:, p]
    return books, eta


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in blocks of ROW_BLOCK, the last one smaller."""
    held, n = [], 0
    for b in batches:
        while len(b):
            some = b.slice(0, ROW_BLOCK - n)
            b = b.slice(len(some))
            held.append(some)
            n += len(some)
            if n == ROW_BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def build_index(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray | None]:
    """(id, v, codes) of every usable row, 4 bits a code, as a table; and the codebooks."""
    rows = _usable(docs, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v")
    if not len(sample):
        return cut(rows.withColumn("codes", F.lit(b"")), "index"), None
    books, eta = fit_codebooks(_even(_matrix(sample)))
    schema = T.StructType([*rows.schema.fields, T.StructField("codes", T.BinaryType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                codes = assign_codes(_even(_matrix(b.column("v"))), books, eta).astype(np.uint8)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, 0::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([r.tobytes() for r in packed], pa.binary())], schema.names)

    return cut(rows.mapInArrow(coded, schema), "index"), books


def _tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(query, byte, 256): the inner products with what the two codes of a byte stand for."""
    parts = books.shape[0]
    single = np.einsum("qpd,pcd->qpc", _even(queries).reshape(len(queries), parts, 2), books)
    single = np.pad(single, ((0, 0), (0, parts % 2), (0, 0)))
    low, high = single[:, 0::2], single[:, 1::2]
    return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def _scan(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a block, the k best ids of a block of rows and their exact scores."""
    _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).reshape(-1), return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    bounds = np.searchsorted(group[order], np.arange(len(first) + 1))
    distinct, some = vectors[first], np.ascontiguousarray(codes[first].T)
    for at in range(0, len(queries), AT_ONCE):
        tables = _tables(queries[at : at + AT_ONCE], books)
        scores = np.zeros((len(tables), len(first)), np.float32)
        for byte in range(some.shape[0]):
            scores += tables[:, byte, some[byte]]
        for j in range(len(tables)):
            q = queries[at + j]
            best, exact, done = np.empty(0, np.int64), np.empty(0), 0
            ranks = np.argsort(-scores[j], kind="stable")
            while done < len(ranks):
                more = ranks[done : max(RERANK, 2 * done)]
                score = np.zeros(len(more))
                for dim in range(len(q)):
                    score += distinct[more, dim] * q[dim]
                best, exact, done = np.append(best, more), np.append(exact, score), done + len(more)
                if done < len(ranks) and done > k:
                    error = exact - scores[j][best]
                    if scores[j][ranks[done]] + error.mean() + MARGIN * error.std() < np.partition(exact, -k - 1)[-k - 1]:
                        break
            members = [ids[order[bounds[g] : bounds[g + 1]]] for g in best.tolist()]
            members = [np.unique(m)[: k + 1] for m in members]
            who = np.concatenate(members)
            what = np.repeat(exact, [len(m) for m in members])
            what, who = what[who != q_ids[at + j]], who[who != q_ids[at + j]]
            ranks = np.lexsort((who, -what))
            who, what = who[ranks], what[ranks]
            once = np.sort(np.unique(who, return_index=True)[1])[:k]
            yield at + j, who[once], what[once]


def _kept(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of each query among (query, id, score), ties to the smaller id; an id is kept once."""
    query, who, what = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-what, who, query))
    query, who, what = query[order], who[order], what[order]
    best = np.append(True, (query[1:] != query[:-1]) | (who[1:] != who[:-1])) if len(query) else np.empty(0, bool)
    query, who, what = query[best], who[best], what[best]
    order = np.lexsort((who, -what, query))
    query, who, what = query[order], who[order], what[order]
    stays = np.arange(len(query)) - np.searchsorted(query, query) < k
    return [(query[stays], who[stays], what[stays])]


def search(index: DataFrame, books: np.ndarray | None, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row of the index that is a query."""
    id_type, spark = index.schema["id"].dataType, index.sparkSession
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    queries = cut(index.filter(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = bucket_count(queries.count(), QUERY_BLOCK)
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == block).toArrow()  # about QUERY_BLOCK rows
        if not len(asked):
            continue
        sent = spark.sparkContext.broadcast((asked.column("id").to_numpy(), _matrix(asked.column("v"))))

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q_vectors = sent.value  # noqa: B023
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for rows in _row_blocks(batches):
                vectors = np.ascontiguousarray(_matrix(rows.column("v")))
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(rows), -1)
                held += [(np.full(len(who), j), who, what) for j, who, what in _scan(q_ids, q_vectors, rows.column("id").to_numpy(), vectors, codes, books, k)]
                held = _kept(held, k) if held else held
            for query, who, what in held:
                for at in range(0, len(query), ROW_BLOCK):
                    part = slice(at, at + ROW_BLOCK)
                    kind = asked.schema.field("id").type  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[query[part]], kind), pa.array(who[part], kind), pa.array(what[part])], schema.names)

        found = found.unionByName(cut(index.select("id", "v", "codes").mapInArrow(scanned, schema), "nearest"))
        sent.destroy()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
