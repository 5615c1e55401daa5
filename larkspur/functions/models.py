"""Model calls as plug-ins (F3-F6, W20, W24): batches in Arrow, a fallback to single rows, a zero vector when all fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.findings import parse_lessons
from larkspur.session import ship

Embedder = Callable[[list[str]], list[list[float]]]
Writer = Callable[[str], "str | None"]

# How much text a summary and a lesson extractor get, and rows of a batch.
SUMMARY_CUT, LESSON_CUT, BATCH = 12_000, 8_000, 20

_registry: dict[str, Callable] = {}


def register(name: str) -> Callable[[Callable], Callable]:
    """Name a plug-in: an adapter, a channel or a model."""

    def add(f: Callable) -> Callable:
        _registry[name] = f
        return f

    return add


def plugin(name: str) -> Callable:
    return _registry[name]


@register("hash-embedding")
def hash_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A deterministic stand-in: signed word hashes, normalised."""
    import xxhash

    out = []
    for t in texts:
        v = np.zeros(size)
        for w in t.lower().split():
            h = xxhash.xxh3_64_intdigest(w.encode())
            v[h % size] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


@register("extract")
def extract(text: str, sentences: int = 2) -> str | None:
    """An extractive stand-in for a summariser: the first sentences."""
    parts = [p.strip() for p in text[:SUMMARY_CUT].replace("\n", " ").split(". ") if p.strip()]
    return ". ".join(parts[:sentences]) or None


def embed(df: DataFrame, text_col: str, out: str, embedder: Embedder = hash_embedding, size: int = 64, batch: int = BATCH) -> DataFrame:
    """df with a vector of each text; a failing batch is tried row by row, a failing row gets zeros."""

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled, found = texts.fillna("").tolist(), []
            for at in range(0, len(filled), batch):
                some = filled[at : at + batch]
                try:
                    found += embedder(some)
                except Exception:
                    for t in some:
                        try:
                            found += embedder([t])
                        except Exception:
                            found.append([0.0] * size)
            yield pd.Series(found, dtype=object)

    ship(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(vectors, "array<float>")(F.col(text_col).cast("string")))


def reembed(df: DataFrame, text_col: str, embedder: Embedder = hash_embedding, size: int = 64) -> DataFrame:
    """Every row's `embedding` computed anew."""
    return embed(df.drop("embedding"), text_col, "embedding", embedder, size)


def summarise(df: DataFrame, text_col: str, out: str, writer: Writer = extract, cut: int = SUMMARY_CUT) -> DataFrame:
    def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else writer(t[:cut]), na_action="ignore")

    ship(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(written, "string")(F.col(text_col).cast("string")))


def fill_summaries(sessions: DataFrame, writer: Writer = extract) -> tuple[DataFrame, DataFrame]:
    """Sessions with missing summaries filled, and the summary chunks to append."""
    missing = summarise(sessions.filter("summary is null").drop("summary"), "raw_content", "summary", writer).filter("summary is not null")
    filled = sessions.join(missing.select("id", F.col("summary").alias("_lk_new")), "id", "left").withColumn("summary", F.coalesce("summary", "_lk_new")).select(*sessions.columns)
    chunks = missing.select("project_id", F.lit("session").alias("source_type"), F.col("id").alias("source_id"), F.col("summary").alias("content"))
    return filled, chunks


def extract_lessons(findings: DataFrame, writer: Writer) -> DataFrame:
    """(job_id, lesson, category, context) from what writer makes of a job's findings (job_id, created_at, id, content), joined in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))), lambda x: x["content"]), "\n")
    told = summarise(findings.groupBy("job_id").agg(joined.alias("text")), "text", "answer", writer, LESSON_CUT)
    return told.select("job_id", F.explode(parse_lessons(F.col("answer"))).alias("l")).select("job_id", "l.*")
