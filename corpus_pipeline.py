"""From raw documents to packed training sequences: quality, line dedup, near-dedup, mixing, packing.

Every stage works on all rows that the one before kept, written as Parquet and read again. An empty table gives an empty result, and columns
beside those of documents are passed on by all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.linededup import remove_repeated_runs
from larkspur.llm.mixing import mix_documents
from larkspur.llm.neardup import remove_near_duplicates
from larkspur.llm.packing import pack_documents
from larkspur.llm.quality import filter_quality
from larkspur.session import cut, ship

#: No source is read more often than this; every document is read at least once.
REPETITION = 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose perplexity lies in their language's and fold's band.

    Null, empty and short texts go; a null language is one of its own; rows that repeat, or whose id is null or repeats, are judged each; very long texts are read whole.
    """
    ship(spark)
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two or more lines go, but for their first occurrence; n_chars follows; a text that loses all its words goes.

    The first occurrence is in the least id (null first), then text, then place. Rows with one id and text keep and lose the same lines; null texts stay null.
    """
    ship(spark)
    done = remove_repeated_runs(docs)
    removed = F.col(done.columns[-1]) > 0
    emptied = removed & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chars = F.when(removed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.filter(~emptied).select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Of a group the row with the least id (null first), then the least MD5 of its text stays; an id's other texts are judged for themselves; rows that repeat id and text
    stay once; null texts and those without words are in no group.
    """
    ship(spark)
    return remove_near_duplicates(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every document at least once, those of small sources up to REPETITION times.

    A null source is one of its own; texts without words are read with their block; a source without any word is left out; rows that repeat are read each.
    """
    ship(spark)
    return mix_documents(docs, repetition=REPETITION, budget=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens.

    A null or empty text is the end id alone; longer texts than a sequence are cut; rows that repeat are packed each.
    """
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), by_word=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing to weights", mixing), ("best-fit packing", packing)]

#: Tokenizers, language models and MinHash are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
