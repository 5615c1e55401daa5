"""Sharding by proportional stratified interleaving.

Each source's rows are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + 1/2) / rows of its
source. Sorted by it, every stretch of the order has the sources in the corpus's proportions; equal stretches are
the shards. Law: `rows`, the counts of any two shards differ by one at most.

Neither ranking nor sorting gathers a source or a shard in one task: rows are dealt into buckets of bounded size, by
ranges of the hash, then by ranges of the fractional rank, and the buckets' counts say where each starts. The hash is of the id and
the text's checksum and size, so rows with a null or repeated id are spread by what they hold.

Defined results: a null source is a source of its own; a null text has size 1 and the checksum of no bytes; rows
with a null id or with the same id are kept and ranked by hash, id, checksum and size; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import bucket_count, ranked
from larkspur.session import cut

#: Rows of one window.
BUCKET_ROWS = 20_000
_HASH_BITS = 48


def _seeded(seed: int, *columns: str) -> Column:
    """A hash in [0, 2^48), the same on every system that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("long")


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot) of every row; slots are gapless from 0 in each shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # of the id and the text, so that rows without an id are spread too
    rows = cut(rows.withColumn("_lk_hash", _seeded(seed, "id", "text_crc32", "size")), "shard-rows")
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_lk_source_rows"))
    total = rows.count()
    buckets = bucket_count(total, BUCKET_ROWS)
    ties = [F.col(c) for c in ("_lk_hash", "id", "text_crc32", "size")]
    spread = F.floor(F.col("_lk_hash") / F.lit(float(1 << _HASH_BITS)) * F.lit(buckets))
    by_source = ranked(rows, ["source"], spread, ties, "_lk_rank")
    sized = by_source.join(sources.withColumnRenamed("source", "_lk_source"), F.col("source").eqNullSafe(F.col("_lk_source")), "left").drop("_lk_source")
    fraction = sized.withColumn("_lk_at", (F.col("_lk_rank") + 0.5) / F.col("_lk_source_rows"))
    spread = F.least(F.floor(F.col("_lk_at") * buckets), F.lit(buckets - 1))
    ordered = ranked(fraction, [], spread, [F.col("_lk_at"), *ties], "_lk_place")
    shard = F.expr(f"_lk_place * {shards} div {max(1, total)}").cast("int")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ordered.withColumn("shard", shard).withColumn("slot", (F.col("_lk_place") - first).cast("long")).select("id", "source", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of docs, whose ids must be unique, to one folder a shard, in slot order within each file."""
    placed = docs.join(assigned.select(F.col("id").alias("_lk_id"), "shard", "slot"), F.col(id_col).eqNullSafe(F.col("_lk_id"))).drop("_lk_id")
    placed.repartition("shard", F.expr(f"slot div {BUCKET_ROWS}")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
