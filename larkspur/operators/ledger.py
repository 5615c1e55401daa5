"""A hash-chained ledger: appending, verifying without one task for the whole chain, also as a table function of SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from larkspur.session import shared_dir, ship

#: Rows of one stretch that is verified by one window.
STRETCH = 100_000
_BREAK = T.StructType([T.StructField("broken_at_seq", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("expected_hash", "actual_hash", "reason")]])


def row_hash(seq: Column, memory_id: Column, operation: Column, actor: Column, slug: Column, payload_hash: Column, prev_hash: Column) -> Column:
    """A row's hash; null where a part but the previous hash is null, so that such a row never verifies."""
    bar = F.lit("|")
    return F.sha2(F.concat(seq.cast("string"), bar, memory_id, bar, operation, bar, actor, bar, slug, bar, payload_hash, bar, F.coalesce(prev_hash, F.lit(""))), 256)


def _hash_of(seq: int, memory_id: str, operation: str, actor: str, slug: str, payload_hash: str, prev_hash: str | None) -> str:
    return hashlib.sha256("|".join([str(seq), memory_id, operation, actor, slug, payload_hash, prev_hash or ""]).encode()).hexdigest()


def classify(old_archived: Column, new_archived: Column, has_old: Column, has_new: Column) -> Column:
    return F.when(~has_old, "create").when(~has_new, "delete").when(old_archived.isNull() & new_archived.isNotNull(), "archive").when(old_archived.isNotNull() & new_archived.isNull(), "restore").otherwise("update")


def change_log(before: DataFrame, after: DataFrame, ident: str = "id") -> DataFrame:
    """(id, operation, payload_hash) of each row that two snapshots of memory differ in; payloads are canonical JSON of sorted columns."""
    columns = sorted(after.columns)
    pack = lambda df, n: df.select(F.col(ident).alias(f"{n}_id"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(f"{n}_payload"), F.col("archived_at").alias(f"{n}_archived"))
    both = pack(before, "old").join(pack(after, "new"), F.col("old_id") == F.col("new_id"), "full_outer").filter("not (old_payload <=> new_payload)")
    op = classify(F.col("old_archived"), F.col("new_archived"), F.col("old_id").isNotNull(), F.col("new_id").isNotNull())
    return both.select(F.coalesce("new_id", "old_id").alias(ident), op.alias("operation"), F.sha2(F.coalesce("new_payload", "old_payload"), 256).alias("payload_hash"))


def build_chain(changes: DataFrame, last_hash: str | None = None) -> DataFrame:
    """changes (seq, memory_id, operation, actor, project_slug, payload_hash) with prev_hash and row_hash; last_hash: of the row that the ledger ends with.

    Each hash needs the one before, so the ledger has a single writer. It takes stretches of STRETCH numbers one after the other, each
    in one task, and hands on the last hash only; no task or driver holds more than a stretch. A stretch is a folder that is read and written by itself, so what it
    costs doesn't grow with the ledger; all that a hash is made of but the one before is put together by all tasks beforehand. A null in a field is an error, as the ledger's columns have none.
    """
    spark = changes.sparkSession
    ship(spark)
    fields = ["seq", "memory_id", "operation", "actor", "project_slug", "payload_hash"]
    schema = T.StructType([T.StructField("seq", T.LongType()), *[T.StructField(f, T.StringType()) for f in [*fields[1:], "prev_hash", "row_hash"]]])
    given = T.StructType([*schema.fields[:6], T.StructField("_lk_text", T.StringType())])
    rows = changes.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields[:6]])
    rows = rows.withColumn("_lk_text", F.concat(*[x for f in fields for x in (F.col(f).cast("string"), F.lit("|"))])).withColumn("_lk_part", F.coalesce(F.expr(f"seq div {STRETCH}"), F.lit(0)))
    base = f"{shared_dir(spark)}/tables/chain-{uuid.uuid4().hex}"
    rows.repartition("_lk_part").write.option("compression", "zstd").partitionBy("_lk_part").parquet(f"{base}/changes")
    dealt = spark.read.schema(T.StructType([*given.fields, T.StructField("_lk_part", T.LongType())])).parquet(f"{base}/changes")

    def chained(last: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = last
            for batch in batches:
                prev, own = [], []
                for i, text in enumerate(batch.column(6).to_pylist()):
                    if text is None:
                        raise ValueError(f"a change has a null: {batch.slice(i, 1).to_pylist()[0]}")
                    prev.append(before)
                    before = hashlib.sha256((text + (before or "")).encode()).hexdigest()
                    own.append(before)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(prev, pa.string()), pa.array(own, pa.string())], schema.names)

        return run

    parts = sorted(r[0] for r in dealt.select("_lk_part").distinct().collect())  # a number a stretch
    for part in parts:
        stretch = spark.read.schema(given).parquet(f"{base}/changes/_lk_part={part}").coalesce(1).sortWithinPartitions("seq")
        told = Observation()
        stretch.mapInArrow(chained(last_hash), schema).observe(told, F.max_by("row_hash", "seq").alias("last")).write.parquet(f"{base}/chain/{part}")
        last_hash = told.get["last"]
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/chain") if parts else spark.createDataFrame([], schema)


def _ends(rows: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """(part, columns): the last row of each part by seq, found by its number, so that no text is sorted or shuffled for it; a row a part, which is sent to the rows."""
    last = rows.groupBy(part).agg(F.max("seq").alias("_lk_seq")).select(F.col(part).alias("_lk_of"), "_lk_seq")
    found = rows.join(F.broadcast(last), (F.col(part) == F.col("_lk_of")) & (F.col("seq") == F.col("_lk_seq")))
    return found.groupBy(part).agg(F.max_by(F.struct(*columns), "seq").alias("_lk_end")).select(part, "_lk_end.*")


def verify_chain(ledger: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """The first break in [start, end]: (broken_at_seq, expected, actual, reason); no row if the chain is whole.

    prev_hash is held against the previous row first, then the row's own hash. A start above 1 needs the row before it, or one row with
    seq 0 and reason gap-before-start is the result. Stretches of seq are windows of their own; the last hash of each, one row a
    stretch, meets the first row of the next by a join.
    """
    span = F.col("seq") >= start
    rows = ledger.filter(span if end is None else span & (F.col("seq") <= end)).withColumn("_lk_part", F.expr(f"seq div {STRETCH}"))
    within = Window.partitionBy("_lk_part").orderBy("seq")
    lagged = rows.withColumn("_lk_prev", F.lag("row_hash").over(within)).withColumn("_lk_first", F.row_number().over(within) == 1)
    ends = _ends(rows, "_lk_part", ["row_hash"]).withColumnRenamed("row_hash", "_lk_last")
    before_start = ledger.filter(F.col("seq") == start - 1).select(F.lit(-1).cast("long").alias("_lk_part"), F.col("row_hash").alias("_lk_last"))
    chain = ends.unionByName(before_start).withColumn("_lk_to", F.lead("_lk_part").over(Window.orderBy("_lk_part"))).filter("_lk_to is not null").select(F.col("_lk_to").alias("_lk_part"), "_lk_last")
    known = lagged.join(chain, "_lk_part", "left").withColumn("_lk_prev", F.when(F.col("_lk_first"), F.col("_lk_last")).otherwise(F.col("_lk_prev")))
    own = row_hash(*[F.col(c) for c in ("seq", "memory_id", "operation", "actor", "project_slug", "payload_hash", "prev_hash")])
    bad_prev = ~F.col("prev_hash").eqNullSafe(F.col("_lk_prev"))
    bad_row = ~F.col("row_hash").eqNullSafe(own)
    breaks = known.filter(bad_prev | bad_row).select(F.col("seq").cast("long").alias("broken_at_seq"), F.when(bad_prev, F.col("_lk_prev")).otherwise(own).alias("expected"), F.when(bad_prev, F.col("prev_hash")).otherwise(F.col("row_hash")).alias("actual"), F.when(bad_prev, "prev_hash").otherwise("row_hash").alias("reason"))
    if start > 1:
        gap = ledger.agg(F.count_if(F.col("seq") == start - 1).alias("n")).filter("n = 0").select(F.lit(0).cast("long").alias("broken_at_seq"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"), F.lit("gap-before-start").alias("reason"))
        breaks = breaks.unionByName(gap)
    return breaks.orderBy("broken_at_seq").limit(1)


def stretches(ledger: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """The ledger as the table function verify_chain reads it, dealt into stretches: with stretch, and own, which is false for what a stretch needs to know of others.

    Of a range that ends, what lies behind it isn't dealt; nor is what lies before the row that a range's start needs.

    That is the last row before it, one row a stretch, and for the stretch that start lies in a row with seq null, so that it is looked at even where it has no rows.
    """
    columns = ["seq", "memory_id", "operation", "actor", "project_slug", "payload_hash", "prev_hash", "row_hash"]
    inside = F.col("seq") >= start - 1
    rows = ledger.filter(inside if end is None else inside & (F.col("seq") <= end)).select(*columns).withColumn("stretch", F.expr(f"seq div {STRETCH}")).withColumn("own", F.lit(True))
    ends = _ends(rows, "stretch", columns)
    carried = ends.withColumn("to", F.lead("stretch").over(Window.orderBy("stretch"))).filter("to is not null").select(*columns, F.col("to").alias("stretch"), F.lit(False).alias("own"))
    mark = ledger.sparkSession.range(1).select(*[F.lit(None).cast(ledger.schema[c].dataType).alias(c) for c in columns], F.lit(start // STRETCH).cast("long").alias("stretch"), F.lit(False).alias("own"))
    return rows.unionByName(carried).unionByName(mark)


@udtf(returnType=_BREAK)
class VerifyChain:
    """verify_chain(TABLE(...) PARTITION BY stretch ORDER BY seq, start_seq => 1, end_seq => NULL): the first break of each stretch, over rows as `stretches` deals them.

    A break is (seq, expected, actual, which), '' for no hash; broken_at_seq is 0 where start_seq is above 1 and the row before it isn't there. The row with the least
    broken_at_seq is the chain's first break; no row says that the range is whole.
    """

    def __init__(self) -> None:
        self.parts = None
        self.previous: str | None = None
        self.has_predecessor = self.holds_start = False
        self.found: tuple | None = None
        self.start = 1

    def eval(self, row: Row, start_seq: int = 1, end_seq: int | None = None) -> None:
        if self.found is not None:
            return
        if self.parts is None:
            # a Row looks a column up by going through all names
            self.parts = itemgetter(*map(row.__fields__.index, ("stretch", "own", "row_hash", "prev_hash", "seq", "memory_id", "operation", "actor", "project_slug", "payload_hash")))
            self.start = start_seq
        stretch, is_own, row_hash, prev_hash, *parts = self.parts(tuple(row))
        if stretch == start_seq // STRETCH:
            self.holds_start = True
        seq = parts[0]
        if seq is None or seq < start_seq - 1 or (end_seq is not None and seq > end_seq):
            return
        if seq == start_seq - 1:
            self.has_predecessor = True
        if seq < start_seq or not is_own:
            self.previous = row_hash if seq >= 1 else None
            return
        own = None if None in parts else _hash_of(*parts, prev_hash)
        if prev_hash != self.previous:
            self.found = seq, self.previous or "", prev_hash or "", "prev_hash-mismatch"
        elif row_hash is None or row_hash != own:
            self.found = seq, own, row_hash, "row_hash-mismatch"
        self.previous = row_hash

    def terminate(self) -> Iterator[tuple]:
        if self.holds_start and self.start > 1 and not self.has_predecessor:
            yield 0, None, None, "gap-before-start"
        elif self.found is not None:
            yield self.found


def register_functions(spark: SparkSession) -> None:
    """Make verify_chain known to the session's SQL."""
    ship(spark)
    spark.udtf.register("verify_chain", VerifyChain)


def slug_range(ledger: DataFrame, slug: str) -> DataFrame:
    return ledger.filter(F.col("project_slug") == slug).agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def range_count(ledger: DataFrame, start: int, end: int | None = None, slug: str | None = None) -> DataFrame:
    rows = ledger.filter(F.col("seq") >= start)
    rows = rows if end is None else rows.filter(F.col("seq") <= end)
    rows = rows if slug is None else rows.filter(F.col("project_slug") == slug)
    return rows.agg(F.count(F.lit(1)).alias("n"))
