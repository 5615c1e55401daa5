"""Change capture between snapshots that carry a digest of each bucket (F2).

A snapshot's rows are dealt into buckets by a hash of their ids and lie in Parquet partitioned by bucket. Beside them stands a table with one row a bucket: how many rows it has
and two sums over the rows' SHA-256, so the digest doesn't depend on the rows' order. Two snapshots are compared by these tables first,
and only buckets whose digests differ are read, joined and compared row by row. A bucket that didn't change costs one row of the digest table.

Defined results: rows are compared by their canonical JSON with columns in the order of their names; two snapshots need equally many buckets and the same columns; rows that repeat count as often as they
are there; a null id is a bucket's row like others, but, as it can't be told from another null, it is not compared row by row; an empty table is a snapshot without buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.ledger import change_log
from larkspur.session import shared_dir

#: Buckets of a snapshot, and the most that one may have: their digests are compared on the driver's side of a filter.
BUCKETS, MOST_BUCKETS = 256, 65_536
_DIGEST = "bucket int, n long, a decimal(38,0), b decimal(38,0)"


@dataclass(frozen=True)
class Snapshot:
    """A written snapshot: `rows`, partitioned by _lk_bucket, and `digests`, below path."""

    spark: SparkSession
    path: str
    schema: T.StructType
    ident: str
    buckets: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_lk_bucket", T.IntegerType())])).parquet(f"{self.path}/rows")

    @property
    def digests(self) -> DataFrame:
        return self.spark.read.schema(_DIGEST).parquet(f"{self.path}/digests")

    def of(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; no other bucket is read."""
        return self.rows.filter(F.col("_lk_bucket").isin(buckets)).drop("_lk_bucket")


def write_snapshot(df: DataFrame, ident: str = "id", buckets: int = BUCKETS, path: str | None = None) -> Snapshot:
    """A snapshot of df, in a new folder below the shared one unless path names one."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MOST_BUCKETS}")
    spark = df.sparkSession
    out = Snapshot(spark, path or f"{shared_dir(spark)}/tables/snapshot-{uuid.uuid4().hex}", df.schema, ident, buckets)
    dealt = df.withColumn("_lk_bucket", F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int")).repartition("_lk_bucket")
    spark.createDataFrame([], df.schema).write.parquet(f"{out.path}/rows")
    dealt.write.mode("append").partitionBy("_lk_bucket").parquet(f"{out.path}/rows")
    payload = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring(payload, at, 15), 16, 10).cast("decimal(38,0)")
    digests = out.rows.groupBy(F.col("_lk_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).cast("decimal(38,0)").alias("a"), F.sum(part(16)).cast("decimal(38,0)").alias("b"))
    digests.write.parquet(f"{out.path}/digests")
    return out


def changed_buckets(before: Snapshot, after: Snapshot) -> list[int]:
    """The buckets whose digests differ, from the digest tables alone."""
    if before.buckets != after.buckets or before.ident != after.ident:
        raise ValueError("the snapshots are dealt differently")
    if sorted(before.schema.names) != sorted(after.schema.names):
        raise ValueError("the snapshots have other columns")
    old, new = (s.digests.select("bucket", F.struct("n", "a", "b").alias(n)) for s, n in ((before, "old"), (after, "new")))
    differ = old.join(new, "bucket", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return sorted(r["bucket"] for r in differ.select("bucket").collect())  # MOST_BUCKETS numbers at most


def changes_between(before: Snapshot, after: Snapshot) -> DataFrame:
    """(id, operation, payload_hash) of each row that the snapshots differ in, as change_log gives it, from the buckets that changed."""
    buckets = changed_buckets(before, after)
    return change_log(before.of(buckets), after.of(buckets), before.ident)
