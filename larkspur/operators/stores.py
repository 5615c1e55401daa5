"""Stored tables that a merge changes in part (W3-W6): rows lie in Parquet by buckets of their keys, and only buckets that get rows are read and written.

A write replaces whole buckets by dynamic partition overwrite, so the files of all others keep their names and contents.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.merge import upsert
from larkspur.session import cut, shared_dir

#: Buckets of a store, and the most that one may have: their numbers stand in a filter.
BUCKETS, MOST_BUCKETS = 256, 65_536


@dataclass(frozen=True)
class Store:
    """A stored table: its rows below path, partitioned by _lk_bucket, by keys."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("_lk_bucket")

    def _whole(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_lk_bucket", T.IntegerType())])).parquet(self.path)

    @property
    def rows(self) -> DataFrame:
        return self._whole().drop("_lk_bucket")

    def of(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; no other is read."""
        return self._whole().filter(F.col("_lk_bucket").isin(buckets)).drop("_lk_bucket")

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.select(*self.schema.names, self._bucket()).repartition("_lk_bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_lk_bucket").parquet(self.path)

    def upsert(self, rows: DataFrame, latest: Column, keep_old: list[str] = (), overwrite: bool = True) -> list[int]:
        """Merge rows in as operators.merge.upsert does, and return the buckets that were written, which are those of the rows' keys.

        Rows with a null in a key are rows of their own, which match nothing. What is to be written is worked out and stored before a bucket is replaced, as it is
        read from the same buckets.
        """
        given = cut(rows, "given")
        touched = sorted(r[0] for r in given.select(self._bucket()).distinct().collect())  # MOST_BUCKETS numbers at most
        if touched:
            self._write(cut(upsert(self.of(touched), given, list(self.keys), latest, keep_old, overwrite), "merged"))
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Delete the rows of some keys; returns the buckets that were written. A bucket that loses all its rows is left with an empty file."""
        given = cut(keys.select(*self.keys).distinct(), "given")
        touched = sorted(r[0] for r in given.select(self._bucket()).distinct().collect())
        for_now = cut(self.of(touched).join(given, list(self.keys), "left_anti"), "kept")
        left = {r[0] for r in for_now.select(self._bucket()).distinct().collect()}
        if left:
            self._write(for_now)
        for bucket in sorted(set(touched) - left):
            self.spark.createDataFrame([], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_lk_bucket={bucket}")
        return touched


def create_store(df: DataFrame, keys: list[str], buckets: int = BUCKETS, path: str | None = None) -> Store:
    """A store of df's rows, in a new folder below the shared one unless path names one."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MOST_BUCKETS}")
    spark = df.sparkSession
    store = Store(spark, path or f"{shared_dir(spark)}/tables/store-{uuid.uuid4().hex}", df.schema, tuple(keys), buckets)
    spark.createDataFrame([], df.schema).write.parquet(store.path)
    store._write(df)
    return store
