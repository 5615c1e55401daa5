"""Helpers shared by the operators: ranks and prefix sums without a hot task, bitmaps of hashes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut

#: Bits of a filter of hashes: 16 MB whatever the input. Where it fills up it lets more pass, and an exact join behind it decides.
FILTER_BITS = 27
#: Buckets that one window over bucket sums holds.
GROUP = 4096


def bucket_count(rows: int, per_bucket: int) -> int:
    return max(1, math.ceil(rows / per_bucket))


def prefix_sums(df: DataFrame, strata: list[str], spread: Column, order: list[Column], weight: Column, out: str) -> DataFrame:
    """df with out: the sum of weight over the rows of a stratum that stand before a row, without one task per stratum.

    spread is a bucket's number from 0; rows stand in the order of their bucket, then of order. Each (stratum, bucket) is a
    window of its own; the buckets' sums, one row each, are added up in groups of GROUP buckets, and the groups' sums over the stratum.
    """
    df = df.withColumn("_lk_bucket", spread.cast("long")).withColumn("_lk_w", weight.cast("long"))
    keys = [*strata, "_lk_bucket"]
    sums = df.groupBy(*keys).agg(F.sum("_lk_w").alias("_lk_n")).withColumn("_lk_group", F.expr(f"_lk_bucket div {GROUP}"))
    before = lambda keys, by: Window.partitionBy(*keys or [F.lit(0)]).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    groups = sums.groupBy(*strata, "_lk_group").agg(F.sum("_lk_n").alias("_lk_n")).withColumn("_lk_first", upto("_lk_n", before(strata, ["_lk_group"])))
    named = lambda names, mark: [F.col(k).alias(f"_lk_{mark}{i}") for i, k in enumerate(names)]
    same = lambda names, mark: [F.col(k).eqNullSafe(F.col(f"_lk_{mark}{i}")) for i, k in enumerate(names)]
    of_group = [*strata, "_lk_group"]
    starts = sums.withColumn("_lk_inside", upto("_lk_n", before(of_group, ["_lk_bucket"])))
    starts = starts.join(groups.select(*named(of_group, "g"), "_lk_first"), same(of_group, "g"))
    starts = starts.select(*named(keys, "k"), (F.col("_lk_inside") + F.col("_lk_first")).alias("_lk_start"))
    placed = df.withColumn("_lk_row", upto("_lk_w", before(keys, order))).join(starts, same(keys, "k"), "left")
    return placed.withColumn(out, F.col("_lk_row") + F.col("_lk_start")).drop("_lk_bucket", "_lk_w", "_lk_row", "_lk_start", *[f"_lk_k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, strata: list[str], spread: Column, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each stratum gaplessly from 0 (see prefix_sums)."""
    return prefix_sums(df, strata, spread, order, F.lit(1), out)


def _bit(column: str) -> Column:
    return F.shiftrightunsigned(column, 64 - FILTER_BITS) + 1


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): the leading FILTER_BITS bits of the hashes as a bitmap, a table of 4096 rows at most."""
    at = _bit(column)
    return cut(hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")), "bitmap")


def passing(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """The rows of df whose hash in column may be among those of the bitmap known; JVM-side, without a shuffle of df."""
    at = F.bitmap_bit_position(_bit(column))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position(shiftrightunsigned({column}, {64 - FILTER_BITS}) + 1) & 7 as int))")) != 0
    return df.join(F.broadcast(known), (F.bitmap_bucket_number(_bit(column)) == F.col("bucket")) & is_set).drop("bucket", "bits")


def bit_array(known: DataFrame) -> np.ndarray:
    """A bitmap as bytes, for functions that run in tasks (see is_set)."""
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in known.toArrow().to_pylist():  # FILTER_BITS bits at most
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, with as many underscores after it as it takes not to clash (names are compared without case)."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def unpacked(row: str, names: list[str], **replaced: Column) -> list[Column]:
    """The fields of a packed row as columns, some of them replaced."""
    return [replaced.get(n, F.col(row).getField(n)).alias(n) for n in names]
