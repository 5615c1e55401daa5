"""Integer ranges: overlap, containment, first free range, suggestions, reclaiming."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import cut, ship

#: Pairs that a task of an overlap join looks at, about.
PAIRS = 4_000_000
#: Tasks of an overlap join at most.
MOST_TASKS = 10_000


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Pairs (left_id, right_id) of ranges (id, key, range_start, range_end) that overlap and have the same key.

    Of two ranges that overlap one holds the other's start: that one is dealt into all buckets that it reaches, the other into its start's only, and they meet there by an
    equi-join, once. Buckets are a quarter of the mean range wide by default, so most that meet overlap. A bucket has as many blocks as its pairs need, and the
    tasks follow the number of pairs, as few bytes of ranges can have very many.
    """
    named = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), F.col(key).alias("_lk_key"), F.col("range_start").cast("long").alias(f"{n}_s"), F.col("range_end").cast("long").alias(f"{n}_e")).filter(f"_lk_key is not null and {n}_s is not null and {n}_e is not null")
    sides = {"left": named(left, "left"), "right": named(right, "right")}
    if width is None:
        sizes = [df.filter(f"{n}_s <= {n}_e").agg(F.avg(F.col(f"{n}_e") - F.col(f"{n}_s") + 1)).first()[0] or 1 for n, df in sides.items()]
        width = max(1, int(max(sizes)) // 4)
    bucket = lambda c: F.expr(f"({c} - pmod({c}, {width})) div {width}")
    out = None
    for wide, narrow in (("left", "right"), ("right", "left")):
        reach = sides[wide].filter(f"{wide}_s <= {wide}_e").withColumn("_lk_bucket", F.explode(F.sequence(bucket(f"{wide}_s"), bucket(f"{wide}_e"))))
        start = sides[narrow].withColumn("_lk_bucket", bucket(f"{narrow}_s"))
        at = ["_lk_key", "_lk_bucket"]
        pairs = F.col("n").cast("double") * F.col("m")
        counts = reach.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).join(start.groupBy(*at).agg(F.count(F.lit(1)).alias("m")), at)
        blocks = cut(counts.select(*at, pairs.alias("pairs"), F.ceil(pairs / PAIRS).cast("int").alias("_lk_blocks")), "blocks")
        tasks = min(max(1, math.ceil((blocks.agg(F.sum("pairs")).first()[0] or 0) / PAIRS)), MOST_TASKS)
        blocks = blocks.select(*at, "_lk_blocks")
        reach = reach.join(blocks, at).withColumn("_lk_block", F.pmod(F.xxhash64(f"{wide}_id"), F.col("_lk_blocks")).cast("int"))
        start = start.join(blocks, at).withColumn("_lk_block", F.explode(F.sequence(F.lit(0), F.col("_lk_blocks") - 1)))
        dealt = lambda df: df.drop("_lk_blocks").repartition(tasks, *at, "_lk_block")  # noqa: B023, E731  a number of its own isn't merged by size
        # of equal starts the pair comes from the left's reach
        first = F.col("left_s") <= F.col("right_s") if wide == "left" else F.col("right_s") < F.col("left_s")
        found = dealt(reach).join(dealt(start).hint("merge"), [*at, "_lk_block"]).filter(first & overlaps(F.col("left_s"), F.col("left_e"), F.col("right_s"), F.col("right_e"))).select(F.col("_lk_key").alias(key), "left_id", "right_id")
        out = found if out is None else out.unionByName(found)
    return out


def covering(ranges: DataFrame, start: int, end: int) -> DataFrame:
    """Ranges that hold [start, end]."""
    return ranges.filter((F.col("range_start") <= start) & (F.col("range_end") >= end))


def first_free(occupied: DataFrame, base: int, size: int, cap: int = 65535, key: str = "host") -> DataFrame:
    """(key, range_start, range_end): the first free range of each key at or above base; none if it would pass the cap.

    Gaps between ranges are found by the running maximum of ends; the cap is checked on what follows the last range only.
    """
    if size < 1:
        raise ValueError("size must be positive")
    rows = occupied.filter(F.col("range_end") >= base).select(key, "range_start", "range_end")
    before = Window.partitionBy(key).orderBy("range_start", "range_end").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.lit(base), F.coalesce(F.max("range_end").over(before) + 1, F.lit(base)))
    gaps = rows.withColumn("at", start).filter(F.col("at") + size - 1 < F.col("range_start")).groupBy(key).agg(F.min("at").alias("gap"))
    tail = rows.groupBy(key).agg((F.max("range_end") + 1).alias("tail"))
    keys = occupied.select(key).distinct()
    out = keys.join(gaps, key, "left").join(tail, key, "left")
    end_of = F.coalesce("tail", F.lit(base))
    found = F.coalesce("gap", F.when(end_of + size - 1 <= cap, end_of))
    return out.withColumn("range_start", found.cast("int")).filter("range_start is not null").select(key, "range_start", (F.col("range_start") + size - 1).alias("range_end"))


def suggest(active: DataFrame, archived: DataFrame, base: int, size: int, cap: int = 65535, key: str = "host") -> DataFrame:
    """(key, range_start, range_end, needs_approval): space that not even archived ranges hold, else the first archived range that fits."""
    clean = first_free(active.select(key, "range_start", "range_end").unionByName(archived.select(key, "range_start", "range_end")), base, size, cap, key)
    fits = archived.filter((F.col("range_start") >= base) & (F.col("range_end") - F.col("range_start") + 1 >= size))
    reuse = fits.groupBy(key).agg(F.min("range_start").alias("range_start")).join(clean.select(key), key, "left_anti")
    reuse = reuse.withColumn("range_end", F.col("range_start") + size - 1)
    return clean.withColumn("needs_approval", F.lit(False)).unionByName(reuse.withColumn("needs_approval", F.lit(True)))


class _Host:
    """The ports of one host: the runs of held ones, sorted and apart, and from where the search for a size goes on, as a place that was too small stays so."""

    def __init__(self, cap: int):
        self.starts, self.ends, self.cap, self.at = [], [], cap, {}

    def hold(self, start: int, end: int) -> None:
        start, end = max(start, 0), min(end, self.cap)
        if start > end:
            return
        # the runs that the range overlaps or touches become one with it
        i, j = bisect_left(self.ends, start - 1), bisect_right(self.starts, end + 1)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def first(self, base: int, size: int) -> int | None:
        at = self.at.get((base, size), max(base, 1))
        i, n = bisect_left(self.ends, at), len(self.ends)
        while i < n and self.starts[i] < at + size:
            at = self.ends[i] + 1
            i += 1
        self.at[base, size] = at
        return at if at + size - 1 <= self.cap else None


def allocate(occupied: DataFrame, requests: DataFrame, cap: int = 65535, key: str = "host") -> DataFrame:
    """(key, seq, range_start, range_end) of each request (key, seq, base, size), as if one after the other took the first free range at or above its base; null where there is none.

    Requests of a host go in the order of seq, then base and size, past occupied ranges (key, range_start, range_end) and what earlier ones got. Rows are sorted by host and stream through their
    task, which holds the runs of held ports of one host at a time and no rows, however many a host has; a request costs a search among the runs. A request with a null or a size below 1 gets none.
    """
    ship(requests.sparkSession)
    told = occupied.select(key, F.lit(0).alias("_lk_kind"), F.lit(None).cast("long").alias("seq"), F.col("range_start").cast("long").alias("_lk_a"), F.col("range_end").cast("long").alias("_lk_b"))
    asked = requests.select(key, F.lit(1).alias("_lk_kind"), F.col("seq").cast("long").alias("seq"), F.col("base").cast("long").alias("_lk_a"), F.col("size").cast("long").alias("_lk_b"))
    schema = T.StructType([requests.schema[key], T.StructField("seq", T.LongType()), T.StructField("range_start", T.IntegerType()), T.StructField("range_end", T.IntegerType())])

    def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, ports = object(), _Host(cap)
        for batch in batches:
            keys, seqs, starts, asks = batch.column(0).to_pylist(), [], [], []
            for i, (k, kind, seq, a, b) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                if k != host:
                    host, ports = k, _Host(cap)
                if kind == 0:
                    if a is not None and b is not None:
                        ports.hold(a, b)
                    continue
                at = ports.first(a, b) if a is not None and b is not None and b >= 1 else None
                if at is not None:
                    ports.hold(at, at + b - 1)
                asks.append(i)
                seqs.append(seq)
                starts.append((at, at + b - 1) if at is not None else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(asks, pa.int64())), pa.array(seqs, pa.int64()), pa.array([s for s, _ in starts], pa.int32()), pa.array([e for _, e in starts], pa.int32())], schema.names)

    rows = told.unionByName(asked).repartition(key).sortWithinPartitions(key, "_lk_kind", "seq", "_lk_a", "_lk_b")
    return rows.mapInArrow(served, schema)


def reclaim(assignments: DataFrame, host: str, start: int, end: int, project_id: str, as_of: Column) -> DataFrame:
    """Assignments after the exact range changes hands: holders are archived, the latest purpose goes to the new owner."""
    exact = (F.col("host") == host) & (F.col("range_start") == start) & (F.col("range_end") == end)
    kept = assignments.withColumn("archived_at", F.when(exact & F.col("archived_at").isNull(), as_of).otherwise(F.col("archived_at")))
    purpose = assignments.filter(exact).agg(F.coalesce(F.max_by("purpose", "assigned_at"), F.lit("claimed")).alias("purpose"))
    new = purpose.select(F.lit(project_id).alias("project_id"), F.lit(host).alias("host"), "purpose", F.lit(start).alias("range_start"), F.lit(end).alias("range_end"), as_of.alias("assigned_at"), F.lit(None).cast("timestamp").alias("archived_at"))
    return kept.unionByName(new, allowMissingColumns=True)
