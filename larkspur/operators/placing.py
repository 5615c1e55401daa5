"""Places of rows in a sorted order, without one task for a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut

#: Rows of a part, on average.
PART_ROWS = 200_000


def sorted_parts(df: DataFrame, order: list[str], part: str, rows: int = PART_ROWS) -> DataFrame:
    """df as a table with part: parts follow each other in the order of the columns `order`, and hold about `rows` rows each.

    Equal places in the order fall into one part.
    """
    parts = max(1, -(-df.count() // rows))
    return cut(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "sorted")


def placed(df: DataFrame, key: str, order: list[str], at: str, rows: int = PART_ROWS) -> DataFrame:
    """df with at: the place of each row among those of its key, from 0, in the order of the columns `order`.

    Rows are sorted by range over all keys, so a large key lies in many parts. A window numbers the rows of a key in a part; how many
    the parts before have is added up from one row a key and part.
    """
    parts = sorted_parts(df, [key, *order], "_lk_part", rows)
    counts = parts.groupBy(key, "_lk_part").agg(F.count(F.lit(1)).alias("_lk_n"))
    before = F.coalesce(F.sum("_lk_n").over(Window.partitionBy(key).orderBy("_lk_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("_lk_key"), F.col("_lk_part").alias("_lk_of"), before.alias("_lk_start"))
    inside = F.row_number().over(Window.partitionBy(key, "_lk_part").orderBy(*order)) - 1
    out = parts.withColumn("_lk_row", inside).join(starts, F.col(key).eqNullSafe(F.col("_lk_key")) & (F.col("_lk_part") == F.col("_lk_of")))
    return out.withColumn(at, F.col("_lk_row") + F.col("_lk_start")).select(*df.columns, at)
