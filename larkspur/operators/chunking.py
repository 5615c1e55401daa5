"""Line-addressed chunks with overlap (N7, X19): a fold over a text's lines, so it runs in one task a text, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import estimate_tokens, stripped


def chunk_bounds(lines: Column, max_chars: int, overlap: int) -> Column:
    """array<struct(a, b)>: first and last line of each chunk, from 0.

    A chunk ends with the line that fills it; the next one starts so far back that its carried lines hold `overlap` characters, at
    least one line. What is left after the last full chunk is a chunk of its own, carried lines included. The fold holds the
    lines of the chunk that is open, each with the characters before it, line ends included.
    """
    kind = "struct<done:array<struct<a:int,b:int>>,open:array<struct<line:int,before:bigint>>,total:bigint,line:int>"
    start = F.struct(F.array().alias("done"), F.array().alias("open"), F.lit(0).alias("total"), F.lit(0).alias("line")).cast(kind)

    def step(acc: Column, size: Column) -> Column:
        held = F.concat(acc["open"], F.array(F.struct(acc["line"].alias("line"), acc["total"].alias("before"))))
        grown = F.struct(acc["done"].alias("done"), held.alias("open"), (acc["total"] + size).alias("total"), (acc["line"] + 1).alias("line"))
        return F.when(acc["total"] + size - F.coalesce(F.get(acc["open"], F.lit(0))["before"], acc["total"]) < max_chars, grown).otherwise(closed(grown)).cast(kind)

    def closed(acc: Column) -> Column:
        done = F.concat(acc["done"], F.array(F.struct(F.get(acc["open"], F.lit(0))["line"].alias("a"), (acc["line"] - 1).alias("b"))))
        carried = F.filter(acc["open"], lambda x, k: (k == F.size(acc["open"]) - 1) | (acc["total"] - F.get(acc["open"], k + 1)["before"] < overlap))
        return F.struct(done.alias("done"), carried.alias("open"), acc["total"].alias("total"), acc["line"].alias("line"))

    last = F.size(lines) - 1
    return F.aggregate(F.transform(lines, lambda x: F.length(x) + 1), start, step, lambda f: F.concat(f["done"], F.array(F.struct(F.get(f["open"], F.lit(0))["line"].alias("a"), last.alias("b")))))


def chunk_lines(docs: DataFrame, id_col: str, text_col: str, max_tokens: int = 400, overlap_tokens: int = 80) -> DataFrame:
    """(id, chunk, content, line_start, line_end, token_count): as line_start and line_end, lines from 0, both included."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = rows.select("id", F.split("text", "\n", -1).alias("lines"))
    rows = rows.withColumn("bounds", chunk_bounds(F.col("lines"), 4 * max_tokens, 4 * overlap_tokens))
    bounds = rows.select("id", "lines", F.posexplode("bounds").alias("chunk", "c"), F.size("bounds").alias("of"))
    content = F.array_join(F.slice("lines", F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + 1), "\n")
    out = bounds.select("id", "chunk", content.alias("content"), F.col("c.a").alias("line_start"), F.col("c.b").alias("line_end"), "of")
    kept = out.filter((F.col("chunk") < F.col("of") - 1) | (stripped(F.col("content")) != ""))
    return kept.select("id", "chunk", "content", "line_start", "line_end", estimate_tokens(F.col("content")).alias("token_count"))
