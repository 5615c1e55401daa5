"""Line deduplication by content-defined chunks of lines. DataFrame functions only.

A rolling hash of the hashes of WINDOW lines, modulo DIVISOR, decides after which lines a chunk ends, so boundaries depend on
the lines near them and survive insertions elsewhere. A chunk of two or more lines that the corpus has elsewhere
too is removed, but for its first occurrence (least id, then text, then place). The chunks' hashes only find candidates: those that
occur more than once are compared by their bytes, so chunks that merely share a hash stay.

Chunks are found inside each row, without a shuffle; what is shuffled are chunk hashes, and the bytes of chunks that
pass a fixed-size filter of the repeated hashes. Counts are aggregated before the shuffle, so a line that a third of all documents have costs one row a task.

Cut points depend on the text, so chunks miss most passages that lie inside otherwise different documents. remove_repeated_runs takes what the chunks
find, and then has every two neighbouring lines as a piece for what they miss: each run of two or more lines that the corpus has elsewhere goes, but for its first
occurrence. It is the same way from hashes to bytes, with pieces that overlap.

Defined results: a null text stays null, an empty one empty; rows with equal id and text are one row's worth: they keep and lose the same
chunks; null ids order first; a document whose chunks are all removed has an empty text; an empty table gives an empty result. All other columns are
passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import bitmap, free_name, passing, unpacked
from larkspur.session import cut

#: Lines that decide on a boundary, one in how many lines ends a chunk, and lines of a chunk that may be removed.
WINDOW, DIVISOR, LEAST_LINES = 2, 4, 2


def _line_hash(line: Column) -> Column:
    """28 bits of the line's MD5, which any SQL system can compute."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunked_lines(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """(id, key, chunk, first_line, n_lines, body): the chunks of every distinct (id, text); key is the text's MD5."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = rows.select("id", F.md5(F.col("text").cast("binary")).alias("key"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.withColumn("hashes", F.transform("lines", _line_hash))
    last = F.size("lines") - 1

    def at(i: Column) -> Column:
        return F.when(i >= 0, F.get("hashes", i)).otherwise(0)

    def rolled(i: Column) -> Column:
        out = at(i - (window - 1))
        for k in range(window - 2, -1, -1):
            out = out * 31 + at(i - k)
        return out

    rows = rows.withColumn("ends", F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolled(i) % divisor == 0)))
    spans = F.transform("ends", lambda e, k: F.struct(k.alias("chunk"), F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1).alias("first_line"), e.alias("last_line")))
    out = rows.select("id", "key", "lines", F.explode(spans).alias("s"))
    n = F.col("s.last_line") - F.col("s.first_line") + 1
    return out.select("id", "key", F.col("s.chunk").alias("chunk"), F.col("s.first_line").alias("first_line"), n.alias("n_lines"), F.array_join(F.slice("lines", F.col("s.first_line") + 1, n), "\n").alias("body"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST_LINES) -> DataFrame:
    """(id, key, first_line, n_lines) of the chunks that go: all occurrences but the first of each repeated chunk.

    Rows that repeat give their chunks again.
    """
    chunks = chunked_lines(docs, id_col, text_col, window, divisor).filter(F.col("n_lines") >= least)
    return _repeated(chunks, "chunk").select("id", "key", "first_line", "n_lines")


def line_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, first_line, body): every two neighbouring lines of every (id, text); key is the text's MD5."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = rows.select("id", F.md5(F.col("text").cast("binary")).alias("key"), F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") > 1)
    pair = lambda i: F.struct(i.alias("first_line"), F.concat_ws("\n", F.get("lines", i), F.get("lines", i + 1)).alias("body"))
    return rows.select("id", "key", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - 2), pair)).alias("p")).select("id", "key", "p.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, spans) of the texts that lose lines; spans (first_line, n_lines) are sorted and apart.

    A line goes if it lies in a repeated chunk, or in a pair of lines that is not the pair's first occurrence and doesn't overlap that.
    """
    chunks = repeated_chunks(docs, id_col, text_col).select("id", "key", F.explode(F.sequence("first_line", F.col("first_line") + F.col("n_lines") - 2)).alias("first_line"))
    gone = _repeated(line_pairs(docs, id_col, text_col), "first_line")
    same = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("key") == F.col("kept.key"))
    pairs = gone.filter(~(same & (F.col("first_line") == F.col("kept.first_line") + 1))).select("id", "key", "first_line")
    gone = cut(chunks.unionByName(pairs), "gone")
    starts = gone.groupBy("id", "key").agg(F.array_sort(F.collect_set("first_line")).alias("starts"))
    at = lambda i: F.get("starts", i)
    last = F.size("starts") - 1
    first = F.filter("starts", lambda x, i: (i == 0) | (x - at(i - 1) > 1))
    final = F.filter("starts", lambda x, i: (i == last) | (at(i + 1) - x > 1))
    spans = F.zip_with(first, final, lambda a, b: F.struct(a.alias("first_line"), (b - a + 2).alias("n_lines")))
    return starts.select("id", "key", spans.alias("spans"))


def _repeated(pieces: DataFrame, order: str) -> DataFrame:
    """The pieces (id, key, body, and others) whose body occurs at an earlier place (id, key, order), with that as kept.

    Nothing is grouped after the join, so a piece that very many documents have is split over tasks.
    """
    hashed = pieces.withColumn("hash", F.xxhash64("body"))
    more = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a bitmap of the repeated hashes spares other pieces the shuffle of their bytes
    found = passing(hashed, "hash", bitmap(more, "hash"))
    found = cut(found, "chunks")
    place = F.struct("id", "key", order)
    firsts = found.groupBy("hash", "body").agg(F.min(place).alias("kept"), F.max(place).alias("end")).filter("kept <> end or not (kept <=> end)")
    # a table, so that both sides of the join are dealt anew and a hot piece's rows can be split
    firsts = cut(firsts.select(F.col("hash").alias("_lk_hash"), F.col("body").alias("_lk_body"), "kept"), "firsts")
    return found.join(firsts, (F.col("hash") == F.col("_lk_hash")) & (F.col("body") == F.col("_lk_body"))).filter(~place.eqNullSafe(F.col("kept")))


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST_LINES) -> DataFrame:
    """docs with the repeated chunks' lines taken out of the text, and as last column lines_removed (see free_name)."""
    gone = cut(repeated_chunks(docs, id_col, text_col, window, divisor, least), "gone")
    spans = gone.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("first_line", "n_lines"))).alias("spans"))
    return _without(docs, spans, id_col, text_col)


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines of repeated runs of two or more lines, and as last column lines_removed (see free_name)."""
    return _without(docs, repeated_runs(docs, id_col, text_col), id_col, text_col)


def _without(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = spans.withColumnsRenamed({"id": "other_id", "key": "other_key"})
    text = F.col(text_col).cast("string")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("key"))
    # a merge join at every size: it splits hot keys, and its cost follows the input
    marked = packed.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("other_id")) & (F.col("key") == F.col("other_key")), "left")
    marked = marked.withColumn("lines", F.when(F.col("spans").isNotNull(), F.split(F.col("row").getField(text_col).cast("string"), "\n", -1)))
    # spans are sorted and apart: keep what lies between one's end and the next one's start
    count = F.size("spans")
    between = F.transform(
        F.sequence(F.lit(0), count),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["first_line"] + F.get("spans", i - 1)["n_lines"]).alias("a"),
            F.when(i == count, F.size("lines")).otherwise(F.get("spans", i)["first_line"]).alias("b"),
        ),
    )
    kept = F.flatten(F.transform(between, lambda s: F.slice("lines", s["a"] + 1, s["b"] - s["a"])))
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["n_lines"]), F.lit(0))
    new = F.when(F.col("spans").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("row").getField(text_col))
    return marked.select(*unpacked("row", docs.columns, **{text_col: new}), removed.alias(free_name("lines_removed", docs.columns)))
