"""Ranked lexical search by scanning whole documents with an Aho-Corasick automaton of all items' terms.

Every term stands in the automaton between two blanks, and a text is scanned with its ASCII separators turned into blanks, so that
only whole terms match. The automaton reads bytes: a text is folded and scanned as UTF-8, a byte a symbol, and what it puts out is
a term's number with its place, from which tf is counted; a table from terms to items (with repeats) turns tf into scores. No index of the documents is made: one
scan counts df, N and L, a second one scores, and each task keeps the k best documents of each item only. Tasks' lists meet in two steps, dealt
by documents first.

Items are gone through in blocks of about BLOCK_TERMS terms, which bounds the automaton that travels; each block scans the documents anew. A block's
documents are scored in slices of at most SLICE cells, in 64-bit integers (in doubles where every sum is below EXACT, which is the same).

Defined results: terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, of which only A-Z are lower-cased; a null or empty
text has none; an item without terms, or whose terms no document has, has no rows; rows of one item id (null is one, too) are one item with the terms of all its distinct
texts; rows that repeat, or whose id is null or repeats, are documents each; of equal scores the smaller id is first, null last; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import bucket_count, prefix_sums
from larkspur.llm._words import chunked
from larkspur.session import cut

#: Rows (item, term) of a block of items, cells that are scored at once, candidates that a task holds before it sorts them.
BLOCK_TERMS, SLICE, HELD = 100_000, 2_000_000, 400_000
#: Whole numbers below this add up exactly in doubles; larger scores are added in integers.
EXACT = 1 << 53
#: Parts that an item's candidates are ranked in before they meet.
PARTS = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text as the automaton reads them: A-Z lower-cased, ASCII separators as blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """The terms of a text, in its order; none of a null."""
    return F.regexp_extract_all(F.coalesce(F.translate(text.cast("string"), _UPPER, _LOWER), F.lit("")), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, repeats)."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    return rows.select("item", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats"))


@dataclass
class Block:
    """A block of items: its terms as UTF-8 and, from a term's number, the items that have it, with repeats."""

    items: pa.Array
    terms: list[bytes]
    starts: np.ndarray
    item: np.ndarray
    repeats: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Block:
        items, terms = (rows.column(c).combine_chunks().dictionary_encode("encode") for c in ("item", "term"))
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        starts = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
        return Block(items.dictionary, [t.encode() for t in terms.dictionary.to_pylist()], starts, items.indices.to_numpy()[order].astype(np.int64), rows.column("repeats").to_numpy()[order])

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            out.add_word(f" {t.decode('latin-1')} ", i)
        out.make_automaton()
        return out


def scan(texts: list[bytes], automaton: ahocorasick.Automaton, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each text has; and (text, term, tf) for each term of the automaton in each text, in that order."""
    whole = (b" " + b" ".join(texts) + b" ").translate(FOLD)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(np.append(0, sizes + 1))  # of the blank before each text
    solid = np.frombuffer(whole, np.uint8) != 32
    n = np.diff(np.searchsorted(np.flatnonzero(solid[1:] & ~solid[:-1]), starts))
    flat = np.fromiter(chain.from_iterable(automaton.iter(whole.decode("latin-1"))), np.int64) if n_terms else np.empty(0, np.int64)
    owner = np.searchsorted(starts, flat[0::2], "left") - 1  # a match ends on the blank after the term
    keys, tf = np.unique(owner * max(n_terms, 1) + flat[1::2], return_counts=True)
    return n, keys // max(n_terms, 1), keys % max(n_terms, 1), tf


def _counts(texts: DataFrame, block: Block) -> tuple[np.ndarray, int, int]:
    """df of each term of the block, N and L."""
    size = len(block.terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, out = block.automaton(), np.zeros(size + 2, np.int64)
        for _, some in chunked(batches, "text"):
            n, _, term, _ = scan(some, automaton, size)
            out[:size] += np.bincount(term, minlength=size)
            out[size:] += [int((n > 0).sum()), int(n.sum())]
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

    found = texts.select("text").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the block
    out = np.zeros(size + 2, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out[:size], int(out[size]), int(out[size + 1])


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms: 100 - 25 + 25 n N / L, rounded down."""
    if not n_terms:
        return np.full(len(n), 75, np.int64)
    if 25 * n_docs * int(n.max(initial=0)) >= 1 << 63:
        return np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 75 + 25 * n * n_docs // n_terms


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The k first rows of each item, by falling score, then id."""
    rows = rows.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])
    item = rows.column("item").to_numpy()
    return rows.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))


def _candidates(texts: DataFrame, block: Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int, schema: T.StructType) -> DataFrame:
    """(item, id, score): each task's k best documents of each item of the block."""
    per_term, n_items = np.diff(block.starts), len(block.items)
    top = np.zeros(n_items)
    np.add.at(top, block.item, block.repeats * np.repeat(weights, per_term) * 1e6)
    exact_doubles = top.max(initial=0) < EXACT

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, floor = block.automaton(), np.ones(n_items, np.int64)
        held: list[pa.Table] = []
        for batch, some in chunked(batches, "text"):
            n, text, term, tf = scan(some, automaton, len(block.terms))
            value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * _lengths(n, n_docs, n_terms)[text]))
            cells = np.cumsum(np.bincount(text, per_term[term], minlength=len(some)) + n_items)
            at = 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + SLICE, "right")))
                lo, hi = np.searchsorted(text, [at, to])
                many = per_term[term[lo:hi]]
                row = np.repeat(np.arange(lo, hi), many)
                place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + block.starts[term[row]]
                cell, part = (text[row] - at) * n_items + block.item[place], value[row] * block.repeats[place]
                if exact_doubles:
                    score = np.bincount(cell, part, minlength=(to - at) * n_items).astype(np.int64)
                else:
                    score = np.zeros((to - at) * n_items, np.int64)
                    np.add.at(score, cell, part)
                score = score.reshape(-1, n_items)
                least = np.maximum(floor, np.partition(score, -k, axis=0)[-k]) if len(score) > k else floor
                doc, item = np.nonzero(score >= least)
                held.append(pa.table({"item": item, "id": batch.column(0).take(pa.array(doc + at)), "score": score[doc, item]}))
                if sum(map(len, held)) > HELD:
                    held = [_best(pa.concat_tables(held), k)]
                    own, score = held[0].column("item").to_numpy(), held[0].column("score").to_numpy()
                    last = np.flatnonzero(np.arange(len(own)) - np.searchsorted(own, own) == k - 1)
                    floor[own[last]] = score[last]
                at = to
        if held:
            best = _best(pa.concat_tables(held), k)
            for some in best.to_batches():
                yield pa.RecordBatch.from_arrays([block.items.take(some.column(0)), some.column(1), some.column(2)], schema.names)

    return texts.mapInArrow(scored, schema)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the k documents of each item with the highest scores above 0; rank from 1."""
    if k < 1:
        raise ValueError("k must be positive")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    terms = cut(item_terms(items, item_col, item_text_col), "item-terms")
    spread = F.pmod(F.xxhash64("item"), F.lit(bucket_count(terms.count(), BLOCK_TERMS)))
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(sizes, [], spread, [F.col("item")], F.col("n"), "before").select(F.col("item").alias("of"), F.expr(f"before div {BLOCK_TERMS}").alias("block"))
    blocks = cut(terms.join(placed, F.col("item").eqNullSafe(F.col("of"))).drop("of"), "item-blocks")
    schema = T.StructType([T.StructField("item", terms.schema["item"].dataType), T.StructField("id", texts.schema["id"].dataType), T.StructField("score", T.LongType())])
    found = docs.sparkSession.createDataFrame([], schema)
    for b in [r[0] for r in blocks.select("block").distinct().orderBy("block").collect()]:  # a number a block
        block = Block.of(blocks.filter(F.col("block") == b).toArrow())  # BLOCK_TERMS rows and the last item's own
        df, n_docs, n_terms = _counts(texts, block)
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        found = found.unionByName(cut(_candidates(texts, block, weights, n_docs, n_terms, k, schema), "candidates"))
    by = [F.desc("score"), F.asc_nulls_last("id")]
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= k)
    return found.select("item", "rank", "id", "score")
