"""Quality rules with an n-gram language model of the corpus itself.

The base rules count words, symbols, repeated lines and repeated 8-word windows. The model is a character 5-gram model
with modified Kneser-Ney smoothing for each language. Batches count their n-grams, Spark adds them up over all documents and derives the lower orders'
continuation counts, discounts and probabilities. Texts are dealt into two folds by a hash, so that equal texts are in one fold, and each is scored by the
model of the other fold: a document's own n-grams don't vouch for it, and what the other fold lacks backs off. Both folds'
counts stand in one table, so Spark works out the value of each n-gram that a fold has under the other fold's model, back-off included,
and only these values go to the workers: sorted 64-bit hashes of the n-grams of each language with two values
beside them. Within a language the hash is a bijection of the packed n-gram, so no two n-grams share a value. SLICE n-grams at most
(about 130 MB) are sent at a time; a corpus that has more is read again for each further slice, and the slices' shares, one number a distinct text, are added up.

The model's vocabulary is closed: letters, digits, marks and white space, and of all other characters those that at least COMMON of all documents with a text have. Other characters are unknown: an
n-gram neither ends with one nor reaches across one, so signs that a few documents are full of can't make each other likely, and
each costs what the model leaves for a symbol that it has never seen. The digits 0 to 9 are one character. A known character is one symbol, or two from U+0600 on, so that five symbols fit 60 bits and no two others
are one. A document's perplexity is that of its characters, known and unknown: the exponential of the mean negative log-probability. As each character counts once, neither the length of words nor the share
of signs is in it but by what the model makes of them. Each language's and fold's band reaches BELOW interquartile ranges of the log-perplexity under the first and
ABOVE over the third quartile of the documents that pass the base rules; both come from a histogram with bins of BIN over all documents.

Defined results: a null or empty text has no words and fails the base rules; a null language is a language of its own; rows with
the same or a null id are judged each; an empty table gives an empty result; all columns are passed on by filter_quality.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import unpacked
from larkspur.llm._words import chunked, hashes_of, mixed, over_chunks, window_hashes, words_of
from larkspur.session import cut

ORDER, BELOW, ABOVE, BIN = 5, 8.0, 6.0, 0.002
#: Share of the documents that must have a sign for it to be in the vocabulary.
COMMON = 0.1
#: N-grams that a worker holds at a time; a corpus with more is read once for each slice.
SLICE = 1 << 23
#: Rows of bands that are broadcast (some MB); more are joined, and adaptive execution splits what is large.
MOST_BANDS = 100_000
REPEAT_WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
_BITS = 12  # of a symbol: 0 stands before a text's first character
#: Code points below PLAIN are one symbol; others are two, of 1088 first and 1024 second ones.
PLAIN = 1536
_PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _xxhash64(x: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of 64-bit numbers, which Spark's xxhash64 computes of a long."""
    p1, p2, p3, p4, p5 = _PRIMES
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.array([seed], np.int64).view(np.uint64) + p5 + np.uint64(8)
        h = turn(h ^ (turn(x * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _is_sign(c: str) -> bool:
    return not c.isspace() and unicodedata.category(c)[0] not in "LNM"


def vocabulary(texts: DataFrame, common: float = COMMON) -> np.ndarray:
    """For each code point whether it is known, from texts (text); bits, packed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, signs = 0, Counter()
        for _, some in chunked(batches, "text"):
            n += len(some) - some.count(b"")
            found: Counter = Counter()
            for t in some:
                found.update(set(t.decode("utf-8", "replace")))
            signs.update({c: k for c, k in found.items() if _is_sign(c)})
        yield pa.RecordBatch.from_arrays([pa.array([-1, *map(ord, signs)], pa.int32()), pa.array([n, *signs.values()], pa.int64())], ["point", "n"])

    counts = texts.mapInArrow(counted, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    n = counts.filter("point < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = [r["point"] for r in counts.filter((F.col("point") >= 0) & (F.col("n") >= common * n)).collect()]  # 1 / common times the signs of a document, on average
    out = np.fromiter((not _is_sign(chr(c)) for c in range(0x110000)), bool, 0x110000)
    out[known] = True
    return np.packbits(out)


def _grams(texts: list[bytes], order: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol, packed in 60 bits, and 0 for each unknown character, text after text; of each text how many these are, and its characters."""
    strings = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    del strings
    inside = np.unpackbits(known).view(bool)[points]
    points = np.where((points >= 48) & (points <= 57), np.uint32(48), points)
    # a symbol or two for each known character, one place for an unknown one
    places = np.add(inside & (points >= PLAIN), 1, dtype=np.uint8)
    upto = np.cumsum(places, dtype=np.int64)
    starts = upto - places
    symbols = np.zeros(int(upto[-1]) if len(upto) else 0, np.uint16)
    wide = places == 2
    symbols[starts] = np.where(wide, np.uint32(PLAIN + 1) + (points >> np.uint32(10)), np.where(inside, points + np.uint32(1), np.uint32(0)))
    symbols[starts[wide] + 1] = np.uint32(PLAIN + 1089) + (points[wide] & np.uint32(1023))
    del points, inside, places, wide
    counts = np.diff(np.append(0, upto)[np.cumsum(np.append(0, sizes))])
    # what an n-gram may reach back to: its text, from the last unknown character on
    at = np.arange(len(symbols), dtype=np.int64)
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    reach = np.maximum(begin, np.maximum.accumulate(np.where(symbols == 0, at + 1, 0))) if len(at) else at
    back = (at - reach).astype(np.int32)
    del begin, reach, at
    packed = symbols.astype(np.uint64)
    for k in range(1, order):
        earlier = np.zeros(len(symbols), np.uint64)
        earlier[k:] = symbols[:-k] if k < len(symbols) else 0
        packed |= np.where(back >= k, earlier, np.uint64(0)) << np.uint64(_BITS * k)
    packed[symbols == 0] = 0
    return packed, counts, sizes


def _lang(lang_col: str) -> Column:
    """The language with a mark before it; '' stands for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def count_ngrams(docs: DataFrame, text_col: str, lang_col: str, known: np.ndarray, order: int = ORDER) -> DataFrame:
    """(lang, gram, n0, n1) over all known characters of all texts: how often each fold has it."""

    def counted(batch: pa.RecordBatch, texts: list[bytes]) -> list[pa.RecordBatch]:
        langs, folds, out = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), []
        for lang in sorted(set(langs)):
            own = np.flatnonzero(langs == lang)
            grams, counts, _ = _grams([texts[i] for i in own], order, known)
            second = (np.repeat(folds[own], counts) == 1)[grams > 0]
            codes, distinct = pd.factorize(grams[grams > 0])
            n = [np.bincount(codes[x], minlength=len(distinct)).astype(np.int64) for x in (~second, second)]
            out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct.view(np.int64)), *map(pa.array, n)], ["lang", "gram", "n0", "n1"]))
        return out

    text = F.col(text_col).cast("string")
    texts = docs.select(_lang(lang_col).alias("lang"), _fold(text).alias("fold"), text.alias("text"))
    return texts.mapInArrow(lambda batches: over_chunks(batches, "text", counted), "lang string, gram long, n0 long, n1 long").groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, p0, p1): the probability of each n-gram's last symbol after the others under either fold's interpolated model.

    The gram 0 has the probability of a symbol that the model has never seen: a share of what all unigrams lost.
    """
    folds = (0, 1)
    tables = {order: cut(counts, "ngrams")}
    for k in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << _BITS * k) - 1)
        tables[k] = cut(tables[k + 1].groupBy("lang", shorter.alias("gram")).agg(*[F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in folds]), f"ngrams-{k}")
    levels = [t.groupBy("lang").agg(*[F.count_if(F.col(f"n{f}") == c).alias(f"n{f}_{c}") for f in folds for c in range(1, 5)], F.count(F.lit(1)).alias("distinct")).withColumn("k", F.lit(k)) for k, t in tables.items()]
    stats = levels[0]
    for more in levels[1:]:
        stats = stats.unionByName(more)
    for f in folds:
        y = F.expr(f"try_divide(n{f}_1, n{f}_1 + 2 * n{f}_2)")
        for c in (1, 2, 3):
            found = c - (c + 1) * y * F.expr(f"try_divide(n{f}_{c + 1}, n{f}_{c})")
            stats = stats.withColumn(f"d{f}_{c}", F.greatest(F.lit(0.05), F.least(F.coalesce(found, F.lit(c / 2)), F.lit(c - 0.05))))
    stats = cut(stats.select("lang", "k", "distinct", *[f"d{f}_{c}" for f in folds for c in (1, 2, 3)]), "discounts")
    lower = None
    for k in range(1, order + 1):
        t = tables[k].join(stats.filter(F.col("k") == k), "lang").withColumn("context", F.shiftright("gram", _BITS))
        for f in folds:
            n = F.col(f"n{f}")
            cut_off = F.when(n == 1, F.col(f"d{f}_1")).when(n == 2, F.col(f"d{f}_2")).otherwise(F.col(f"d{f}_3"))
            t = t.withColumn(f"off{f}", F.least(cut_off, n.cast("double")))
        sums = [x for f in folds for x in (F.sum(f"n{f}").alias(f"all{f}"), F.sum(f"off{f}").alias(f"lost{f}"))]
        contexts = t.groupBy("lang", "context").agg(*sums)
        grams = t.select("lang", "gram", "context", "distinct", "n0", "n1", "off0", "off1").join(contexts, ["lang", "context"])
        if lower is None:
            # of the context of no symbols; a fold without any symbol gives every symbol the same
            unseen = contexts.join(stats.filter(F.col("k") == 1).select("lang", "distinct"), "lang").select("lang", F.lit(0).cast("long").alias("gram"), *[F.coalesce(F.expr(f"try_divide(lost{f}, all{f})"), F.lit(1.0)).alias(f"share{f}") for f in folds], "distinct")
            unseen = unseen.select("lang", "gram", *[(F.col(f"share{f}") / (F.col("distinct") + 1)).alias(f"p{f}") for f in folds])
            grams = grams.select("*", *[(1.0 / (F.col("distinct") + 1)).alias(f"below{f}") for f in folds])
        else:
            shorter = F.col("gram").bitwiseAND((1 << _BITS * (k - 1)) - 1)
            below = lower.select("lang", F.col("gram").alias("shorter"), *[F.col(f"p{f}").alias(f"below{f}") for f in folds])
            grams = grams.withColumn("shorter", shorter).join(below, ["lang", "shorter"])
        # a context that the fold lacks backs off
        p = [F.when(F.col(f"all{f}") > 0, (F.col(f"n{f}") - F.col(f"off{f}") + F.col(f"lost{f}") * F.col(f"below{f}")) / F.col(f"all{f}")).otherwise(F.col(f"below{f}")).alias(f"p{f}") for f in folds]
        values = grams.select("lang", "gram", *p)
        lower = cut(values.unionByName(unseen) if k == order else values, f"model-{k}")
    return lower


def model_slice(model: DataFrame, part: int, parts: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each language the sorted hashes of the n-grams whose hash is part modulo parts, a power of two, and their log-probabilities.

    A row of values: for texts of fold 0 (by the model of fold 1), and for texts of fold 1.
    """
    whole = F.col("gram").bitwiseOR(F.lit(ORDER << 60))
    keyed = model.select("lang", F.xxhash64("lang", whole).alias("key"), F.log("p1").cast("float").alias("of0"), F.log("p0").cast("float").alias("of1"))
    found = keyed.filter(F.col("key").bitwiseAND(F.lit(parts - 1).cast("long")) == part).toArrow()
    langs = found.column("lang").combine_chunks().dictionary_encode()
    codes, keys = langs.indices.to_numpy(), found.column("key").to_numpy().view(np.uint64)
    values = np.stack([found.column(c).to_numpy() for c in ("of0", "of1")], 1)
    out = {}
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        own = np.flatnonzero(codes == code)
        own = own[np.argsort(keys[own])]
        out[lang] = keys[own], values[own]
    return out


def _nll(texts: list[bytes], langs: np.ndarray, folds: np.ndarray, seeds: np.ndarray, arrays: dict, known: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Nats a character of the n-grams of each whole text that the slice has; 0 for an empty text, and for a language without any known character."""
    out = np.zeros(len(texts))
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        grams, counts, sizes = _grams([texts[i] for i in own], ORDER, known)
        if len(grams) and lang in arrays:
            codes, distinct = pd.factorize(grams)
            del grams
            hashes = _xxhash64(distinct | np.uint64(ORDER << 60), int(seeds[own[0]]))
            mine = np.flatnonzero(hashes & np.uint64(parts - 1) == np.uint64(part))
            values = np.zeros((len(distinct), 2))
            if len(mine):
                keys, logp = arrays[lang]
                values[mine] = logp[np.searchsorted(keys, hashes[mine])]
            sums = np.concatenate([[0.0], np.cumsum(values[codes, np.repeat(folds[own], counts)])])
            ends = np.cumsum(counts)
            out[own] = (sums[ends - counts] - sums[ends]) / np.maximum(sizes, 1)
    return out


def _base(texts: list[bytes]) -> dict[str, np.ndarray]:
    w, k = words_of(texts), REPEAT_WINDOW
    repeated = np.zeros(len(texts), np.int64)
    n = len(w.ids)
    if n >= k:
        owners = w.owners
        at = np.flatnonzero(owners[: n - k + 1] == owners[k - 1 :])
        with np.errstate(over="ignore"):
            keys = mixed(window_hashes(hashes_of(w.distinct)[w.ids], k)[at] ^ mixed(owners[at].astype(np.uint64) + np.uint64(1)))
        codes, distinct = pd.factorize(keys)
        again = at[np.bincount(codes, minlength=len(distinct))[codes] > 1]
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, again, 1)
        np.add.at(steps, again + k, -1)
        repeated = np.bincount(owners, np.cumsum(steps)[:-1] > 0, minlength=len(texts)).astype(np.int64)
    chars, symbols, lines = (np.zeros(len(texts), np.int64) for _ in range(3))
    for i, t in enumerate(texts):
        chars[i] = len(t.translate(None, _SPACE).decode("utf-8", "replace"))
        symbols[i] = len(t) - len(t.translate(None, _SYMBOLS))
        full = [x for x in t.split(b"\n") if x.strip()]
        lines[i] = len(full) - len(set(full))
    failed = (w.counts < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * w.counts)
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated, "base_failed": failed}


_ADDED = T.StructType([T.StructField(f"_lq_{n}", T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("_lq_base_failed", T.BooleanType()), T.StructField("_lq_nll", T.DoubleType())])


def _scored(docs: DataFrame, text_col: str, lang_col: str, carried: Column) -> DataFrame:
    """(row, _lq_lang, _lq_fold and the columns of _ADDED) as a table; row: what is carried of docs."""
    text = F.col(text_col).cast("string")
    known = vocabulary(docs.select(text.alias("text")))
    model = kneser_ney(count_ngrams(docs, text_col, lang_col, known))
    n, parts = model.count(), 1
    while parts * SLICE < n:
        parts *= 2
    fields = [_lang(lang_col).alias("_lq_lang"), _fold(text).alias("_lq_fold"), F.xxhash64(_lang(lang_col)).alias("_lq_seed"), text.alias("_lq_text")]
    given = docs.select(carried.alias("row"), *fields)
    if parts == 1:
        return _with_nats(given, model, known, "row", 0, 1)
    # one row for each distinct text of a language and slice: its share; the texts themselves aren't written
    key = F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("_lq_key")
    shares = None
    for part in range(parts):
        found = _with_nats(docs.select(key, *fields), model, known, "_lq_key", part, parts).groupBy("_lq_lang", "_lq_key").agg(F.max("_lq_nll").alias("share"))
        shares = found if shares is None else shares.unionByName(found)
    sums = shares.groupBy("_lq_lang", "_lq_key").agg(F.sum("share").alias("_lq_nll")).select(F.col("_lq_lang").alias("_lq_l"), F.col("_lq_key").alias("_lq_k"), "_lq_nll")
    keyed = given.withColumn("_lq_key", F.md5(F.coalesce("_lq_text", F.lit("")).cast("binary")))
    schema = T.StructType([keyed.schema[n] for n in ("row", "_lq_lang", "_lq_fold", "_lq_key")] + _ADDED.fields[:-1])

    def counted(batch: pa.RecordBatch, texts: list[bytes]) -> list[pa.RecordBatch]:
        own = [batch.column(batch.schema.get_field_index(n)) for n in ("row", "_lq_lang", "_lq_fold", "_lq_key")]
        return [pa.RecordBatch.from_arrays([*own, *map(pa.array, _base(texts).values())], schema.names)]

    based = keyed.mapInArrow(lambda batches: over_chunks(batches, "_lq_text", counted), schema)
    return cut(based.join(sums, (F.col("_lq_lang") == F.col("_lq_l")) & (F.col("_lq_key") == F.col("_lq_k"))).drop("_lq_l", "_lq_k", "_lq_key"), "quality")


def _with_nats(given: DataFrame, model: DataFrame, known: np.ndarray, carried: str, part: int, parts: int) -> DataFrame:
    """The carried column, _lq_lang, _lq_fold and the slice's share as _lq_nll, as a table; where there is one slice only also the other columns of _ADDED."""
    arrays = given.sparkSession.sparkContext.broadcast(model_slice(model, part, parts))
    kept, added = [carried, "_lq_lang", "_lq_fold"], _ADDED.fields if parts == 1 else _ADDED.fields[-1:]
    schema = T.StructType([given.schema[n] for n in kept] + added)

    def scored(batch: pa.RecordBatch, texts: list[bytes]) -> list[pa.RecordBatch]:
        column = lambda n: batch.column(batch.schema.get_field_index(n))
        langs = np.array(column("_lq_lang").to_pylist(), object)
        found = [_nll(texts, langs, column("_lq_fold").to_numpy(), column("_lq_seed").to_numpy(), arrays.value, known, part, parts)]
        if parts == 1:
            found = [*_base(texts).values(), *found]
        return [pa.RecordBatch.from_arrays([column(n) for n in kept] + [pa.array(x) for x in found], schema.names)]

    out = cut(given.mapInArrow(lambda batches: over_chunks(batches, "_lq_text", scored), schema), "quality")
    arrays.destroy()
    return out


def bands(scored: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(lang, fold, low, high): bounds of the log-perplexity."""
    keys = [F.col("_lq_lang").alias("lang"), F.col("_lq_fold").alias("fold")]
    bins = scored.filter("not _lq_base_failed").groupBy(*keys, F.floor(F.col("_lq_nll") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang", "fold")
    share = bins.withColumn("share", F.sum("n").over(by.orderBy("bin")) / F.sum("n").over(by))
    q = share.groupBy("lang", "fold").agg(*[(F.min(F.when(F.col("share") >= x, F.col("bin"))) * BIN).alias(n) for n, x in (("q1", 0.25), ("q3", 0.75))])
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(BIN))
    return q.select("lang", "fold", (F.col("q1") - below * spread).alias("low"), (F.col("q3") + BIN + above * spread).alias("high"))


def _judged(docs: DataFrame, text_col: str, lang_col: str, carried: Column) -> DataFrame:
    scored = _scored(docs, text_col, lang_col, carried)
    limits = cut(bands(scored), "bands").select(F.col("lang").alias("_lq_of"), F.col("fold").alias("_lq_of_fold"), F.col("low").alias("_lq_low"), F.col("high").alias("_lq_high"))
    # two rows a language: sent to the rows where they are few, or the commonest language's texts would meet in one task
    if limits.count() <= MOST_BANDS:
        limits = F.broadcast(limits)
    judged = scored.join(limits, (F.col("_lq_lang") == F.col("_lq_of")) & (F.col("_lq_fold") == F.col("_lq_of_fold")), "left").drop("_lq_of", "_lq_of_fold")
    inside = F.coalesce(F.col("_lq_nll").between(F.col("_lq_low"), F.col("_lq_high")), F.lit(False))
    return judged.withColumn("_lq_kept", ~F.col("_lq_base_failed") & inside)


def assess_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity, low, high, kept)."""
    judged = _judged(docs, text_col, lang_col, F.struct(F.col(id_col).alias("id")))
    counts = [F.col(f.name).alias(f.name.removeprefix("_lq_")) for f in _ADDED.fields[:-1]]
    return judged.select("row.id", *counts, F.exp("_lq_nll").alias("perplexity"), F.exp("_lq_low").alias("low"), F.exp("_lq_high").alias("high"), F.col("_lq_kept").alias("kept"))


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with docs' columns."""
    return _judged(docs, text_col, lang_col, F.struct("*")).filter("_lq_kept").select(*unpacked("row", docs.columns))
