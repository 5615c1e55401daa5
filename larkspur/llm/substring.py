"""Removal of repeated word windows, counted in super-k-mers.

A window is `window` consecutive words. Its minimiser is the leftmost of its `minimiser`-word sequences with the least
hash; consecutive windows that share the minimiser's place form one super-k-mer, which travels as one packed string
to the bucket of its minimiser. Equal windows have equal minimisers and meet in one bucket, where windows that share a hash are
sorted and counted by their words.

A first pass counts minimisers; one that the corpus has once can't belong to a repeated
window, and a fixed-size bitmap of the others spares the second pass sending
such strings. False positives only send more. Equal strings that meet in one batch are settled
there and one of them travels.

A minimiser that more than HOT_STRINGS strings have is hot: their strings would fill a bucket, and though the windows of a common passage are equal, the strings
are not, as each has its own text's words at its ends. Which minimisers are hot is read from a fixed-size table of SLOT_BITS bits of their hash. The strings of
hot ones stay where they were written, and their windows are counted there, by hash first: each batch sends a window's hash (128 bits) once, with how often it has it, and Spark adds these up before
and after the shuffle. Then the strings' batches send the words of the windows whose hash is repeated, for which a fixed-size bitmap stands in, again once a batch, and
a window is repeated where all words of its hash are equal and were counted twice or more. (Hashes with several words are counted by words in one more
pass over the strings, which hardly any corpus needs.) Places of such windows meet these counts by hash, one row for all places that AT_ONCE windows have; the rows of a hash that many texts have are dealt into parts, as
many as it takes for HOT_STRINGS places each. So no bucket, group or join key grows with the copies of a passage.

Defined results: a null or empty text has no words; fewer words than a window are all kept; repeated rows are documents of their
own, so all windows of both are repeated; ids may be null or repeated, as results are found by text; a text may have any number of words; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import bit_array, bitmap, bucket_count, is_set
from larkspur.llm._words import Words, chunked, hashes_of, mixed, window_hashes, words_of
from larkspur.session import cut

#: Strings in a bucket, on average; strings of a minimiser beyond which it is hot, and places of a window in a part; bits of a hash that find its slot.
BUCKET_STRINGS, HOT_STRINGS, SLOT_BITS = 8_000, 8_000, 20
#: Windows whose words are compared or sent at once.
AT_ONCE = 20_000
#: A chunk is one text or a few million bytes, and a text has less than 2^31 bytes.
_PLACE_BITS = 31


def _super_kmers(texts: list[bytes], window: int, m: int) -> tuple:
    """Words, their offsets, and for each super-k-mer its minimiser, first window and number of windows."""
    w = words_of(texts)
    n, span = len(w.ids), window - m + 1
    if n < window:
        empty = np.empty(0, np.int64)
        return w, empty.astype(np.uint64), empty, empty
    h = window_hashes(hashes_of(w.distinct)[w.ids], m)
    low = (1 << _PLACE_BITS) - 1
    keyed = (mixed(h) & ~np.uint64(low)) | np.arange(len(h), dtype=np.uint64)
    least, width = keyed, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(keyed) - span + 1], least[span - width : len(keyed) - width + 1])
    place = (least & np.uint64(low)).astype(np.int64)
    owners = w.owners
    valid = np.flatnonzero(owners[: n - window + 1] == owners[window - 1 :])
    if not len(valid):
        return w, h[:0], valid, valid
    at = place[valid]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(valid) != 1)]))
    return w, h[at[new]], valid[new], np.diff(np.append(new, len(valid)))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def _slot(column: str) -> Column:
    return F.shiftrightunsigned(column, 64 - SLOT_BITS)


def _slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slots(counts: DataFrame, column: str, n: str) -> DataFrame:
    """(slot, bits) of the slots with a hash that is counted more than HOT_STRINGS times: bits tell as many parts as the commonest needs. 2^SLOT_BITS rows at most."""
    most = counts.filter(F.col(n) > HOT_STRINGS).groupBy(_slot(column).alias("slot")).agg(F.max(n).alias("n"))
    return cut(most.select("slot", F.ceil(F.log2(F.col("n") / HOT_STRINGS)).cast("int").alias("bits")), "slots")


def _slot_array(slots: DataFrame) -> np.ndarray:
    """For each slot its bits and 1 more, or 0 for a slot that isn't there."""
    out, found = np.zeros(1 << SLOT_BITS, np.uint8), slots.toArrow()
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy() + 1
    return out


def _window_hashes(w: Words, window: int, seed: int = 0) -> np.ndarray:
    return mixed(window_hashes(hashes_of(w.distinct, seed)[w.ids], window) + np.uint64(99))


def _repeat_within(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _packed(texts: list[bytes], w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' words with a blank after each, where each word starts in that, and how long it is."""
    joined = b" ".join([x for x in (b" ".join(t.split()) for t in texts) if x])
    sizes = np.fromiter(map(len, w.distinct), np.int64, len(w.distinct))[w.ids]
    return joined, np.cumsum(sizes + 1) - sizes - 1, sizes


_STRINGS = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("at", pa.int64()), ("windows", pa.int64()), ("packed", pa.binary()), ("n", pa.int64())])
_ROWS = "bucket long, key binary, at long, windows long, packed binary, n long"
#: Words of hot windows with how often they are there, and places of hot windows (keys and ats) where n is null.
_WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("packed", pa.binary()), ("n", pa.int64()), ("part", pa.int64()), ("keys", pa.list_(pa.binary())), ("ats", pa.list_(pa.int64()))])
_WINDOW_ROWS = "h1 long, h2 long, packed binary, n long, part long, keys array<binary>, ats array<long>"
#: Buckets of rows that don't travel to one: places that are settled, strings of hot minimisers.
SETTLED, HOT = -1, -2


def _rows(schema: pa.Schema, size: int, **columns: pa.Array | pa.ChunkedArray) -> pa.RecordBatch:
    """A batch with the columns that are given, null in the others."""
    whole = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in columns.items()}
    return pa.RecordBatch.from_arrays([whole[f.name].cast(f.type) if f.name in whole else pa.nulls(size, f.type) for f in schema], schema=schema)


def _windows_of(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some strings: the string, the first word, and the hash in two numbers."""
    n = np.maximum(w.counts - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    place = w.offsets[:-1][row] + _repeat_within(n)
    if not len(place):
        return row, place, place.astype(np.uint64), place.astype(np.uint64)
    return row, place, _window_hashes(w, window)[place], _window_hashes(w, window, 1)[place]


def _distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each pair of numbers, and which one each pair is."""
    both = np.stack([h1, h2], 1).view([("a", np.uint64), ("b", np.uint64)]).reshape(-1)
    _, first, which = np.unique(both, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


def _slices(n: int, most: int) -> Iterator[slice]:
    return (slice(at, min(at + most, n)) for at in range(0, n, most))


def _by_words(w: Words, at: np.ndarray, h1: np.ndarray, h2: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows at some words, each of them n times, one of each hash and words, and how often it is there. (Windows that share a hash with other words are given each.)"""
    one, which = _distinct(h1, h2)
    same, steps = np.ones(len(at), bool), np.arange(window)
    for some in _slices(len(at), AT_ONCE):
        same[some] = (w.ids[at[some][:, None] + steps] == w.ids[at[one][which[some]][:, None] + steps]).all(1)
    odd = np.flatnonzero(~same)
    return np.append(one, odd), np.append(np.bincount(which[same], n[same], minlength=len(one)), n[odd]).astype(np.int64)


def repeated_ranges(docs: DataFrame, text_col: str = "text", window: int = 35, minimiser: int = 8) -> DataFrame:
    """(key, ranges): by the MD5 of a text, the word ranges [from, to) that repeated windows cover; may overlap."""
    spark, texts = docs.sparkSession, _keyed(docs, text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in chunked(batches, "text"):
            keys, n = np.unique(_super_kmers(some, window, minimiser)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["minimiser", "n"])

    counts = texts.select("text").mapInArrow(counted, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter("n > 1"), "minimisers")
    hot_slots = _slot_array(_slots(counts, "minimiser", "n"))
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("n") <= HOT_STRINGS, F.col("n"))), F.lit(0))).first()[0]
    known, buckets = spark.sparkContext.broadcast((bit_array(bitmap(counts, "minimiser")), hot_slots)), bucket_count(total, BUCKET_STRINGS)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hot = known.value
        for batch, some in chunked(batches, "text"):
            w, keys, first, length = _super_kmers(some, window, minimiser)
            stays = is_set(seen, keys)
            keys, first, length = keys[stays], first[stays], length[stays]
            joined, starts, sizes = _packed(some, w)
            last = first + length + window - 2
            ends = starts[last] + sizes[last]
            coded = pa.array([joined[a:b] for a, b in zip(starts[first].tolist(), ends.tolist(), strict=True)], pa.binary()).dictionary_encode()
            codes = coded.indices.to_numpy()
            times = np.bincount(codes, minlength=len(coded.dictionary))
            owner = np.searchsorted(w.offsets, first, "right") - 1
            doc_keys, at = batch.column(0).take(pa.array(owner)), first - w.offsets[owner]
            # places of strings that the batch has several times are settled here
            settled = np.flatnonzero(times[codes] > 1)
            yield _rows(_STRINGS, len(settled), bucket=pa.array(np.full(len(settled), SETTLED)), key=doc_keys.take(pa.array(settled)), at=pa.array(at[settled]), windows=pa.array(length[settled]))
            one = np.sort(np.unique(codes, return_index=True)[1])
            bucket = np.where(hot[_slots_of(keys[one])] > 0, HOT, (mixed(keys[one]) % np.uint64(buckets)).astype(np.int64))
            rows = pa.array(one)
            own = pc.if_else(pa.array(times[codes[one]] > 1), pa.scalar(None, pa.binary()), doc_keys.take(rows))
            yield _rows(_STRINGS, len(one), bucket=pa.array(bucket), key=own, at=pa.array(at[one]), windows=pa.array(length[one]), packed=coded.dictionary.take(coded.indices.take(rows)), n=pa.array(times[codes[one]]))

    strings = cut(texts.mapInArrow(sent, _ROWS), "super-kmers")
    known.destroy()

    def sorted_out(table: pa.Table) -> pa.Table:
        packed, ats = (table.column(c) for c in ("packed", "at"))
        w = words_of(packed.to_pylist())
        starts, n = w.offsets[:-1], w.counts - window + 1
        row = np.repeat(np.arange(len(n)), n)
        place = starts[row] + _repeat_within(n)
        hashes = _window_hashes(w, window)[place]
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = alike = np.flatnonzero(times[which] > 1)
        if len(alike):  # what shares a hash is counted by its words
            spelled = np.ascontiguousarray(w.ids[place[alike][:, None] + np.arange(window)].astype(np.int32))
            _, which, times = np.unique(spelled.view(np.dtype((np.void, 4 * window))).reshape(-1), return_inverse=True, return_counts=True)
            known = np.array(table.column("key").is_valid())
            hit = alike[(times[which] > 1) & known[row[alike]]]
        cut_at = np.flatnonzero(np.append(True, (np.diff(row[hit]) != 0) | (np.diff(place[hit]) != 1))) if len(hit) else hit
        firsts, lasts = hit[cut_at], hit[np.append(cut_at[1:], len(hit)) - 1] if len(hit) else hit
        base = ats.to_numpy()[row] - starts[row] + place
        return pa.table({"key": table.column("key").take(pa.array(row[firsts])), "from": base[firsts], "to": base[lasts] + window})

    ranges = strings.filter(F.col("bucket") == SETTLED).select("key", F.col("at").alias("from"), (F.col("at") + F.col("windows") + window - 1).alias("to"))
    travelled = strings.filter("bucket >= 0").select("bucket", "key", "at", "packed")
    ranges = ranges.unionByName(travelled.groupBy("bucket").applyInArrow(sorted_out, "key binary, from long, to long"))
    if hot_slots.any():
        ranges = ranges.unionByName(_hot_ranges(strings.filter(F.col("bucket") == HOT).select("key", "at", "packed", "n"), window))
    return ranges.distinct().groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))


def _hot_ranges(strings: DataFrame, window: int) -> DataFrame:
    """(key, from, to) of the repeated windows of strings (key, at, packed, n); a string without a key counts n times and has no place."""
    spark = strings.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in chunked(batches, "packed"):
            row, _, h1, h2 = _windows_of(words_of(some), window)
            one, which = _distinct(h1, h2)
            n = np.bincount(which, batch.column(3).to_numpy()[row], minlength=len(one)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h1[one].view(np.int64)), pa.array(h2[one].view(np.int64)), pa.array(n)], ["h1", "h2", "n"])

    hashes = strings.mapInArrow(hashed, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1")
    hashes = cut(hashes, "hot-hashes")
    slots = _slots(hashes, "h1", "n")

    def looked_up(filter_of: DataFrame, words: bool) -> DataFrame:
        """The words of each window whose hash passes a bitmap, once a batch with how often it has them, and its places; words: with the words beside the places."""
        known = spark.sparkContext.broadcast((bit_array(bitmap(filter_of, "h1")), _slot_array(slots)))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, parts = known.value
            for batch, some in chunked(batches, "packed"):
                w = words_of(some)
                row, at, h1, h2 = _windows_of(w, window)
                stays = is_set(seen, h1)
                row, at, h1, h2 = row[stays], at[stays], h1[stays], h2[stays]
                joined, starts, sizes = _packed(some, w)
                signed = lambda h: pa.array(h.view(np.int64))

                def spelled(at: np.ndarray) -> pa.Array:
                    ends = at + window - 1
                    return pa.array([joined[a:b] for a, b in zip(starts[at].tolist(), (starts[ends] + sizes[ends]).tolist(), strict=True)], pa.binary())  # noqa: B023

                one, n = _by_words(w, at, h1, h2, batch.column(3).to_numpy()[row], window)
                for x in _slices(len(one), AT_ONCE):
                    yield _rows(_WINDOWS, len(one[x]), h1=signed(h1[one[x]]), h2=signed(h2[one[x]]), packed=spelled(at[one[x]]), n=pa.array(n[x]))
                own = np.flatnonzero(np.array(batch.column(0).is_valid())[row])
                for x in (own[x] for x in _slices(len(own), AT_ONCE)):
                    places = pa.table({"h1": signed(h1[x]), "h2": signed(h2[x]), "keys": batch.column(0).take(pa.array(row[x])), "ats": batch.column(1).to_numpy()[row[x]] + at[x] - w.offsets[row[x]]})
                    by = ["h1", "h2"]
                    if words:
                        places, by = places.append_column("packed", spelled(at[x])), [*by, "packed"]
                    groups = places.group_by(by).aggregate([("keys", "list"), ("ats", "list")])
                    # any of the parts that the hash's slot has, by the first place's text
                    seed = np.frombuffer(batch.column(0)[int(row[x[0]])].as_py()[:8], np.uint64) + np.uint64(at[x[0]])
                    bits = np.maximum(parts[_slots_of(groups.column("h1").to_numpy().view(np.uint64))], 1).astype(np.uint64) - np.uint64(1)
                    dealt = mixed(np.arange(len(groups), dtype=np.uint64) + mixed(seed)) & ((np.uint64(1) << bits) - np.uint64(1))
                    yield _rows(_WINDOWS, len(groups), part=pa.array(dealt.astype(np.int64)), keys=groups.column("keys_list"), ats=groups.column("ats_list"), **{c: groups.column(c) for c in by})

        out = cut(strings.mapInArrow(found, _WINDOW_ROWS), "hot-windows")
        known.destroy()
        return out

    rows = looked_up(hashes, False)
    counted = rows.filter("n is not null").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("packed").alias("least"), F.max("packed").alias("most"))
    counted = cut(counted.filter("n > 1"), "hot-counts")
    # a hash that fills several parts is there once for each
    named = slots.select(F.col("slot").alias("of"), "bits")
    repeated = counted.filter("least = most").select("h1", "h2").join(named, _slot("h1") == F.col("of"), "left")
    repeated = repeated.select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, coalesce(bits, 0)) - 1"))).alias("part"))
    hit = rows.filter("n is null").join(repeated, ["h1", "h2", "part"], "left_semi").select("keys", "ats")
    mixed_up = counted.filter("least <> most").select("h1", "h2")
    if not mixed_up.isEmpty():
        spelled = looked_up(mixed_up, True)
        several = spelled.filter("n is not null").groupBy("h1", "h2", "packed").agg(F.sum("n").alias("n")).filter("n > 1").select("h1", "h2", "packed")
        places = spelled.filter("n is null").join(several, ["h1", "h2", "packed"], "left_semi").join(mixed_up, ["h1", "h2"], "left_semi")
        hit = hit.unionByName(places.select("keys", "ats"))
    each = hit.select(F.explode(F.arrays_zip("keys", "ats")).alias("place"))
    return each.select(F.col("place.keys").alias("key"), F.col("place.ats").alias("from"), (F.col("place.ats") + window).alias("to"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, minimiser: int = 8) -> DataFrame:
    """(id, n_words, n_removed, kept): kept has the words that no repeated window covers, joined by one space."""
    ranges = cut(repeated_ranges(docs, text_col, window, minimiser), "ranges").withColumnRenamed("key", "_lk_key")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    joined = rows.join(ranges, F.col("key") == F.col("_lk_key"), "left").select("id", "text", "ranges")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def taken_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in chunked(batches, "text"):
            n, removed, kept = [], [], []
            for t, found in zip(some, batch.column(2).to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if found:
                    steps = np.zeros(len(words) + 1, np.int64)
                    for r in found:
                        steps[r["from"]] += 1
                        steps[r["to"]] -= 1
                    stays = np.cumsum(steps)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    return joined.mapInArrow(taken_out, schema)
