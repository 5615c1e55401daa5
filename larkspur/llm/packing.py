"""Best-fit packing by minimum bin slack.

Texts become token ids and end with one end id. A document longer than a sequence is cut into full pieces and
a rest. What is packed depends on the pieces' lengths only, so bins are found on the histogram of lengths, which has
at most `capacity` entries for any corpus: per bin, the longest piece that is left is put in, and a subset-sum over
bitsets finds the fullest combination of other lengths. The same combination is used as often as the histogram
allows before the next one is sought, so the search doesn't grow with the corpus. Pieces get their places by their
rank among the pieces of equal length, which is computed without a task that holds a whole length.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; an empty table gives an empty
result; columns other than the id and the text are not looked at. Pieces of equal length are ranked in the order of
a hash of (id, piece, start, length, checksum), then of these; pieces that agree in all of them are alike.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import bucket_count, ranked
from larkspur.llm._words import chunked, remembered, words_of
from larkspur.session import cut

#: Words whose ids a worker remembers; the table is emptied when it is full.
REMEMBERED = 700_000
#: Pieces of one length that are ranked by one window.
BUCKET_ROWS = 20_000

#: A character that the tokenizer turns into one id of its own; it stands between words that are encoded together.
BETWEEN = "\x01"

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        specials = [re.escape(a.content.encode()) for a in t.get_added_tokens_decoder().values()]
        mark = t.encode(BETWEEN, add_special_tokens=False).ids
        _tokenizers[path] = t, mark[0] if len(mark) == 1 else None, re.compile(b"|".join([BETWEEN.encode(), *specials]), re.IGNORECASE), {}
        remembered.append(_tokenizers[path][3])
    return _tokenizers[path]


def _ids_of_words(path: str, words: list[bytes]) -> list[bytes]:
    """Little-endian ids of each word. Words that are new are encoded together, with BETWEEN between them.

    What doesn't matter to its ids is left out of a new word first: the case of an ASCII word, and a final dot or comma
    after a letter or digit, which is a token of its own.
    """
    t, mark, specials, known = _tokenizer(path)
    out = [known.get(w) for w in words]
    new = [w for w, ids in zip(words, out, strict=True) if ids is None]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        out, new = [None] * len(words), words
    if not new:
        return out
    odd: list[bytes] = new if mark is None else []
    if mark is not None and specials.search(b" ".join(new)):
        odd = [w for w in new if specials.search(w)]
    for w in odd:
        known[w] = np.array(t.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
    if odd:
        new = [w for w in new if w not in known]
    cores, tails = [], []
    for w in new:
        last = w[-1:]
        core, tail = (w[:-1], last) if (last == b"." or last == b",") and w[-2:-1].isalnum() else (w, b"")
        cores.append(core.lower() if core.isascii() else core)
        tails.append(tail)
    need = {*cores, b".", b","}
    need.difference_update(known)
    tokenize = t.model.tokenize
    for w in [w for w in need if w.isalpha()]:  # ASCII letters only: the model gets such a word as it is
        known[w] = array("I", [x.id for x in tokenize(w.decode())]).tobytes()
    plain = [w for w in need if not w.isalpha()]
    for at in range(0, len(plain), 20_000):
        some = plain[at : at + 20_000]
        text = f" {BETWEEN} ".join([w.decode("utf-8", "replace") for w in some])
        ids = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == mark), len(ids)).tolist()
        start, raw = 0, ids.tobytes()
        for w, end in zip(some, ends, strict=True):
            known[w] = raw[4 * start : 4 * end]
            start = end + 1
    for w, core, tail in zip(new, cores, tails, strict=True):
        if w != core:
            known[w] = known[core] + known[tail] if tail else known[core]
    return [known[w] if ids is None else ids for w, ids in zip(words, out, strict=True)]


def _ids_of_texts(path: str, texts: list[bytes], end_id: int, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """All ids, text after text, each followed by end_id; and where each text ends."""
    end = np.array([end_id], "<u4")
    if by_word:
        w = words_of(texts)
        coded = [*_ids_of_words(path, w.distinct), end.tobytes()]
        lens = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        store = np.frombuffer(b"".join(coded), "<u4")
        starts = np.cumsum(lens) - lens
        which = np.insert(w.ids, w.offsets[1:], len(coded) - 1)
        n = lens[which]
        ends = np.cumsum(n)
        out = store[np.repeat(starts[which] - (ends - n), n) + np.arange(int(n.sum()))]
        return out, ends[w.offsets[1:] + np.arange(len(texts))]
    encoded = _tokenizer(path)[0].encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
    parts = [np.append(np.array(e.ids, "<u4"), end) for e in encoded]
    return np.concatenate(parts) if parts else end[:0], np.cumsum([len(p) for p in parts])


def tokenize_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, by_word: bool = False, with_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, and ids (little-endian, 4 bytes each) if with_ids.

    tokenizer is a file of the tokenizers library that the executors have at the same path. by_word: the tokenizer
    ignores case, drops white space, never joins what stands on its two sides, makes a dot or comma after a letter or
    digit a token of its own, and gives its model a word of ASCII letters as it is, so words can be encoded one by one, which is much faster; else whole texts are.
    """
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches, "text", keep=True):
            ids, ends = _ids_of_texts(tokenizer, texts, end_id, by_word)
            raw = memoryview(np.ascontiguousarray(ids)).cast("B")
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            begin = 0
            for k, end in enumerate(ends.tolist()):
                for p, at in enumerate(range(begin, end, capacity)):
                    to = min(end, at + capacity)
                    owner.append(k)
                    piece.append(p)
                    start.append(at - begin)
                    length.append(to - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                    if with_ids:
                        kept.append(bytes(raw[4 * at : 4 * to]))
                begin = end
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, [f.name for f in schema])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut_up, schema)


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room; long lengths are preferred."""
    target, reach, steps = 1 << room, 1, []
    mask = (1 << (room + 1)) - 1
    for size in sorted((s for s in left if s <= room), reverse=True):
        n, times = min(left[size], room // size), 1
        while n > 0:
            take = min(times, n)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            n -= take
            times *= 2
        if reach & target:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + take
            total -= size * take
    return chosen


def min_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, pieces of each length in such a bin), for pieces of 1 to capacity tokens."""
    left, bins = {s: n for s, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({s: n for s, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[s] // n for s, n in chosen.items())
        for s, n in chosen.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        bins.append((times, chosen))
    return bins


def _slots(bins: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, from which rank on pieces go to which bins: arrays in the order of (length, rank)."""
    rows, first, used = [], 0, {}
    for times, chosen in bins:
        offset = 0
        for size in sorted(chosen, reverse=True):
            n = chosen[size]
            rows.append((size, used.get(size, 0), first, n, offset))
            used[size] = used.get(size, 0) + n * times
            offset += size * n
        first += times
    return dict(zip(("size", "rank", "bin", "each", "offset"), np.array(sorted(rows), np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (id, piece, start, length, ...) with sequence_id and offset: where each piece lies.

    pieces is read twice and should be a table (see cut). Only the histogram of lengths, at most capacity rows,
    comes to the driver; the list of bins is bounded by capacity squared and goes out with the function.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(min_bin_slack(histogram, capacity))
    buckets = bucket_count(sum(histogram.values()), BUCKET_ROWS)
    what = ["id", "piece", "start", "length", "ids_crc32"]
    spread = F.pmod(F.xxhash64(*what), F.lit(buckets))
    numbered = ranked(pieces, ["length"], spread, [F.col(c) for c in what], "_lk_rank")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.searchsorted(slots["size"], np.arange(capacity + 2))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_lk_rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for size in np.unique(length):
                lo, hi, own = base[size], base[size + 1], length == size
                at[own] = lo + np.searchsorted(slots["rank"][lo:hi], rank[own], "right") - 1
            n = rank - slots["rank"][at]
            each = slots["each"][at]
            out = [b.column(name) for name in names[:-2]]
            out += [pa.array(slots["bin"][at] + n // each), pa.array(slots["offset"][at] + n % each * length)]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = schema.names
    return numbered.mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, by_word: bool = False, with_ids: bool = False) -> DataFrame:
    """tokenize_pieces, written once, then pack."""
    return pack(cut(tokenize_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, by_word, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences, from pack_documents(..., with_ids=True)."""

    def joined(items: list[tuple[int, bytes]]) -> bytes:
        return b"".join(ids for _, ids in sorted(items, key=lambda x: x[0]))

    def built(key: tuple, table: pa.Table) -> pa.Table:
        ids = joined(list(zip(table.column("offset").to_pylist(), table.column("ids").to_pylist(), strict=True)))
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "length": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(built, "sequence_id long, length long, ids binary")
