"""Words of whole texts, in batches: `[^\\x20\\x09-\\x0D]+`, which is what bytes.split() yields of UTF-8."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20


@dataclass
class Words:
    """The words of some texts: numbers into `distinct`, text after text."""

    ids: np.ndarray
    counts: np.ndarray
    distinct: list[bytes]

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words_of(texts: list[bytes]) -> Words:
    flat: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        counts[i] = len(w)
        flat += w
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), counts, coded.dictionary.to_pylist())


def hashes_of(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Null texts become empty ones."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: What a worker remembers between the tasks of one operator; the tasks of others empty it.
remembered: list[dict] = []


def chunked(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES, keep: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about `most` bytes, with the texts as UTF-8."""
    for batch in batches:
        texts = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
        del batch, texts
    if not keep:
        for known in remembered:
            known.clear()
    trim()


def over_chunks(batches: Iterator[pa.RecordBatch], text: str, work: Callable[[pa.RecordBatch, list[bytes]], list[pa.RecordBatch]], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """What work makes of each slice (see chunked). Nothing of a slice is held any more when free memory is given back."""
    slices = chunked(batches, text, most)
    while (some := next(slices, None)) is not None:
        out = work(*some)
        del some
        yield from out
        del out


def trim() -> None:
    """Give free memory back to the system, as a worker stays for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive numbers; by doubling, so log2(k) passes."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, length = None, 0, h.copy(), 1
        rest = k
        while rest:
            if rest & 1:
                part = power[done : done + len(h) - k + 1]
                out = part.copy() if out is None else mixed(out * _P + part)
                done += length
            rest >>= 1
            if rest:
                power = mixed(power[:-length] * _P + (power[length:] ^ (power[length:] >> np.uint64(29))))
                length *= 2
    return out
