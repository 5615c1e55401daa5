"""Packing, sharding and mixing: exact round trips, laws and optimality on small cases."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import _shared, mixing, packing, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, row string, id int"


def rows(seed=3, n=120):
    rng = random.Random(seed)
    words = ["Of,", "the", "x<|endoftext|>.", "<|ENDOFTEXT|>", "it's", "ÉTÉ.", "a..", "naïve", "12.", "\x01", "H̱.", "漢字", "&&&"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 90, 400]))), rng.choice(["a"] * 6 + ["b", "c", None]), "r", 1) for i in range(n)]
    out += [(900, None, None, "r", 1), (901, "", "b", "r", 1), (5, out[5][1], "a", "r", 1), (None, "the of", "a", "r", 1), (902, "the " * 9000, "c", "r", 1), (903, "a\x1cb c d", "c", "r", 1)]
    return out


@pytest.mark.parametrize("by_word", [True, False])
def test_packed_sequences_hold_every_token(spark, by_word):
    data, capacity, t = rows(), 256, Tokenizer.from_file(PATH)
    packed = packing.pack_documents(spark.createDataFrame(data, SCHEMA), PATH, capacity=capacity, by_word=by_word, with_ids=True)
    got = packed.collect()
    expected = Counter()
    for i, text, *_ in data:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            expected[i, p, at, len(piece), zlib.crc32(piece.tobytes()), piece.tobytes()] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / capacity) + 1
    made = {r.sequence_id: r for r in packing.sequences(packed, capacity).collect()}
    assert sum(r.length for r in made.values()) == total and len(made) == len(bins)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        chosen = packing.fullest(left, room)
        assert all(0 < n <= left[s] for s, n in chosen.items())
        reachable = {sum(s * n for s, n in zip(left, c)) for c in itertools.product(*[range(n + 1) for n in left.values()])}
        assert sum(s * n for s, n in chosen.items()) == max(x for x in reachable if x <= room)


def test_bins_use_each_piece_once():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 101): rng.randrange(1, 300) for _ in range(60)}
    bins, used = packing.min_bin_slack(histogram, 100), Counter()
    for times, chosen in bins:
        assert sum(s * n for s, n in chosen.items()) <= 100
        used.update({s: n * times for s, n in chosen.items()})
    assert used == Counter(histogram)


def test_shards_match_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    monkeypatch.setattr(_shared, "GROUP", 3)
    data, shards = rows(n=300), 16
    got = sharding.assign_shards(spark.createDataFrame(data, SCHEMA), shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.id, r.source, r.size, r.text_crc32) for r in got) == Counter((i, s, size(t), zlib.crc32((t or "").encode())) for i, t, s, *_ in data)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    counts = [len(by[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and len(by) == shards
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    for source, n in Counter(s for _, _, s, *_ in data).items():
        for v in by.values():
            assert abs(sum(r.source == source for r in v) - n / shards) <= 2
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA), shards).count() == 0
    few = sharding.assign_shards(spark.createDataFrame(data[:5], SCHEMA), shards).collect()
    assert len({r.shard for r in few}) == 5 and {r.slot for r in few} == {0}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "a", "r", 1) for i in range(40)], SCHEMA)
    sharding.write_shards(df, sharding.assign_shards(df, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [10] * 4


@pytest.mark.parametrize("options", [{"entropy": 0.97}, {"repetition": 1.5}, {"repetition": 1.5, "budget": None}, {"entropy": 0.5, "budget": 0.3}])
def test_mixing(spark, monkeypatch, options):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 9)
    monkeypatch.setattr(_shared, "GROUP", 3)
    data = rows(n=400)
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(df, **options).collect()
    words = lambda t: len((t or "").encode().split())
    tokens = Counter()
    for _, t, s, *_ in data:
        tokens[s] += words(t)
    total, budget = sum(tokens.values()), options.get("budget", 1.0)
    shares = {s: n / total for s, n in tokens.items()}

    def weights(a):
        z = sum(q**a for q in shares.values())
        return {s: q**a / z for s, q in shares.items()}

    def met(a):
        p = weights(a)
        if "entropy" in options:
            return -sum(x * math.log(x) for x in p.values()) <= options["entropy"] * math.log(len(p)) + 1e-12
        rate = {s: p[s] / shares[s] for s in p}
        return (max(rate.values()) / min(rate.values()) if budget is None else budget * max(rate.values())) <= options["repetition"] + 1e-12

    lo, hi = 0.0, 8.0 if "entropy" in options else 1.0
    for _ in range(60):
        lo, hi = (lo, (lo + hi) / 2) if met((lo + hi) / 2) else ((lo + hi) / 2, hi)
    p = weights(round(hi, 6))
    read, epochs, ids = Counter(), defaultdict(Counter), Counter(i for i, *_ in data)
    for r in got:
        read[r.source] += r.tokens
        epochs[r.source][r.epoch] += 1
    wanted = total * budget if budget is not None else max(tokens[s] / p[s] for s in p)
    longest = {s: max(words(t) for _, t, s2, *_ in data if s2 == s) for s in p}
    for s in p:
        assert read[s] <= round(p[s] * wanted) + 1 and read[s] > p[s] * wanted - longest[s] - 1
    by_epoch = defaultdict(Counter)
    for r in got:
        by_epoch[r.source, r.epoch][r.id] += 1
    rows_of = Counter(s for _, _, s, *_ in data)
    for (s, e), c in by_epoch.items():
        assert all(n <= ids[i] for i, n in c.items())
        if e < max(epochs[s]):
            assert sum(c.values()) == rows_of[s]
    if budget is None:
        assert {r.id for r in got} == set(ids)
    kept = mixing.mix_documents(df, **options)
    assert kept.columns == df.columns and kept.count() == len(got)


def test_mixing_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), entropy=0.9).count() == 0
    one = spark.createDataFrame([(1, "a b", None, "r", 1), (2, None, None, "r", 1)], SCHEMA)
    assert sorted(r.id for r in mixing.mix(one, entropy=0.9).collect()) == [1, 2]
    assert mixing.mix(spark.createDataFrame([(1, "", "a", "r", 1)], SCHEMA), repetition=2.0).count() == 0
