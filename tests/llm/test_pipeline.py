"""Each stage of the pipeline against brute force, on rows with repeated ids, nulls, ties, repeated rows, a very long text and clashing columns.

Line dedup and near-dedup are held against brute force in test_dedup.py, through their stages.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_models import base_of, brute_log_perplexities
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _lk_id int, kept boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    stems = {"en": ["the", "ing", "ed", "er", "tion", "an"], "fr": ["le", "eau", "eux", "ê", "ou", "re"], None: ["zu", "ach", "ver"], "zh": ["語", "文", "字", "漢", "書"]}
    out = []
    for i in range(140):
        lang = rng.choice(list(stems))
        w = ["".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 150))]
        if i % 12 == 0:
            w = [x + rng.choice(["###", " |", "%%%"]) for x in w]
        out.append((i, " ".join(w), lang, rng.choice(["a", "a", "a", "b", "c", None])))
    out += [(5, out[9][1], "en", "a"), (5, out[5][1], out[5][2], out[5][3]), (None, out[11][1], "en", "b"), (None, out[12][1], "en", "b"), (900, None, "en", "a"), (901, "", None, None), (902, " ".join(rng.choice(stems["en"]) + rng.choice(stems["en"]) for _ in range(30_000)), "en", "d")]
    return [(i, t, lang, s, len(t or ""), "clash", 3, False) for i, t, lang, s in out]


def test_quality_stage(spark, rows, monkeypatch):
    monkeypatch.setattr(quality, "MOST_BANDS", 0)  # test_models.py has the bands sent to the rows
    df = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.quality(spark, df, "")
    assert got.columns == df.columns
    value = brute_log_perplexities(spark, rows)
    fold = {r.t: r.f for r in spark.createDataFrame([(t,) for _, t, *_ in rows], "t string").selectExpr("t", "pmod(xxhash64(t), 2) f").collect()}
    passed = [r for r in rows if not base_of(r[1])[-1]]
    bins = defaultdict(list)
    for r in passed:
        bins[r[2], fold[r[1]]].append(math.floor(value[r[1], r[2]] / quality.BIN))
    expected = Counter()
    for r in passed:
        own = sorted(bins[r[2], fold[r[1]]])
        q1, q3 = (own[math.ceil(x * len(own)) - 1] * quality.BIN for x in (0.25, 0.75))
        spread = max(q3 - q1, quality.BIN)
        if q1 - quality.BELOW * spread <= value[r[1], r[2]] <= q3 + quality.BIN + quality.ABOVE * spread:
            expected[r] += 1
    assert Counter(map(tuple, got.collect())) == expected and 0 < sum(expected.values()) < len(passed)


def test_mixing_stage(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.mixing(spark, df, "")
    assert got.columns == df.columns
    read, there = Counter(map(tuple, got.collect())), Counter(rows)
    assert set(read) == set(there)
    most = math.ceil(corpus_pipeline.REPETITION)
    assert all(there[r] <= n <= most * there[r] for r, n in read.items())
    words, tokens, seen = lambda t: len((t or "").encode().split()), Counter(), Counter()
    for r in rows:
        tokens[r[3]] += words(r[1])
    for r, n in read.items():
        seen[r[3]] += n * words(r[1])
    total = sum(tokens.values())

    def rates(a):
        return {s: (n / total) ** (a - 1) for s, n in tokens.items()}

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if max(rates(mid).values()) / min(rates(mid).values()) <= corpus_pipeline.REPETITION else (mid, hi)
    rate, least = rates(round(hi, 6)), min(rates(round(hi, 6)).values())
    for s in tokens:
        longest = max(words(r[1]) for r in rows if r[3] == s)
        assert tokens[s] <= seen[s] <= rate[s] / least * tokens[s] + 1 and seen[s] > rate[s] / least * tokens[s] - longest - 1


def test_packing_stage(spark, rows):
    got = corpus_pipeline.packing(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        pieces.update((i, k, 2048 * k, min(2048, n - 2048 * k)) for k in range(math.ceil(n / 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= math.ceil(sum(n for *_, n in pieces.elements()) / 2048) + 1


def test_every_stage_takes_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
