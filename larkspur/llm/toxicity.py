"""Toxicity: misspelled lexicon terms by Levenshtein automata, and their contexts.

The lexicon is learned: words that are much likelier in toxic than in other labelled documents. A term's weight is the lower bound of its log-odds, as a
share of the surest term's. A trie of the lexicon is intersected with the
Levenshtein automata of all its terms at once: a state is a set of (trie node, edits left), states and their moves are
made when first met and kept, so a word costs one look-up a letter and most words leave the automaton after two or three. Long terms allow one edit,
short ones none, nor do terms with more than CROWD ordinary words within one edit, as one couldn't tell a misspelling from these; ordinary words are those of clean
sample texts, and they are never taken for a misspelled term.

Each hit is read with CONTEXT words to both sides: quotation marks around it and words of reporting before it tell quotation from abuse, and the neighbours' own
weights, learned as the terms' are, tell its tone. A hit counts as its term's weight; a misspelled one by a factor that grows with the length, as every letter that is right is
evidence. What is quoted or reported counts in all as QUOTED of the logarithm of its sum, so that no heap of quotations makes abuse. A logistic model of the sum, its density and the
context, fitted to the labels, gives the score; misspelling and quotation are tied to the terms by these rules, as a sample has too few of either to be fitted to.

Fitting uses at most SAMPLE labelled rows, those whose ids have the least hashes, of rows with one id the text with the least hash; which words are terms or
contexts is decided by thresholds, so their number follows from the sample. Scoring covers all texts whole.

Defined results: a null or empty text has no hits and gets a score below 1/2 (the model's for no hits); null labels and labels of
ids without a document are not used; of several labels of an id the largest counts; rows with the same or a null id are
scored each; without any usable label every score is 0; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._words import chunked, words_of
from larkspur.session import cut

#: Labelled rows that are fitted to, at most.
SAMPLE = 20_000
#: Words to both sides of a hit, letters of a term that may be misspelled, toxic texts that a term is in and contexts that a context word is in.
CONTEXT, LEAST_LENGTH, LEAST_DOCUMENTS, LEAST_CONTEXTS = 6, 5, 4, 20
#: Ordinary words that a term may have within one edit and still be found misspelled; the share that a quoted or reported hit counts; letters that an edit takes off.
CROWD, QUOTED, LOST = 2, 0.1, 1.5
#: Words of reporting, in the languages of the corpus: fixed values.
REPORTING = "said says saying quote quoted quotes wrote writes called word words term dijo dice palabra sagte sagt schrieb zitat wort dit mot citation".split()
_QUOTES = re.compile(r"[\"'“”„«»‘’‹›]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Automaton:
    """Words within `edits` of a term, by determinising the trie's product with the Levenshtein automata when needed."""

    def __init__(self, terms: Iterable[str], edits: int, least: int, crowded: Iterable[str] = (), ordinary: Iterable[str] = (), weights: dict[str, float] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[bool] = [False]
        self.near: list[bool] = [False]
        self.value: list[float] = [0.0]
        self.term: list[str] = [""]
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.kinds: list[int] = []
        self.strengths: list[float] = []
        self.ordinary = frozenset(ordinary)
        crowd = frozenset(crowded)
        budgets: set[tuple[int, int]] = set()
        for term in sorted(set(terms)):
            node = 0
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(False)
                    self.near.append(False)
                    self.value.append(0.0)
                    self.term.append("")
                node = nxt
            self.end[node], self.near[node], self.term[node] = True, len(term) >= least and term not in crowd, term
            self.value[node] = 1.0 if weights is None else weights[term]
        self.edits = edits
        budgets.add((0, edits))
        self.start = self._state(frozenset(self._closed(budgets)))

    def _closed(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With letters of a term left out, at an edit each."""
        todo, seen = list(pairs), set(pairs)
        while todo:
            node, left = todo.pop()
            if left:
                for k in self.children[node].values():
                    if (k, left - 1) not in seen:
                        seen.add((k, left - 1))
                        todo.append((k, left - 1))
        return seen

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            exact = [self.value[n] for n, left in pairs if self.end[n] and left == self.edits]
            near = [self.value[n] * max(0.0, 1 - LOST / len(self.term[n])) for n, left in pairs if self.near[n]]
            self.kinds.append(1 if exact else 2 if near else 0)
            self.strengths.append(max(exact or near or [0.0]))
        return self.states[pairs]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, left in self.sets[state]:
            k = self.children[node].get(c)
            if k is not None:
                out.add((k, left))
            if left:
                out.add((node, left - 1))
                out.update((k, left - 1) for k in self.children[node].values())
        nxt = self._state(frozenset(self._closed(out))) if out else -1
        self.moves[state][c] = nxt
        return nxt

    def _end(self, word: str) -> int:
        state, moves = self.start, self.moves
        for c in word:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = self._move(state, c)
            if nxt < 0:
                return -1
            state = nxt
        return state

    def hit(self, word: str) -> tuple[int, float]:
        """0: no term, 1: a term, 2: misspelled; and its strength."""
        state = self._end(word)
        if state < 0 or (self.kinds[state] == 2 and word in self.ordinary):
            return 0, 0.0
        return self.kinds[state], self.strengths[state]

    def kind(self, word: str) -> int:
        return self.hit(word)[0]

    def neighbours(self, word: str) -> list[str]:
        """The terms that the word is a misspelling of."""
        state = self._end(word)
        return sorted({self.term[n] for n, _ in self.sets[state] if self.near[n]}) if state >= 0 and self.kinds[state] == 2 else []


@dataclass
class Model:
    terms: dict[str, float]  # with their weights, 1 at most
    crowded: list[str]
    ordinary: list[str]
    context: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def automaton(self) -> Automaton:
        return Automaton(self.terms, 1, LEAST_LENGTH, self.crowded, self.ordinary, self.terms)


FEATURES = 4


def normal(word: bytes) -> str:
    return _EDGE.sub("", word.decode("utf-8", "replace")).casefold()


def _features(texts: list[bytes], automaton: Automaton, context: dict[str, float], known: dict[bytes, tuple[int, float]]) -> np.ndarray:
    """Of each text the logarithms of what its hits count and of that a hundred words, and the hits' good and bad context."""
    w = words_of(texts)
    strength = np.zeros(len(w.distinct))
    if len(known) > 1_000_000:
        known.clear()
    for i, word in enumerate(w.distinct):
        k = known.get(word)
        if k is None:
            k = known[word] = automaton.hit(normal(word))
        strength[i] = k[1]
    out = np.zeros((len(texts), FEATURES))  # plain hits, quoted ones, context
    offsets, at = w.offsets, np.flatnonzero(strength[w.ids] > 0)
    owners = np.searchsorted(offsets, at, "right") - 1
    for p, d in zip(at.tolist(), owners.tolist(), strict=True):
        lo, hi = max(int(offsets[d]), p - CONTEXT), min(int(offsets[d + 1]), p + CONTEXT + 1)
        near = [w.distinct[i] for i in w.ids[lo:hi].tolist()]
        before = b" ".join(near[: p - lo]).decode("utf-8", "replace")
        own = near[p - lo].decode("utf-8", "replace")
        after = b" ".join(near[p - lo + 1 :]).decode("utf-8", "replace")
        marked = bool(_QUOTES.match(own) and _QUOTES.search(own[1:])) or bool((_QUOTES.search(before) or _QUOTES.match(own)) and (_QUOTES.search(after) or _QUOTES.search(own[-1:])))
        words = [normal(x) for x in near]
        told = marked or any(x in REPORTING for x in words[: p - lo])
        own_strength = strength[w.ids[p]]
        if told:
            out[d, 1] += own_strength
        else:
            weight = sum(context.get(x, 0.0) for i, x in enumerate(words) if i != p - lo)
            out[d] += [own_strength, 0.0, max(weight, 0.0), min(weight, 0.0)]
    total = out[:, 0] + QUOTED * np.log1p(out[:, 1])
    x = np.stack([total, total * 100 / np.maximum(w.counts, 1), out[:, 2], out[:, 3]], 1)
    return np.sign(x) * np.log1p(np.abs(x))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rising: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps. The first `rising` features may only raise the score: one that would lower it is left out."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    for _ in range(rising):
        b = _newton(x, y, mean, scale, ridge)
        wrong = np.flatnonzero(b[:rising] < 0)
        if not len(wrong):
            break
        x = x.copy()
        x[:, wrong] = 0.0
        mean[wrong], scale[wrong] = 0.0, np.inf
    return mean, scale, _newton(x, y, mean, scale, ridge)


def _newton(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, ridge: float) -> np.ndarray:
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(b))
    penalty[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _counted(sample: DataFrame, words: Callable[[list[bytes]], Iterator[tuple[int, set[str]]]]) -> DataFrame:
    """(word, toxic, clean): in how many texts or contexts of each label a word is; words yields (row, its words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches, "text", 1 << 20):
            labels, by = batch.column(1).to_pylist(), (Counter(), Counter())
            for i, found in words(texts):
                by[labels[i]].update(found)
            names = sorted(by[0] | by[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][w] for w in names], pa.int64()), pa.array([by[0][w] for w in names], pa.int64())], ["word", "toxic", "clean"])

    return sample.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _words_in(texts: list[bytes]) -> Iterator[tuple[int, set[str]]]:
    for i, t in enumerate(texts):
        yield i, {normal(w) for w in set(t.split())} - {""}


def _contexts(model: Model) -> Callable[[list[bytes]], Iterator[tuple[int, set[str]]]]:
    def around(texts: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        automaton = model.automaton()
        for i, t in enumerate(texts):
            raw = t.split()
            hit = {w for w in set(raw) if automaton.kind(normal(w))}
            for p, x in enumerate(raw if hit else []):
                if x in hit:
                    yield i, {normal(w) for w in raw[max(0, p - CONTEXT) : p] + raw[p + 1 : p + CONTEXT + 1]} | {""}

    return around


def _ordinary(sample: DataFrame, terms: list[str]) -> tuple[list[str], list[str]]:
    """The terms with more than CROWD words of clean texts within one edit, and such words of the other terms."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, found = Automaton(terms, 1, LEAST_LENGTH), set()
        for _, texts in chunked(batches, "text", 1 << 20):
            for t in texts:
                for w in set(t.split()):
                    word = normal(w)
                    found.update((term, word) for term in automaton.neighbours(word))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], ["term", "word"])

    pairs = cut(sample.filter("label = 0").mapInArrow(near, "term string, word string").distinct(), "ordinary")
    counts = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    crowded = [r["term"] for r in counts.filter(F.col("n") > CROWD).orderBy("term").collect()]
    few = pairs.join(counts.filter(F.col("n") <= CROWD), "term", "left_semi").select("word").distinct()  # CROWD words a term at most
    return crowded, [r["word"] for r in few.orderBy("word").collect()]


def learn(sample: DataFrame) -> Model | None:
    """Lexicon, context weights and score from rows (text, label); None unless both labels occur.

    Words are counted by tasks; the driver gets the terms, the context words and FEATURES numbers a row of the sample.
    """
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    counts = _counted(sample, _words_in)
    odds = F.log((F.col("toxic") + 0.05) / (n[1] + 1)) - F.log((F.col("clean") + 0.05) / (n[0] + 1))
    # a term must raise the odds of its documents well past even, and be in several
    sure = counts.withColumn("odds", odds).filter((F.col("toxic") >= LEAST_DOCUMENTS) & (F.length("word") >= 3) & (F.col("toxic") >= 4 * F.col("clean")) & (F.col("odds") >= math.log(8)))
    # the lower bound of the log-odds, from counts with a half added
    least = {r["word"]: math.log((r["toxic"] + 0.5) / (n[1] + 1) * (n[0] + 1) / (r["clean"] + 0.5)) - 1.64 * math.sqrt(1 / (r["toxic"] + 0.5) + 1 / (r["clean"] + 0.5)) for r in sure.orderBy("word").collect()}
    most = max(least.values(), default=1.0)
    terms = {w: max(0.1, v / most if most > 0 else 1.0) for w, v in least.items()}
    crowded, ordinary = _ordinary(sample, list(terms))
    model = Model(terms, crowded, ordinary, {}, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    near = _counted(sample, _contexts(model)).filter(F.col("toxic") + F.col("clean") >= LEAST_CONTEXTS).collect()
    seen = next(((r["toxic"], r["clean"]) for r in near if r["word"] == ""), (0, 0))  # "" counts the contexts
    if all(seen):
        model.context = {r["word"]: math.log((r["toxic"] + 5) / (seen[0] + 10)) - math.log((r["clean"] + 5) / (seen[1] + 10)) for r in near if r["word"] and r["word"] not in terms}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch, texts in chunked(batches, "text", 1 << 20):
            x = _features(texts, automaton, model.context, {})
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    found = sample.mapInArrow(featured, "x array<double>, label int").toArrow()
    model.mean, model.scale, model.weights = _fit(np.array(found.column("x").to_pylist()), found.column("label").to_numpy().astype(float))
    return model


def scores(texts: list[bytes], model: Model, automaton: Automaton, known: dict[bytes, tuple[int, float]]) -> np.ndarray:
    """The score of each whole text."""
    z = (_features(texts, automaton, model.context, known) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -30, 30)))


def _held_out(folds: int) -> Column:
    return F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model | None:
    """What is learned from the labelled rows that aren't held out, SAMPLE at most."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(~_held_out(folds))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # SAMPLE rows of two numbers at most: 0.3 MB
    sample = texts.join(F.broadcast(chosen), "id").filter("text is not null")
    return learn(cut(sample.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).select("text", "label"), "labelled"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) of every row. Rows whose crc32(id as text) is divisible by folds are held out."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = learn_from(docs, labels, id_col, text_col, label_col, folds)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words = model.automaton() if model else None, {}
        for batch, part in chunked(batches, "text"):
            score = scores(part, model, automaton, words) if model else np.zeros(len(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema.names)

    out = texts.mapInArrow(scored, schema)
    return out.select("id", F.coalesce(_held_out(folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
