"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each document.  Expectation-
maximisation over the counts of all vote patterns estimates how often each heuristic is
right for good and for bad documents; the posterior of a document's own pattern is its
label, and labels of a bounded sample train a linear scorer over hashed words and shapes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import SYMBOLS

#: Frequent function words of a few languages, for the vote on running text.
FUNCTION_WORDS = "the of and to in a is that for it was with as on by der die und das ist ein nicht von mit zu den le la les de et un une est que pour dans el los las y en por con una para se del".split()


#: The heuristics, in the order of their votes.
NAMES = ["symbols", "word_length", "repeats", "lines", "size", "shouting", "marks", "variety", "runs", "running"]
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANKS = re.compile("[\x20\x09-\x0D]+")
#: Kinds of a code point, as bits.
UPPER, SYMBOL, MARK, OTHER = 1, 2, 4, 8


def _kind(c: str) -> int:
    return (UPPER if c.isupper() else 0) | (SYMBOL if c in SYMBOLS else 0) | (MARK if c in "!?|" else 0) | (0 if c.isalnum() or c == "_" or c.isspace() else OTHER)


class Ballots:
    """Votes on texts: 1 good, -1 bad, 0 nothing.  The heuristics overlap on purpose.

    Characters are counted by a table of their kinds, words and windows of three by
    their hashes.
    """

    def __init__(self):
        self.kinds = np.array([_kind(chr(c)) for c in range(65536)], np.uint8)
        self.function = set(FUNCTION_WORDS)

    def votes(self, text: str) -> list[int]:
        words = [w for w in _BLANKS.split(text) if w]
        n, chars = max(len(words), 1), sum(map(len, words))
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        distinct, repeated = len(np.unique(h)), 0
        if len(h) >= 3:
            three = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
            order = np.argsort(three, kind="stable")
            equal = three[order][1:] == three[order][:-1]
            if equal.any():
                covered = np.zeros(len(h), bool)
                for side in (order[1:][equal], order[:-1][equal]):
                    covered[side] = covered[side + 1] = covered[side + 2] = True
                repeated = int(covered.sum())
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(c) and c.max() > 65535:
            kinds = self.kinds[np.where(c > 65535, 0, c)]
            kinds[c > 65535] = [_kind(chr(x)) for x in c[c > 65535].tolist()]
        else:
            kinds = self.kinds[c]
        tally = np.bincount(kinds, minlength=16)
        upper, symbols, marks = (int(sum(tally[k] for k in range(16) if k & bit)) for bit in (UPPER, SYMBOL, MARK))
        # Runs of an equal character that is neither word nor space: each three of it count once.
        triple = (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (kinds[2:] & OTHER > 0)
        runs = 0
        if triple.any():
            at = np.flatnonzero(triple)
            length = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(at) > 1)), len(at))) + 2
            runs = int((length // 3).sum())
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        function = sum(map(self.function.__contains__, _LETTERS.findall(text.lower())))
        length, duplicate = chars / n, 1 - len(set(lines)) / max(len(lines), 1)
        tests = [
            (symbols < 0.02 * n, symbols > 0.2 * n),
            (3.5 < length < 8, length < 2.5 or length > 12),
            (repeated < 0.15 * n, repeated > 0.5 * n),
            (not lines or duplicate < 0.05, bool(lines) and duplicate > 0.3),
            (50 <= len(words) <= 50_000, len(words) < 10),
            (upper < 0.25 * chars, upper > 0.5 * chars),
            (marks < 0.1 * n, marks > 0.5 * n),
            (distinct > 0.2 * n, distinct < 0.1 * n and len(words) >= 50),
            (runs < 0.01 * n, runs > 0.1 * n),
            (function > 0.06 * n, function < 0.01 * n and len(words) >= 30),
        ]
        return [-1 if bad else 1 if good else 0 for good, bad in tests]


def _vote_batches(batches):
    ballots = Ballots()
    for batch in batches:
        patterns = [",".join(map(str, ballots.votes(x or ""))) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(patterns, pa.string())], names=["doc_id", "text", "pattern"])


def _tally_batches(batches):
    """Votes counted inside a task: a row a pattern."""
    tally, ballots = Counter(), Ballots()
    for batch in batches:
        for x in batch.column(0).to_pylist():
            tally[",".join(map(str, ballots.votes(x or "")))] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(tally.keys()), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["pattern", "n"])


#: What a heuristic is taken to do before any vote is seen, for (bad, good) documents: shares of -1, 0, 1.
#: A bad vote is rarely wrong, but a bad document need not show in most heuristics.
BELIEF = np.array([[0.15, 0.10, 0.75], [0.005, 0.195, 0.80]])


def fit_labels(patterns: np.ndarray, counts: np.ndarray, strength: float = 0.05, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (m x k, values -1, 0, 1) with counts.

    Returns the posterior of good for each pattern, rates[class, heuristic, vote + 1]
    and the prior of good.  ``BELIEF`` counts as ``strength`` times all votes; with the
    start (bad if any heuristic says so) it also names the classes.
    """
    if not len(patterns):
        return np.zeros(0), np.full((2, patterns.shape[1], 3), 1 / 3), 0.5
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    post = np.where((patterns < 0).any(1), 0.02, np.where((patterns > 0).any(1), 0.9, 0.5))
    total, before = counts.sum(), -np.inf
    weight = strength * total
    for _ in range(rounds):
        both = np.stack([1 - post, post]) * counts
        prior = np.clip(both[1].sum() / total, 1e-4, 1 - 1e-4)
        rates = (np.einsum("cm,mkv->ckv", both, onehot) + weight * BELIEF[:, None, :]) / (both.sum(1)[:, None, None] + weight)
        logs = np.einsum("mkv,ckv->cm", onehot, np.log(rates)) + np.log([[1 - prior], [prior]])
        top = logs.max(0)
        norm = top + np.log(np.exp(logs - top).sum(0))
        post = np.exp(logs[1] - norm)
        now = float((counts * norm).sum() / total)
        if abs(now - before) < tolerance:
            break
        before = now
    return post, rates, float(prior)


@dataclass
class Scorer:
    weights: np.ndarray
    bits: int


class Hasher:
    """Hashed words and word shapes of whole texts with log frequencies, scaled to length one; what words hash to is remembered."""

    def __init__(self, bits: int):
        self.mask, self.known = (1 << bits) - 1, {}

    def _word(self, w: str) -> tuple[int, int]:
        marks = "" if w.isalnum() else "".join(sorted({c for c in w if not c.isalnum()}))[:4]
        shape = f"\0{min(len(w), 12)}{marks}"
        return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & self.mask for x in (w.lower(), shape))

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts, total = Counter(words), max(len(words), 1)
        if len(self.known) > 300_000:
            self.known = {}
        bag: dict[int, float] = {}
        shapes: dict[int, float] = {}
        for w, n in counts.items():
            at = self.known.get(w)
            if at is None:
                at = self.known[w] = self._word(w)
            bag[at[0]] = bag.get(at[0], 0) + n
            shapes[at[1]] = shapes.get(at[1], 0) + n
        distinct = zlib.crc32(b"\1distinct") & self.mask
        shapes[distinct] = shapes.get(distinct, 0) + len(counts)
        at = np.fromiter((*bag, *shapes), np.int64, len(bag) + len(shapes))
        logs = np.log1p(np.fromiter(bag.values(), np.float64, len(bag)))
        norm = np.sqrt(logs @ logs) or 1.0
        return at, np.concatenate([logs / norm, np.fromiter(shapes.values(), np.float64, len(shapes)) * (3.0 / total)])


def _feature_batches(batches, bits: int):
    hasher = Hasher(bits)
    for batch in batches:
        made = [hasher.features(x or "") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([b.astype(np.float32) for _, b in made], pa.list_(pa.float32())), batch.column(1)], names=["at", "value", "label"])


def fit_scorer(rows, bits: int, epochs: int = 20, rate: float = 0.5, decay: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels by adaptive gradient steps; rows: (indices, values, label) triples."""
    weights, seen = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-8)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            at, value = np.append(at, 1 << bits), np.append(value, 1.0)
            z = float(weights[at] @ value)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * value + decay * weights[at]
            np.add.at(seen, at, g * g)
            np.subtract.at(weights, at, rate * g / np.sqrt(seen[at]))
    return Scorer(weights, bits)


def _score_batches(batches, held):
    scorer: Scorer = held.value
    hasher = Hasher(scorer.bits)
    for batch in batches:
        scores = []
        for text in batch.column(1).to_pylist():
            at, value = hasher.features(text or "")
            z = float(scorer.weights[at] @ value + scorer.weights[-1])
            scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


@dataclass
class Model:
    """The scorer, and what the weak labels came from: posterior by vote pattern, rates[class, heuristic, vote + 1], prior of good."""

    scorer: Scorer
    posterior: dict[str, float]
    rates: np.ndarray
    prior: float


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 6_000, bits: int = 16) -> Model:
    """Accuracies from the votes on all rows; the scorer from about ``train_rows`` rows.

    Those are drawn by a hash of row, id and text against a threshold of 64 bits, so null
    and repeated ids are drawn like any other, at any number of rows; twice ``train_rows``
    is the most that the driver takes.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # At most 3 ** len(NAMES) patterns, whatever the input.
    tally = base.select("text").mapInArrow(_tally_batches, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([[int(x) for x in r[0].split(",")] for r in tally]).reshape(-1, len(NAMES))
    counts = np.array([r[1] for r in tally], float)
    post, rates, prior = fit_labels(patterns, counts)
    posterior = {r[0]: float(x) for r, x in zip(tally, post)}
    share = min(1.0, train_rows / max(counts.sum(), 1))
    draw = F.xxhash64(F.monotonically_increasing_id(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(11))
    drawn = draw <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("text", T.StringType()), T.StructField("pattern", T.StringType())])
    sample = base.filter(drawn).mapInArrow(_vote_batches, schema).select("text", "pattern")
    got = sample.mapInArrow(lambda it: _feature_batches(it, bits), "at array<int>, value array<float>, label string").limit(2 * train_rows).toArrow()
    rows = [(np.array(a, np.int64), np.array(v), posterior[p]) for a, v, p in zip(got.column("at").to_pylist(), got.column("value").to_pylist(), got.column("label").to_pylist())]
    return Model(fit_scorer(rows, bits), posterior, rates, prior)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, model: Model | None = None, **options) -> DataFrame:
    """One row per input row: doc_id, score (of good quality), kept (score >= ``threshold``).

    Without a model one is learned from ``docs``, see :func:`learn`.  Null texts count as
    empty; repeated rows are scored alike; an empty table gives an empty result.  Other
    columns of ``docs`` are not read.
    """
    model = learn(docs, id_col, text_col, **options) if model is None else model
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model.scorer)
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(lambda it: _score_batches(it, held), schema).withColumn("kept", F.col("score") >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
