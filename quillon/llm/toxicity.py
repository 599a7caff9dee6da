"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are scored by the log-odds of the texts with their word, or of its 4 to 7 leading
characters where these surely tell more, between toxic and other labelled texts, with a
Dirichlet prior in proportion to the texts of both. A drift that all tokens share
makes nearly every other text sink, whatever its language, so that only a stretch
with much stronger words rises. One linear scan finds every maximal segment of a
text; the extreme-value law of segment scores, taken from the tokens of the other
texts, turns them into probabilities, whose evidence a logistic function maps to
the label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import checkpoint, remainder, utf8

#: The model is fitted on this many labelled rows at most, those with the smallest hash of their id.
SAMPLE = 16384
#: Weight of the prior in texts; z value and texts from which a feature counts.
PRIOR, Z, LEAST = 100.0, 4.0, 5
PREFIXES = (4, 5, 6, 7)
#: Least drift of a token; share of the other texts whose mean token score it takes below zero.
DRIFT, SINK = 0.05, 0.95
#: Expected number of equally high segments in unrelated text below which a segment is significant.
SIGNIFICANT = 0.05
#: A-Z lower-cased, ASCII punctuation to spaces.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + bytes(c for c in range(33, 127) if not chr(c).isalnum()), bytes(range(97, 123)) + b" " * 32)
_FEATURES = pa.schema([("feature", pa.string()), ("y0", pa.int64()), ("y1", pa.int64())])


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def features(token: bytes) -> list[str]:
    """The word itself and its prefixes."""
    word = token.decode("utf-8", "replace")
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


def segments(scores: list[float]) -> list[float]:
    """Scores of all maximal scoring segments (Ruzzo and Tompa), in linear time."""
    done: list[tuple] = []
    stack: list[tuple[float, float, int]] = []  # total before and up to the end of each candidate, and the last before it that starts lower
    total = 0.0
    for x in scores:
        before, total = total, total + x
        if x <= 0:
            continue
        low, high = before, total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= low:
                k = stack[k][2]
            if k < 0:  # nothing later reaches back beyond this one
                done += stack
                stack = [(low, high, -1)]
                break
            if stack[k][1] >= high:
                stack.append((low, high, k))
                break
            low = stack[k][0]
            del stack[k:]
    return [high - low for low, high, _ in done + stack]


class Scores(dict):
    """Score of each token; words are looked at once."""

    def __init__(self, lexicon: dict[str, tuple[float, float]], drift: float) -> None:
        self.lexicon, self.drift = lexicon, drift

    def __missing__(self, token: bytes) -> float:
        known = [self.lexicon[f] for f in features(token) if f in self.lexicon]
        self[token] = score = (max(known)[1] if known else 0.0) + self.drift
        return score


class Model:
    """Token scores, the law of their segments and the final logistic function."""

    def __init__(self, rows: list, n0: float, n1: float) -> None:
        """rows: (feature, y0, y1), the other and the toxic texts that have it; n0, n1: all texts of both."""
        self.weights, self.base = None, 0.1
        self.lexicon: dict[str, tuple[float, float]] = {}
        n = max(n0 + n1, 1.0)
        for feature, y0, y1 in rows:
            a = PRIOR * (y0 + y1) / n
            odds = math.log((y1 + a) / (n1 + PRIOR - y1 - a)) - math.log((y0 + a) / (n0 + PRIOR - y0 - a))
            error = math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
            if abs(odds) >= Z * error:
                self.lexicon[feature] = (abs(odds) - 2 * error, odds)
        self.drift, self.rate, self.scale = -DRIFT, 1.0, 0.1

    def profile(self, text: bytes, scores: Scores) -> tuple[float, list[float], list[int]]:
        """Mean token score without drift, and the scores of the text's tokens with their numbers."""
        found, counts = np.unique(np.array(list(map(scores.__getitem__, tokens(text)))), return_counts=True)
        return float(found @ counts) / max(int(counts.sum()), 1), found.tolist(), counts.tolist()

    def settle(self, means: list[float], counts: dict[float, int]) -> None:
        """Fit the drift and the law's rate to the other texts: mean token score of each, and how many of all
        their tokens have a score, both without drift."""
        self.drift = -DRIFT - max(float(np.quantile(means, SINK)) if means else 0.0, 0.0)
        x = np.array(sorted(counts)) + self.drift
        share = np.array([counts[k] for k in sorted(counts)], float) / max(sum(counts.values()), 1)
        if not len(x) or x[-1] <= 0:  # no token of the other texts rises
            return
        # the rate at which the mean of exp(rate * score) is 1, positive as the mean score is not
        low, high = 1e-3, 50.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if share @ np.exp(np.minimum(mid * x, 700)) < 1 else (low, mid)
        self.rate = (low + high) / 2

    def scores(self) -> Scores:
        return Scores(self.lexicon, self.drift)

    def raw(self, text: bytes, scores: Scores) -> tuple[int, list[float]]:
        """Number of tokens and the segments' scores."""
        words = tokens(text)
        if not words:
            return 0, []
        found = np.array(list(map(scores.__getitem__, words)))
        rise = found > 0
        # tokens that rise or sink one after the other are one step
        starts = np.flatnonzero(np.diff(rise, prepend=~rise[0]))
        return len(words), segments(np.add.reduceat(found, starts).tolist()) if rise.any() else []

    def evidence(self, n: int, found: list[float]) -> list[float]:
        """Best segment's -log10 p, number of significant segments and their -log10 p in all."""
        best = total = 0.0
        count = 0
        for s in found:
            e = self.scale * max(n, 1) * math.exp(-self.rate * s)
            p = min(-math.log10(max(-math.expm1(-e), 1e-30)), 30.0)
            best = max(best, p)
            if e < SIGNIFICANT:
                count, total = count + 1, total + p
        return [best / 10, math.log1p(count), math.log1p(total)]

    def calibrate(self, best: list[tuple[int, float]], labels: np.ndarray) -> None:
        """Fit the law's scale to the other texts: number of tokens and best segment of each text."""
        other = [x for x, y in zip(best, labels, strict=True) if not y]
        if other:
            self.scale = min(1.0, len(other) / max(sum(n * math.exp(-self.rate * s) for n, s in other), 1e-9))

    def weigh(self, evidence: list[list[float]], labels: np.ndarray) -> None:
        """Fit the logistic function to all texts."""
        self.base = (labels.sum() + 1) / (len(labels) + 10)
        if 0 < labels.sum() < len(labels):
            x = np.column_stack([np.ones(len(evidence)), np.array(evidence)])
            w = np.zeros(x.shape[1])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (labels - p) - 0.1 * w)
                w += np.clip(step, -3, 3)
            self.weights = w

    def score(self, text: bytes, scores: Scores) -> tuple[float, int]:
        if len(scores) > 400_000:
            scores.clear()
        n, found = self.raw(text, scores)
        evidence = self.evidence(n, found)
        if self.weights is None:
            return self.base, round(math.expm1(evidence[1]))
        x = self.weights[0] + float(self.weights[1:] @ evidence)
        return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0))), round(math.expm1(evidence[1]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = tokens(text)
            counts[y].update({f for word in set(words) for f in features(word)})
            counts[y][""] += 1
    names = sorted(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][f] for f in names], pa.int64()), pa.array([counts[1][f] for f in names], pa.int64())], schema=_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of the labelled texts outside the held-out fifth.

    A document with several labels is toxic if one of them says so; null ids and null
    labels are left out. At most ``sample`` documents are used, and equal texts once.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text")).where("text is not null").join(F.broadcast(known), "doc_id")
    texts = checkpoint(texts.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", utf8(F.col("text")).alias("text")))
    counts = texts.mapInArrow(_count, "feature string, y0 long, y1 long").groupBy("feature").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))
    counts = checkpoint(counts)
    totals = {r.feature: r for r in counts.where("feature = ''").collect()}
    n0, n1 = (totals[""].y0, totals[""].y1) if totals else (0, 0)
    # only features that Model counts as significant are collected, by its own formula; the sample bounds their
    # number. One that every text has tells nothing.
    a = PRIOR * (F.col("y0") + F.col("y1")) / max(n0 + n1, 1.0)
    odds = F.log((F.col("y1") + a) / (n1 + PRIOR - F.col("y1") - a)) - F.log((F.col("y0") + a) / (n0 + PRIOR - F.col("y0") - a))
    error = F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    often = counts.where("feature <> ''").where(F.col("y0") + F.col("y1") >= LEAST).where(F.col("y0") + F.col("y1") < n0 + n1).where(F.abs(odds) >= (Z - 1e-6) * error)
    rows = sorted((r.feature, r.y0, r.y1) for r in often.collect())
    model = Model(rows, n0, n1)

    def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(model.lexicon, 0.0)
        means, counts = [], Counter()
        for batch in batches:
            for text in batch["text"]:
                mean, found, numbers = model.profile(text, scores)
                means.append(mean)
                counts.update(dict(zip(found, numbers, strict=True)))
        yield pd.DataFrame({"x": means + list(counts), "n": [0] * len(means) + list(counts.values())})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = model.scores()
        for batch in batches:
            found = [model.raw(t, scores) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [n for n, _ in found], "best": [max([0.0, *s]) for _, s in found]})

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = model.scores()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "found": [model.evidence(*model.raw(t, scores)) for t in batch["text"]]})

    # the lexicon bounds the number of scores
    seen = texts.where("toxic = 0").mapInPandas(profiles, "x double, n long").collect()
    counts = Counter()
    for r in seen:
        counts[r.x] += r.n
    model.settle(sorted(r.x for r in seen if not r.n), {x: k for x, k in counts.items() if k})
    seen = sorted(map(tuple, texts.mapInPandas(best, "toxic int, n long, best double").collect()))
    model.calibrate([(n, s) for _, n, s in seen], np.array([t for t, _, _ in seen], float))
    # with the scale, a second scan has the evidence of all segments
    seen = sorted((r.toxic, list(r.found)) for r in texts.mapInPandas(evidence, "toxic int, found array<double>").collect())
    model.weigh([x for _, x in seen], np.array([t for t, _ in seen], float))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_segments.

    Null texts count as empty; a null id counts as held out. Empty texts have no
    segment and the score of such texts. Without labels of both kinds every score is
    the smoothed share of toxic labels. An empty table gives no rows.
    """
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample)

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())]))
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = model.scores()
        for batch in texts:
            yield pd.DataFrame([model.score(t, scores) for t in batch], columns=["score", "n"])

    found = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score(utf8(F.col("text"))).alias("s"))
    return found.select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.n").alias("n_segments"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic, with all their columns.

    A null text counts as empty; a null id's label is not used. Equal texts have equal scores, so
    repeated rows stay or go together; a score of 0.5 is toxic. Without labels of both kinds all
    rows have one score, the smoothed share of toxic labels. An empty table gives no rows.
    """
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))

    @F.pandas_udf(T.BooleanType())
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = model.scores()
        for batch in texts:
            yield pd.Series([model.score(t, scores)[0] < 0.5 for t in batch], dtype=bool)

    return docs.where(clean(utf8(F.col("text"))))
