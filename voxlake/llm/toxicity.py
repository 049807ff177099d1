"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Log-odds of a word between toxic and other labelled documents come with Dirichlet priors in proportion to the
word's share of the corpus; words whose log-odds do not stand out from their own error count as neutral. A word
that was not seen takes the log-odds of its first letters. Every word also costs a little, so that the expected
score is negative and the scores of maximal segments follow an extreme-value law in the length of the text. A
linear-time scan finds all maximal segments; those whose expected number in a text of such length is below one
add up to the document's evidence, which a logistic curve, fitted on labelled documents that gave no log-odds,
turns into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import fold, lean, texts_of

#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of their id.
MOST_LABELLED = 40_000
#: Pseudo-counts of the Dirichlet prior as a share of the labelled tokens, and what a word costs.
PRIOR, COST = 0.05, 0.2
#: Standard errors by which a token's log-odds stand out, and the least count at which they can be told.
STANDS_OUT, LEAST_COUNT = 3.5, 3
PREFIXES = (6, 5, 4)
_EDGES = re.compile(rb"^[^a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+$")


def token(word: bytes) -> bytes:
    """A lower-case word without the signs around it."""
    return _EDGES.sub(b"", word)


def prefixes(word: bytes) -> list[bytes]:
    """The tokens that stand for words with the same first letters, longest first."""
    letters = word[:32].decode("utf-8", "ignore")
    return [letters[:n].encode() + b"*" for n in PREFIXES if len(letters) > n]


@dataclass
class Model:
    """Log-odds by token and the calibration; ``slope`` and ``shift`` turn evidence into log-odds of toxicity."""

    odds: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -40.0

    def evidence(self, best: list[float], length: int) -> float:
        """asinh of the sum over segments beyond chance of lambda S - ln(K m), or that of the best one if none is."""
        base = math.log(self.k * max(1, length))
        above = [self.lam * s - base for s in best if self.lam * s > base]
        return math.asinh(sum(above) if above else self.lam * max(best, default=0.0) - base)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.shift))))


class _Scores(dict):
    """Scores of lower-case words, the cost taken off."""

    def __init__(self, odds: dict[bytes, float]) -> None:
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> float:
        if len(self) > 100_000:
            self.clear()
        bare = token(word)
        found = self.odds.get(bare)
        if found is None:
            found = next((self.odds[p] for p in prefixes(bare) if p in self.odds), 0.0)
        self[word] = found = found - COST
        return found


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint and in order; linear in the number of scores."""
    good = np.flatnonzero(scores > 0)
    if not len(good):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    breaks = np.flatnonzero(np.diff(good) > 1) + 1
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, the last entry with less before
    for run in np.split(good, breaks):
        start, end = int(run[0]), int(run[-1]) + 1
        left, right = sums[start], sums[end]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(r - s)) for a, b, s, r, _ in stack]


def _segments(text: bytes, scores: _Scores) -> tuple[int, list[tuple[int, int, float]]]:
    words = text.lower().split()
    return len(words), maximal_segments(np.fromiter(map(scores.__getitem__, words), np.float64, len(words)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each token its count in documents of either label, as far as a task has come."""

    def out(counts: dict[int, Counter]) -> pa.RecordBatch:
        tokens = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), *(pa.array([counts[k][t] for t in tokens], pa.int64()) for k in (0, 1))], ["token", "n0", "n1"])

    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = Counter(map(token, text.lower().split()))
            starts: Counter = Counter()
            for word, n in words.items():
                for start in prefixes(word):
                    starts[start] += n
            counts[label].update(words)
            counts[label].update(starts)
        if len(counts[0]) + len(counts[1]) > 250_000:
            yield out(counts)
            counts = {0: Counter(), 1: Counter()}
    yield out(counts)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts and labels of at most ``most`` rows that may be learned from; ``part`` 0 or 1 is for log-odds, 2 for calibration.

    A document with several labels counts as toxic if one of them says so.
    """
    by_doc = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    some = by_doc.filter(fold(F.col("doc_id")) != 0).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("copy")).join(F.broadcast(some.select("doc_id", "label")), "doc_id")
    once = rows.groupBy("copy", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label", F.pmod("copy", F.lit(3)).alias("part"))  # copies count once
    return docs.select("doc_id", "text").join(F.broadcast(once), "doc_id")


def _root(share: np.ndarray, scores: np.ndarray) -> float:
    """The positive lambda at which the expectation of exp(lambda score) is one."""
    low, high = 1e-6, 1.0
    value = lambda x: float(np.dot(share, np.exp(np.minimum(x * scores, 500)))) - 1
    if value(low) >= 0:
        return low
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with a weak pull towards zero."""
    scale = max(1e-9, float(np.abs(x).mean()))
    design = np.stack([np.clip(x / scale, -20, 20), np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), grad)
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model from at most ``most`` labelled documents whose id's fold is not 0. Without both labels it rejects nothing."""
    rows = _labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), labels, most)
    counts = rows.filter("part < 2").select("text", "label").mapInArrow(lean(_counts), "token binary, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    words = ~F.col("token").cast("string").endswith("*")
    counts = counts.filter((F.col("n0") + F.col("n1")) >= LEAST_COUNT)
    totals = counts.filter(words).agg(F.sum("n0"), F.sum("n1")).first()
    n0, n1 = (float(x or 0) for x in totals)
    if not n0 or not n1:
        return Model()
    pseudo = PRIOR * (n0 + n1)
    prior = PRIOR * (F.col("n0") + F.col("n1"))
    odds = F.log((F.col("n1") + prior) / (n1 + pseudo - F.col("n1") - prior)) - F.log((F.col("n0") + prior) / (n0 + pseudo - F.col("n0") - prior))
    z = odds / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    kept = counts.select("token", "n0", odds.alias("odds"), z.alias("z")).filter(F.abs("z") >= STANDS_OUT).orderBy("token").collect()  # bounded by the labelled rows
    model = Model({bytes(r.token): float(r.odds) for r in kept})
    seen = [(r.n0, r.odds - COST) for r in kept if not bytes(r.token).endswith(b"*")]
    share = np.array([n / n0 for n, _ in seen] + [max(0.0, 1 - sum(n for n, _ in seen) / n0)])
    model.lam = _root(share / share.sum(), np.array([s for _, s in seen] + [-COST]))
    odds_sent = docs.sparkSession.sparkContext.broadcast(model.odds)

    def of_texts(value):
        """Rows (m, value of the text's segments, label) of the labelled texts; a row a text, however long it is."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = _Scores(odds_sent.value)
            for batch in batches:
                found = [_segments(text, scores) for text in texts_of(batch.column(0))]
                values = [value([s for _, _, s in segments], m) for m, segments in found]
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], pa.int64()), pa.array(values, pa.float64()), batch.column(1)], ["m", "value", "label"])

        return rows.filter("part = 2").select("text", "label").mapInArrow(lean(run), "m long, value double, label int").collect()

    held = of_texts(lambda scores, m: max(scores, default=0.0))
    clean = [(r.m, r.value) for r in held if r.label == 0 and r.m]
    if not clean or len({r.label for r in held}) < 2:
        return Model()
    model.k = len(clean) / max(1e-9, sum(m * math.exp(-model.lam * s) for m, s in clean))
    law = Model(lam=model.lam, k=model.k)
    held = of_texts(law.evidence)
    model.slope, model.shift = _logistic(np.array([r.value for r in held]), np.array([r.label for r in held], float))
    return model


_SEGMENTS = "array<struct<start:int,end:int,score:double,expected:double>>"


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc`` (struct of the input's columns, the text only with ``keep_text``), ``score``, ``predicted`` and ``passages``.

    One row per input row. Passages are the maximal segments, as word places and score, with their expected number
    in a text of that length below one. Null and empty texts have no words and get the score of no evidence.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[c for c in docs.columns if keep_text or c != text_col]).alias("doc"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        scores = _Scores(fitted.odds)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            found, passages = [], []
            for text in texts_of(batch.column(1)):
                m, segments = _segments(text, scores)
                found.append(fitted.probability(fitted.evidence([s for _, _, s in segments], m)))
                expected = [fitted.k * max(1, m) * math.exp(-min(700.0, fitted.lam * s)) for _, _, s in segments]
                passages.append([{"start": a, "end": b, "score": s, "expected": e} for (a, b, s), e in zip(segments, expected, strict=True) if e < 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([int(p >= 0.5) for p in found], pa.int32()), pa.array(passages, kind)], ["doc", "score", "predicted", "passages"])

    return rows.mapInArrow(lean(run), f"doc {rows.schema['doc'].dataType.simpleString()}, score double, predicted int, passages {_SEGMENTS}")
