"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unknown one falls back to its character n-grams,
the longest first: at the first order with any known n-gram the mean log frequency of those counts as the word.
Words are runs of letters, lower-cased.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm.common import fold, lean, texts_of

#: Labelled documents of a language that the classifier is fitted on at most: those with the smallest hash of their id.
MOST_LABELLED = 5_000
#: Words, and n-grams of an order, that each language adds to the model at most, its most frequent ones; the model is broadcast.
MOST_WORDS, MOST_GRAMS = 15_000, 10_000
#: Parts of a language whose documents are ranked before the whole language's.
SALTS = 64
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word between marks of its ends; at order 1 its letters."""
    whole = word if order == 1 else f"<{word}>"
    return [whole[i : i + order] for i in range(len(whole) - order + 1)]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    grams: dict[int, dict[str, tuple[float, ...]]] = field(default_factory=dict)

    def score(self, word: str) -> tuple[float, ...]:
        """Log frequency of a word in each language; zeros if nothing of it is known."""
        found = self.words.get(word)
        if found is not None:
            return found
        for order in ORDERS:
            table = self.grams.get(order, {})
            known = [v for g in grams(word, order) if (v := table.get(g)) is not None]
            if known:
                return known[0] if len(known) == 1 else tuple([sum(x) / len(known) for x in zip(*known, strict=True)])
        return (0.0,) * len(self.languages)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(words: Counter) -> pa.RecordBatch:
        keys = list(words)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([words[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    words: Counter = Counter()
    for batch in batches:
        for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for word, n in Counter(text.split()).items():
                for run in _LETTERS.findall(word.decode("utf-8", "replace").lower()):
                    words[lang, run] += n
        if len(words) > 250_000:
            yield out(words)
            words = Counter()
    yield out(words)


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: Counter) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["lang", "order", "gram", "n"])

    found: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for order in ORDERS:
                for gram in grams(word, order):
                    found[lang, order, gram] += n
        if len(found) > 400_000:
            yield out(found)
            found = Counter()
    yield out(found)


def fit(docs: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model from at most ``most`` documents of each language whose id's fold is not 0; without any, an empty one.

    Every language has its own share of documents, words and n-grams, so a frequent one does not crowd out others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "lang")
    labelled = docs.filter("lang is not null and text is not null").filter(fold(F.col("doc_id")) != 0)
    some = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    for keys in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):  # no task gets all documents of a frequent language
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).filter(F.col("r") <= most)
    some = some.select("lang", "doc_id").distinct()
    counts = labelled.join(F.broadcast(some), ["lang", "doc_id"], "left_semi").select("text", "lang").mapInArrow(lean(_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    model = Model(sorted(totals))
    if not totals:
        counts.unpersist()
        return model
    at = {lang: i for i, lang in enumerate(model.languages)}

    def table_of(rows: list, sums: np.ndarray) -> dict[str, np.ndarray]:
        found = {}
        for r in rows:
            n = np.zeros(len(at))
            for lang, k in r.by_lang.items():
                n[at[lang]] = k
            found[r.key] = tuple((np.log(n + SMOOTHING) - np.log(sums + SMOOTHING * len(rows))).tolist())
        return found

    def top(rows: DataFrame, key: str, n: int) -> list:
        """Counts by language of the keys that are among the ``n`` most frequent ones of any language."""
        first = Window.partitionBy("lang").orderBy(F.col("n").desc(), key)
        chosen = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= n).select(key).distinct()
        return rows.join(F.broadcast(chosen), key, "left_semi").groupBy(F.col(key).alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")).collect()

    model.words = table_of(top(counts, "word", MOST_WORDS), np.array([totals[x] for x in model.languages], float))
    by_gram = counts.mapInArrow(lean(_grams_of), "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")).persist()
    for order in ORDERS:
        own = by_gram.filter(F.col("order") == order)
        sums = {r.lang: r.n for r in own.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        model.grams[order] = table_of(top(own, "gram", MOST_GRAMS), np.array([sums.get(x, 0) for x in model.languages], float))
    by_gram.unpersist()
    counts.unpersist()
    return model


class _Known(dict):
    """Place of a word of the text in a table of scores; the last column counts its runs of letters."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, len(model.languages) + 1))

    def __missing__(self, raw: bytes) -> int:
        runs = _LETTERS.findall(raw.decode("utf-8", "replace").lower())
        at = len(self)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        scores = [self.model.score(run) for run in runs]
        if scores:
            self.table[at, :-1] = scores[0] if len(scores) == 1 else [sum(x) for x in zip(*scores, strict=True)]
        self.table[at, -1] = len(runs)
        self[raw] = at
        return at


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``, one row per input row.

    The score is the posterior probability of the language under equal priors; ties go to the first name. A null
    text, or one without a letter, is ``und`` with score 0, as is every text if the model knows no language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(sent.value)
        names = known.model.languages
        for batch in batches:
            langs, scores = [], []
            for text in texts_of(batch.column(1)):
                if len(known) > 150_000:
                    known = _Known(sent.value)
                words = text.split()
                places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))  # may enlarge the table
                total = known.table[places].sum(axis=0)
                if not names or not total[-1]:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(total[:-1]))
                langs.append(names[best])
                scores.append(1 / sum(math.exp(x) for x in np.maximum(total[:-1] - total[best], -700.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return columns.mapInArrow(lean(run), "doc_id long, lang_pred string, score double")
