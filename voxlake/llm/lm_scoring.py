"""Language-model scores: subword lattice likelihood over an existing piece vocabulary.

The vocabulary's own scores are ranks. A rank law, p proportional to (rank + q)**-s, turns them into normalised
log-probabilities; q and s are fitted to the pieces of all training documents, so the law is learned from the corpus
and the order of the pieces is the vocabulary's. These weigh every segmentation: a word's probability is the sum over
all its segmentations into pieces, by a forward recursion in log space; no piece crosses a word's start, so a text's
marginal probability is the product over its words and its end. Two options learn more from the training documents:
``learn_pieces`` refits each piece to its count in training, with the law as prior, and ``word_arcs`` adds an arc over
each word of training with its relative frequency, by Witten-Bell weights. The query takes both: pieces of a vocabulary
made for other text are a weak model by their ranks alone.

Every word of the corpus is counted and scored once. Words are joined to documents in two ways: the ``HOT_WORDS`` most
frequent ones go to every task, the rest meets the occurrences of each document in a join by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut, fold, lean, parts_for, texts_of

#: Words that go to every task, with their count and log-probability.
HOT_WORDS = 200_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Pseudo-counts of the law where pieces are refitted.
PRIOR = 100_000.0
#: Offsets of the rank law that are tried, and the largest exponent.
OFFSETS, STEEPEST = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10_000.0), 8.0
SPACE = "▁"
#: Bytes of text, about, whose words one task takes in a shuffle.
PART_BYTES = 16_000_000


def base_term(count, total: float, distinct: float):
    """(c + 0.5) / (N + 0.5 (V + 1)) for a column of counts."""
    return F.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(trained: Counter, other: Counter) -> pa.RecordBatch:
        words = list(trained.keys() | other.keys())
        learned = [trained[w] for w in words]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([n + other[w] for n, w in zip(learned, words, strict=True)], pa.int64()), pa.array(learned, pa.int64())], ["word", "n_all", "n"])

    trained: Counter = Counter()
    other: Counter = Counter()
    for batch in batches:
        for text, train in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            (trained if train else other).update(text.lower().split())
            if len(trained) + len(other) > COUNTED:
                yield out(trained, other)
                trained, other = Counter(), Counter()
    yield out(trained, other)


def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """``word``, ``n_all`` (in all documents) and ``n`` (in those with ``train``), from ``text`` and ``train``; tasks count first."""
    counts = docs.select("text", "train").mapInArrow(lean(_word_counts), "word binary, n_all long, n long")
    return counts.repartition(parts, "word").groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def _vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        totals = np.zeros(vocabulary.get_piece_size(), np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in texts_of(batch.column(0))]
            for ids, n in zip(vocabulary.encode(words, num_threads=1), batch.column(1).to_pylist(), strict=True):
                np.add.at(totals, ids, n)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(totals[at])], ["piece", "n"])

    return run


def rank_law(ranks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-probabilities -s log(rank + q) + const that make the counts likeliest; without counts s is 1 and q is 3."""

    def logs(s: float, q: float) -> np.ndarray:
        out = -s * np.log(ranks + q)
        return out - np.log(np.exp(out - out.max()).sum()) - out.max()

    if not counts.sum():
        return logs(1.0, 3.0)
    share, found = counts / counts.sum(), []
    for q in OFFSETS:
        x = np.log(ranks + q)
        wanted, low, high = float(share @ x), 0.0, STEEPEST
        for _ in range(50):  # the mean of log(rank + q) falls with s until it is the counts'
            mid = (low + high) / 2
            low, high = (mid, high) if float(np.exp(logs(mid, q)) @ x) > wanted else (low, mid)
        found.append(logs((low + high) / 2, q))
    return max(found, key=lambda x: float(share @ x))


class Lattice:
    """Log-probabilities of pieces from the vocabulary's scores; ``word(w)`` sums over all segmentations of a word."""

    def __init__(self, path: str, counts: dict[int, int], ends: int, learn_pieces: bool = False) -> None:
        vocabulary = _vocabulary(path)
        size = vocabulary.get_piece_size()
        usable = [i for i in range(size) if not vocabulary.is_control(i) and not vocabulary.is_unknown(i)]
        # bytes stand in for letters without a piece and have no score of their own: the last rank, like unused pieces
        ranks = np.array([size if vocabulary.is_byte(i) else min(size, max(0.0, -vocabulary.get_score(i))) for i in usable], float)
        n = np.array([counts.get(i, 0) for i in usable], float)
        logs = rank_law(ranks, n)
        if learn_pieces:
            logs = np.log((n + PRIOR * np.exp(logs)) / (n.sum() + PRIOR))
        end = (ends + 0.5) / (n.sum() + ends + 1)
        logs = logs + math.log(1 - end)
        self.end = math.log(end)
        names = [vocabulary.id_to_piece(i) for i in usable]
        self.bytes = {int(name[3:5], 16): float(p) for i, name, p in zip(usable, names, logs, strict=True) if vocabulary.is_byte(i)}
        self.pieces = {name: float(p) for i, name, p in zip(usable, names, logs, strict=True) if not vocabulary.is_byte(i)}
        self.longest = max(map(len, self.pieces), default=1)

    def word(self, word: bytes) -> float:
        """Natural log of the word's probability by pieces, all segmentations weighed; letters without a piece go by their bytes."""
        text = SPACE + word.decode("utf-8", "replace")
        pieces, longest, n = self.pieces, self.longest, len(text)
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for end in range(1, n + 1):
            ways = [alpha[start] + p for start in range(max(0, end - longest), end) if (p := pieces.get(text[start:end])) is not None]
            if text[end - 1] not in pieces:
                ways.append(alpha[end - 1] + sum(self.bytes[b] for b in text[end - 1].encode()))
            if len(ways) == 1:
                alpha[end] = ways[0]
            elif ways:
                top = max(ways)
                alpha[end] = top + math.log(sum([math.exp(x - top) for x in ways]))
        return alpha[n]


def _partials(hot, end_log10: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))
        for batch in batches:
            n_tokens, n_known, base, score, rare = [], [], [], [], []
            for text in texts_of(batch.column(1)):
                words = Counter(text.lower().split())
                found, b, s, left = 0, 0.0, end_log10, []
                for word, k in words.items():
                    entry = known.get(word)
                    if entry is None:
                        left.append({"word": word, "k": k})
                    else:
                        found += k * entry[0]
                        b += k * entry[1]
                        s += k * entry[2]
                n_tokens.append(words.total() + 1)
                n_known.append(found)
                base.append(b)
                score.append(s)
                rare.append(left)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, kind)], ["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    return run


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, hot_words: int = HOT_WORDS, learn_pieces: bool = False, word_arcs: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10), one row per input row.

    Learns from the documents whose id's fold isn't ``held_out``. Tokens are lower-cased (A-Z) words and one end per
    text; null texts are empty and have the end alone. Equal rows get equal scores. Without training documents every
    count is 0 and the pieces follow Zipf's law. Shuffles have as many parts as the size of the texts asks for.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.withColumn("train", fold(F.col("doc_id")) != held_out)
    whole = rows.agg(F.count_if("train").alias("ends"), F.sum(F.octet_length("text")).alias("size")).first()
    ends, parts = whole.ends, parts_for(spark, whole.size or 0, PART_BYTES)
    counts = cut(word_counts(rows, parts), "counts")
    sums = counts.filter("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    pieces = counts.filter("n > 0").select("word", "n").mapInArrow(_piece_counts(vocabulary), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    lattice = spark.sparkContext.broadcast(Lattice(vocabulary, {r.piece: r.n for r in pieces.collect()}, ends, learn_pieces))

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = lattice.value.word
        for batch in batches:
            logs = pa.array([word(w) / math.log(10) for w in texts_of(batch.column(0))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, logs], [*batch.schema.names, "score"])

    score_of, end_score = F.col("score"), lattice.value.end / math.log(10)
    if word_arcs:
        by_pieces = (distinct + 1) / (total + distinct + 1)
        score_of = F.when(F.col("n") > 0, F.log10((1 - by_pieces) * F.col("n") / max(1, total) + by_pieces * F.pow(F.lit(10.0), "score"))).otherwise(F.col("score") + math.log10(by_pieces))
        end_score = math.log10((1 - by_pieces) * ends / max(1, total) + by_pieces * math.exp(lattice.value.end))
    scored = counts.repartition(parts).mapInArrow(probabilities, "word binary, n_all long, n long, score double")
    known = cut(scored.select("word", "n_all", (F.col("n") > 0).cast("int").alias("known"), base_term(F.col("n"), total, distinct).alias("base"), score_of.alias("score")), "words")
    top = known.orderBy(F.col("n_all").desc(), "word").limit(hot_words).select("word", "known", "base", "score").toArrow()
    hot = spark.sparkContext.broadcast({w: (k, b, s) for w, k, b, s in zip(*(c.to_pylist() for c in top.columns), strict=True)})
    end_base = math.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))
    partial = rows.select("doc_id", "text").mapInArrow(lean(_partials(hot, end_score)), "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,k:long>>")
    partial = cut(partial.withColumn("row", F.monotonically_increasing_id()), "partials")
    rare = partial.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").repartition(parts, "word")
    found = rare.join(known.drop("n_all").repartition(parts, "word"), "word").select("row", *[(F.col("k") * F.col(name)).alias(name) for name in ("known", "base", "score")])
    found = found.repartition(parts, "row").groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    out = partial.drop("rare").repartition(parts, "row").join(found, "row", "left").na.fill(0, ["more_known"]).na.fill(0.0, ["more_base", "more_score"])
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.col("more_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("more_base") + F.lit(end_base)).alias("base_score"), (F.col("score") + F.col("more_score")).alias("score"))
