"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors are integers. A block's index holds, for each dimension, posting segments of the vectors whose component
lies in the same of at most ``LEVELS`` quantised steps around the block's centre. A query takes the segments of all
dimensions in descending impact, that is by how much a segment can raise or lower a score, and adds them to
accumulators. At threshold t every component not yet met changes a score by at most t, so the accumulators give an
upper bound of each score. The k-th best exact score met so far, first that of a bounded sample of vectors, is carried
from look to look: a vector whose upper bound stays below it is out, by proof. A search stops where scoring the rest
exactly costs less than reading on. Blocks hold vectors of like length; one whose bound stays below the carried score
is not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut
from voxlake.llm.vectors import best_of, chunks, unchunk, usable

LEVELS = 256
#: Vectors in a block and queries in a chunk, about.
BLOCK, QUERIES = 65_536, 4096
#: Vectors whose exact scores give each query its first bound: those with the smallest hash of their id.
SAMPLE = 2048
#: A look at the bounds comes after so large a share of the postings, the first one after START of these shares.
LOOKS, START = 16, 5


class Index:
    """Impact-ordered posting segments of a block of integer vectors; inner products stay below 2**52."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        n, dims = vectors.shape
        self.centre = np.round(vectors.mean(axis=0)).astype(np.int64)
        away = vectors - self.centre
        least = away.min(axis=0)
        self.step = np.maximum(1, -(-(away.max(axis=0) - least + 1) // LEVELS))
        level = np.ascontiguousarray(((away - least) // self.step).T.astype(np.uint8))
        self.low = (least[:, None] + np.arange(LEVELS) * self.step[:, None]).astype(np.float64)  # least component of a segment
        self.sizes = np.stack([np.bincount(x, minlength=LEVELS) for x in level])
        self.ends = np.concatenate([np.zeros((dims, 1), np.int64), np.cumsum(self.sizes, axis=1)], axis=1)
        self.postings = np.argsort(level, axis=1, kind="stable")
        self.values = np.stack([np.repeat(x, size) for x, size in zip(self.low, self.sizes, strict=True)])
        self.reach = np.maximum(np.abs(self.low), np.abs(self.low + self.step[:, None] - 1)) * (self.sizes > 0)
        self.longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max()))
        self.away = np.abs(away[np.random.default_rng(0).integers(0, n, 64)]).astype(np.float64)

    def bound(self, query: np.ndarray) -> float:
        """No vector of the block scores higher."""
        size = np.abs(query).astype(np.float64)
        return min(float(query @ self.centre) + float(size @ self.reach.max(axis=1)), self.longest * float(np.sqrt((size**2).sum())) * (1 + 1e-12) + 1)

    def thresholds(self, size: np.ndarray) -> list[float]:
        """Falling impacts for the looks at the bounds, as a sample of the postings has them; the last look has read all."""
        some = np.sort((self.away * size).reshape(-1))[::-1]
        return [float(some[len(some) * look // LOOKS]) for look in range(START, LOOKS)] + [-1.0]

    def search(self, query: np.ndarray, k: int, own: np.ndarray, carried: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of vectors, among them all of the best k that reach ``carried``; places ``own`` are left out."""
        n, dims = self.vectors.shape
        if self.bound(query) < carried:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.abs(query).astype(np.float64)
        impact = size[:, None] * self.reach
        most = impact.max(axis=1)
        lift = 2.0 ** (np.ceil(np.log2(most.sum() + 1)) + 2)  # a component that was met, apart from what it adds
        base = float(query @ self.centre) + float((size * (self.step - 1)).sum()) + lift * dims * 2.0**-40
        low, high = [0] * dims, [n] * dims  # postings not read yet, by dimension
        rows, sums, share = np.arange(dims), np.zeros(n), n * dims // LOOKS
        for look, threshold in enumerate(self.thresholds(size)):
            closed = (impact <= threshold) & (self.sizes > 0)
            some = closed.any(axis=1)
            to_low = np.where(some, self.ends[rows, closed.argmax(axis=1)], high).tolist()
            to_high = np.where(some, self.ends[rows, LEVELS - closed[:, ::-1].argmax(axis=1)], high).tolist()
            for d, weight in enumerate(query.tolist()):
                for start, stop in ((low[d], to_low[d]), (to_high[d], high[d])):
                    if stop > start:
                        np.add.at(sums, self.postings[d, start:stop], self.values[d, start:stop] * weight + lift)
            low, high, threshold = to_low, to_high, max(0.0, threshold)
            met = np.floor(sums / lift + 0.5)
            upper = sums - met * (lift + threshold) + float(np.minimum(most, threshold).sum()) + base
            if look in (0, 2, 5):  # the best so far, scored exactly
                best = np.argpartition(-upper, min(n - 1, 4 * k + len(own)))[: 4 * k + len(own)]
                exact = self.vectors[best[~np.isin(best, own)]] @ query
                if len(exact) >= k:
                    carried = max(carried, float(np.partition(exact, len(exact) - k)[len(exact) - k]))
            possible = np.flatnonzero(upper >= carried)
            if len(possible) * dims <= share:
                break
        possible = possible[~np.isin(possible, own)]
        return possible, self.vectors[possible] @ query


def _searched(k: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        asked = [(chunk, *unchunk(chunk, "<i8")) for chunk in queries.to_pylist()]
        for block in blocks.to_pylist():
            ids, vectors = unchunk(block, "<i8")
            index, by_id = Index(vectors), np.argsort(ids, kind="stable")
            for chunk, query_ids, rows in asked:
                if chunk["dim"] != block["dim"]:
                    continue
                carried = np.frombuffer(chunk["carried"], "<f8")
                starts, stops = (np.searchsorted(ids[by_id], query_ids, side=side) for side in ("left", "right"))
                for i, query in enumerate(rows):
                    at, scores = index.search(query, k, by_id[starts[i] : stops[i]], carried[i])
                    best = np.lexsort((ids[at], -scores))[:k]
                    out.append((np.full(len(best), chunk["first"] + i), np.full(len(best), query_ids[i]), ids[at[best]], scores[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table({name: pa.array(x.astype(np.int64)) for name, x in zip(("query", "query_id", "vec_id", "score"), columns, strict=True)})

    return run


def _carried(sample, k: int):
    """Adds to chunks of queries the k-th best exact score of the sample for each (minus infinity if it has fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for chunk in batch.to_pylist():
                query_ids, rows = unchunk(chunk, "<i8")
                found = np.full(len(rows), -np.inf)
                if chunk["dim"] in sample.value:
                    ids, vectors = sample.value[chunk["dim"]]
                    for i, (own, query) in enumerate(zip(query_ids, rows, strict=True)):
                        scores = (vectors @ query)[ids != own]
                        if len(scores) >= k:
                            found[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
                bounds.append(found.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.binary())], [*batch.schema.names, "carried"])

    return run


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` largest integer inner products, ties to smaller ids.

    Both inputs hold integer vectors; every vector but those with the query's own id is a candidate (all, if there
    are fewer than k). Null ids, null or empty vectors and vectors with null components take no part; vectors of other
    lengths do not meet. Every row of the vectors is a candidate of its own, so equal rows take a rank each. Query rows
    of equal id and vector ask once; those of equal id and other vectors ask each for themselves, with ranks from 1.
    Blocks of vectors meet chunks of queries; one task holds one of each. Empty inputs give no rows. Inputs whose
    lengths let an inner product leave 64 bits raise an error.
    """
    spark = vectors.sparkSession
    good = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    every, distinct = good(vectors), good(queries).distinct()
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    longest = [df.agg(F.max(length)).first()[0] or 0.0 for df in (every, distinct)]
    if longest[0] * longest[1] >= 2.0**126:
        raise ValueError("inner products may leave 64 bits")
    found, n_blocks = chunks(every, "id", "vector", "<i8", BLOCK, order=[length.desc(), F.xxhash64("id")])
    blocks = cut(found, "blocks")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_chunk = max(128, min(QUERIES, distinct.count() * n_blocks // tasks))
    some: dict[int, list] = {}
    for r in every.orderBy(F.xxhash64("id"), "id").limit(sample).collect():
        some.setdefault(len(r.vector), []).append(r)
    sent = spark.sparkContext.broadcast({dim: (np.array([r.id for r in rows], np.int64), np.array([r.vector for r in rows], np.int64)) for dim, rows in some.items()})
    asked, n_chunks = chunks(distinct, "id", "vector", "<i8", per_chunk)
    asked = cut(asked.mapInArrow(_carried(sent, k), "part int, first long, dim long, ids binary, data binary, carried binary"), "queries")
    each = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = each(blocks.withColumnRenamed("part", "block"), "chunk", n_chunks).groupBy("block", "chunk")
    pairs = own.cogroup(each(asked.withColumnRenamed("part", "chunk"), "block", n_blocks).groupBy("block", "chunk"))
    return best_of(pairs.applyInArrow(_searched(k), "query long, query_id long, vec_id long, score long"), k, ("query_id", "query"))
