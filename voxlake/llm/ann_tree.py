"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The upper part of the tree, the trunk, is fitted on a bounded sample and goes to every task; its ends are limbs. Each
limb's vectors are split further on their own in Spark, until leaves hold about ``LEAF`` vectors, whatever the size of
the table. A bin's priority for a query is the inner product with its centre plus gamma times its radius times the
query's length, so that wide bins are not passed over. A query leaves the priority queue when the best bin left has
less than the query's mark, the ``MARK``-th best score among a small sample. Gamma is calibrated: it widens until
calibration queries, whose true neighbours come from brute force over the whole table, find the wanted share of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm.common import cut
from voxlake.llm.vectors import best_of, matrix, usable

#: Vectors that the trunk is fitted on at most, and those among them that give a query's mark: the smallest hashes of ids.
SAMPLE, MARKS, MARK = 20_000, 2048, 5
#: Vectors in a limb, about, and limbs, about, at most.
LIMB, LIMBS = 1000, 1000
BRANCHES, LEAF, ROUNDS = 8, 12, 8
#: Share of true neighbours that the calibration asks for, the share that limbs alone may lose, calibration queries.
RECALL, LOST, CALIBRATION = 0.93, 0.01, 300
#: Vectors and queries that one task compares, about.
BLOCK, CROWD = 4096, 4096


@dataclass
class Tree:
    """Nodes with centres and radii (root mean square of distances); an end has a number, other nodes have children."""

    centres: np.ndarray
    radii: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The end of each vector: at every node the nearest child."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            nearest = _nearest(vectors[rows], self.centres[kids])
            todo += [(kid, rows[nearest == i]) for i, kid in enumerate(kids) if (nearest == i).any()]
        return out

    def best_bins(self, query: np.ndarray, mark: float, gamma: float) -> list[int]:
        """Ends in the order of a best-bin-first traversal, as far as bins reach the mark."""
        priority = -(self.centres @ query + gamma * self.radii * np.sqrt(query @ query))
        queue, out = [(-np.inf, 0)], []
        while queue:
            low, node = heapq.heappop(queue)
            if low > -mark:
                break
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (float(priority[kid]), kid))
        return out

    def needed(self, queries: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """For each query and end the least gamma with which the traversal comes to the end."""
        need = _gamma(queries, marks, self.centres, self.radii)
        need[:, 0] = -np.inf
        for node, kids in enumerate(self.children):  # parents come before their children
            for kid in kids:
                need[:, kid] = np.maximum(need[:, kid], need[:, node])
        ends = np.array(self.leaf)
        return need[:, np.flatnonzero(ends >= 0)[np.argsort(ends[ends >= 0])]]


def _gamma(queries: np.ndarray, marks: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The gamma with which each bin just reaches each query's mark."""
    lengths = np.sqrt((queries**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((marks[:, None] - queries @ centres.T) / (lengths[:, None] * radii), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * vectors @ centres.T, axis=1)


def grow(vectors: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 0, least_radius: float | None = None) -> Tree:
    """A tree over vectors: k-means splits nodes until they hold ``leaf`` vectors or nothing tells them apart.

    Radii are at least ``least_radius``, by default a tenth of the whole's.
    """
    rng = np.random.default_rng(seed)
    centres, children, number = [vectors.mean(axis=0)], [[]], [-1]
    todo, members, ends = [(0, np.arange(len(vectors)))], {0: np.arange(len(vectors))}, 0
    while todo:
        node, rows = todo.pop()
        own = vectors[rows]
        parts = []
        if len(rows) > leaf:
            means = own[rng.choice(len(own), min(branches, -(-2 * len(own) // leaf)), replace=False)]
            means = np.unique(means, axis=0)
            if len(means) < 2:
                distinct = np.unique(own, axis=0)
                means = distinct[rng.choice(len(distinct), min(branches, len(distinct)), replace=False)]
            for _ in range(ROUNDS):
                nearest = _nearest(own, means)
                means = np.stack([own[nearest == i].mean(axis=0) if (nearest == i).any() else means[i] for i in range(len(means))])
            nearest = _nearest(own, means)
            parts = [i for i in range(len(means)) if (nearest == i).any()]
        if len(parts) < 2:
            number[node] = ends
            ends += 1
            continue
        for i in parts:
            children[node].append(len(centres))
            members[len(centres)] = rows[nearest == i]
            todo.append((len(centres), rows[nearest == i]))
            centres.append(means[i])
            children.append([])
            number.append(-1)
    middle = np.stack(centres)
    radii = np.array([np.sqrt(((vectors[members[i]] - middle[i]) ** 2).sum(axis=1).mean()) for i in range(len(middle))])
    return Tree(middle, np.maximum(radii, radii[0] / 10 if least_radius is None else least_radius), children, number)


@dataclass
class Trunk:
    """What every task knows: the tree's upper part, where limbs lie, the vectors that give marks and the calibration."""

    tree: Tree
    mark_ids: np.ndarray
    mark_vectors: np.ndarray
    first_block: np.ndarray | None = None
    blocks: np.ndarray | None = None  # blocks of a limb, from the first one
    gamma_limb: float = np.inf
    gamma_leaf: float = np.inf

    def marks(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Each query's ``MARK``-th best score among the vectors for it, its own left out; minus infinity if there are fewer."""
        scores = queries @ self.mark_vectors.T
        scores[ids[:, None] == self.mark_ids[None, :]] = -np.inf
        return np.partition(scores, -MARK, axis=1)[:, -MARK] if scores.shape[1] >= MARK else np.full(len(ids), -np.inf)


def _few_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of equal vectors those that can be among the k best of any query, ties going to smaller ids."""
    groups: dict[bytes, list[int]] = {}
    for i, vector in enumerate(vectors):
        groups.setdefault(vector.tobytes(), []).append(i)
    if len(groups) == len(ids):
        return np.arange(len(ids))
    kept: list[int] = []
    for rows in groups.values():
        if len(rows) > k:  # at most k rows of an id, so that k of other ids are left beside any query's own
            rows.sort(key=lambda i: ids[i])
            own = ids[rows]
            rows = np.array(rows)[np.arange(len(own)) - np.searchsorted(own, own) < k][: 2 * k].tolist()
        kept += rows
    return np.sort(np.array(kept, np.int64))


def _limbs_of(trunk):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                limbs, n = np.unique(trunk.value.tree.assign(matrix(batch.column(1), np.float64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(limbs), pa.array(n)], ["limb", "n"])

    return run


def _dealt(trunk, k: int):
    """The block of each vector: that of its limb, or one of them by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).to_numpy(), matrix(batch.column(1), np.float64) + 0.0  # no negative zeros
            kept = _few_copies(ids, vectors, k)
            ids, vectors, spread = ids[kept], vectors[kept], batch.column(2).to_numpy()[kept]
            limbs = trunk.value.tree.assign(vectors)
            block = trunk.value.first_block[limbs] + spread % trunk.value.blocks[limbs]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(limbs), pa.array(ids), pa.array([v.tobytes() for v in vectors], pa.binary())], ["block", "limb", "id", "vector"])

    return run


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def _split(trunk, k: int, leaf: int):
    """Leaves of a block: each of its limbs is split further on its own vectors."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("id").to_numpy(), table.column("limb").to_numpy()))
        limbs, ids, vectors = (x[order] for x in (table.column("limb").to_numpy(), table.column("id").to_numpy(), _rows(table.column("vector"))))
        kept = _few_copies(ids, vectors, k)
        limbs, ids, vectors = limbs[kept], ids[kept], vectors[kept]
        found = []
        for limb in np.unique(limbs):
            own_ids, own = ids[limbs == limb], vectors[limbs == limb]
            tree = grow(own, leaf=leaf, least_radius=trunk.value.tree.radii.min())
            ends = tree.assign(own)
            at = {number: node for node, number in enumerate(tree.leaf) if number >= 0}
            for end in np.unique(ends):
                rows = ends == end
                found.append((int(limb), int(rows.sum()), tree.centres[at[end]].tobytes(), float(tree.radii[at[end]]), own_ids[rows].astype("<i8").tobytes(), own[rows].tobytes()))
        block = table.column("block")[0].as_py()
        columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.binary()), strict=True)]
        return pa.Table.from_arrays([pa.array([block] * len(found), pa.int64()), *columns], ["block", "limb", "n", "centre", "radius", "ids", "data"])

    return run


def _true_neighbours(sent, k: int):
    """Of the calibration queries the k best vectors of a task by brute force, with what gamma their limb and leaf need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, queries, marks, limb_need = sent.value
        held = [np.empty((len(queries), 0)) for _ in range(4)]  # score, id, need of the limb, need of the leaf
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {name: batch.column(name) for name in batch.schema.names}
            n = table["n"].to_numpy()
            ids, vectors = np.frombuffer(b"".join(table["ids"].to_pylist()), "<i8"), np.frombuffer(b"".join(table["data"].to_pylist()), "<f8").reshape(n.sum(), -1)
            need = _gamma(queries, marks, _rows(table["centre"]), table["radius"].to_numpy())
            scores = queries @ vectors.T
            scores[ids_of[:, None] == ids[None, :]] = -np.inf
            new = [scores, np.broadcast_to(ids.astype(float), scores.shape), np.repeat(limb_need[:, table["limb"].to_numpy()], n, axis=1), np.repeat(need, n, axis=1)]
            held = [np.concatenate(x, axis=1) for x in zip(held, new, strict=True)]
            if held[0].shape[1] > k:
                best = np.argpartition(-held[0], k - 1, axis=1)[:, :k]
                held = [np.take_along_axis(x, best, axis=1) for x in held]
        query = np.repeat(np.arange(len(queries)), held[0].shape[1])
        score, vec_id, limb, leaf = (x.reshape(-1) for x in held)
        ok = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (query, score, vec_id, limb, leaf)], ["query", "score", "vec_id", "limb", "leaf"])

    return run


def calibrate(trunk: Trunk, leaves: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, recall: float) -> None:
    """Sets the least gammas with which the queries find ``recall`` of their k true neighbours in all leaves."""
    marks = trunk.marks(ids, queries)
    sent = leaves.sparkSession.sparkContext.broadcast((ids, queries, marks, trunk.tree.needed(queries, marks)))
    found = leaves.select("limb", "n", "centre", "radius", "ids", "data").mapInArrow(_true_neighbours(sent, k), "query long, score double, vec_id double, limb double, leaf double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    true = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("limb", "leaf").toArrow()
    limb, leaf = (np.sort(true.column(name).to_numpy()) for name in ("limb", "leaf"))
    if not len(limb):
        return
    trunk.gamma_limb = float(limb[min(len(limb) - 1, int(np.ceil((1 - LOST) * len(limb))))])
    reached = np.sort(true.column("leaf").to_numpy()[true.column("limb").to_numpy() <= trunk.gamma_limb])
    trunk.gamma_leaf = float(reached[min(len(reached), int(np.ceil(recall * len(leaf)))) - 1])


def _visits(trunk, widest: bool):
    """A row for each query and block that holds a limb which the query comes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trunk.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                queries = matrix(batch.column(1), np.float64)
                marks = np.full(len(queries), -np.inf) if widest else known.marks(batch.column(0).to_numpy(), queries)
                to = []
                for query, mark in zip(queries, marks.tolist(), strict=True):
                    limbs = known.tree.best_bins(query, mark, known.gamma_limb)
                    to.append(np.unique(np.concatenate([np.arange(known.first_block[x], known.first_block[x] + known.blocks[x]) for x in limbs])) if limbs else np.empty(0, np.int64))
                rows = np.repeat(np.arange(len(queries)), [len(x) for x in to])
                if len(rows):
                    vectors = pa.array([q.tobytes() for q in queries], pa.binary())
                    values = [pa.array(np.concatenate(to).astype(np.int64)), *(x.take(pa.array(rows)) for x in (batch.column(0), batch.column(2), vectors, pa.array(marks)))]
                    yield pa.RecordBatch.from_arrays(values, ["block", "query_id", "query", "vector", "mark"])

    return run


def _compared(k: int, trunk, at_once: int = 512):
    def run(leaves: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if leaves.num_rows and queries.num_rows:
            n = leaves.column("n").to_numpy()
            ends = np.cumsum(n)
            ids, vectors = np.frombuffer(b"".join(leaves.column("ids").to_pylist()), "<i8"), np.frombuffer(b"".join(leaves.column("data").to_pylist()), "<f8").reshape(ends[-1], -1)
            centres, radii = _rows(leaves.column("centre")), leaves.column("radius").to_numpy()
            all_ids, all_numbers, all_marks, every = queries.column("query_id").to_numpy(), queries.column("query").to_numpy(), queries.column("mark").to_numpy(), _rows(queries.column("vector"))
            for a in range(0, len(every), at_once):
                asked, own, numbers = every[a : a + at_once], all_ids[a : a + at_once], all_numbers[a : a + at_once]
                visit = _gamma(asked, all_marks[a : a + at_once], centres, radii) <= trunk.value.gamma_leaf
                rough = np.full((len(asked), len(ids)), -np.inf)
                for leaf in np.flatnonzero(visit.any(axis=0)).tolist():
                    rows = np.flatnonzero(visit[:, leaf])
                    rough[rows, ends[leaf] - n[leaf] : ends[leaf]] = asked[rows] @ vectors[ends[leaf] - n[leaf] : ends[leaf]].T
                rough[own[:, None] == ids[None, :]] = -np.inf
                least = np.partition(rough, len(ids) - k, axis=1)[:, [len(ids) - k]] if len(ids) > k else np.full((len(asked), 1), -np.inf)
                with np.errstate(invalid="ignore"):
                    near = np.isfinite(rough) & ~(rough < least - 1e-9 * (1 + np.abs(least)))
                query, place = np.nonzero(near)
                exact = np.zeros(len(query))
                for d in range(asked.shape[1]):  # in the order of components, so equal vectors score alike everywhere
                    exact += vectors[place, d] * asked[query, d]
                order = np.lexsort((ids[place], -exact, query))
                query, place, exact = query[order], place[order], exact[order]
                best = np.arange(len(query)) - np.searchsorted(query, query) < k
                out.append((numbers[query[best]], own[query[best]], ids[place[best]], exact[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table(dict(zip(("query", "query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))

    return run


def _search(leaves: DataFrame, asked: DataFrame, sent, k: int, crowds: int, widest: bool = False) -> DataFrame:
    visits = asked.mapInArrow(_visits(sent, widest), "block long, query_id long, query long, vector binary, mark double").withColumn("crowd", F.pmod("query", F.lit(crowds)).cast("int"))
    own = leaves.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))
    pairs = own.groupBy("block", "crowd").cogroup(visits.groupBy("block", "crowd"))
    return pairs.applyInArrow(_compared(k, sent), "query long, query_id long, vec_id long, score double")


def _of_one_length(every: DataFrame, asked: DataFrame, k: int, sample: int, recall: float, leaf: int) -> DataFrame:
    spark = every.sparkSession
    some = every.select("id", "vector", F.xxhash64("id").alias("h")).orderBy("h", "id", "vector").limit(sample).toArrow()
    ids, vectors = some.column("id").to_numpy(), matrix(some.column("vector"), np.float64)
    n = every.count()
    trunk = Trunk(grow(vectors, leaf=max(1, -(-len(ids) // min(LIMBS, -(-n // LIMB))))), ids[:MARKS], vectors[:MARKS])
    sent = spark.sparkContext.broadcast(trunk)
    sizes = np.ones(trunk.tree.leaves, np.int64)
    for r in every.mapInArrow(_limbs_of(sent), "limb long, n long").groupBy("limb").agg(F.sum("n").alias("n")).collect():
        sizes[r.limb] = r.n
    trunk.blocks = -(-sizes // BLOCK)
    first, n_blocks, filled = [], 0, BLOCK
    for size, parts in zip(sizes.tolist(), trunk.blocks.tolist(), strict=True):
        if parts > 1 or filled + size > BLOCK:  # else the limb shares the block of the one before it
            first.append(n_blocks)
            n_blocks, filled = n_blocks + parts, size if parts == 1 else BLOCK
        else:
            first.append(n_blocks - 1)
            filled += size
    trunk.first_block = np.array(first)
    sent = spark.sparkContext.broadcast(trunk)
    dealt = every.withColumn("spread", F.pmod(F.xxhash64("vector", "id"), F.lit(1 << 31))).mapInArrow(_dealt(sent, k), "block long, limb long, id long, vector binary")
    leaves = cut(dealt.groupBy("block").applyInArrow(_split(sent, k, leaf), "block long, limb long, n long, centre binary, radius double, ids binary, data binary"), "leaves")
    own = slice(MARKS, MARKS + CALIBRATION) if len(ids) > MARKS + CALIBRATION else slice(0, CALIBRATION)
    calibrate(trunk, leaves, ids[own], vectors[own], k, recall)
    sent = spark.sparkContext.broadcast(trunk)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_asked = asked.count()
    crowds = max(1, -(-n_asked // CROWD), min(n_asked // 256, tasks // n_blocks))
    found = cut(best_of(_search(leaves, asked, sent, k, crowds), k, ("query_id", "query"), keep=("query",)), "found")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "query")
    short = cut(asked.join(full, ["id", "query"], "left_anti").select("id", "vector", "query"), "short")
    if not short.limit(1).count():
        return found.drop("query")
    # fewer than k found: all leaves
    rest = best_of(_search(leaves, short, sent, k, crowds, widest=True), k, ("query_id", "query"), keep=("query",))
    done = found.join(short.select(F.col("id").alias("query_id"), "query"), ["query_id", "query"], "left_anti")
    return done.unionByName(rest).drop("query")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` largest inner products found, ties to smaller ids.

    Every vector but those with the query's own id is a candidate. Null ids, null, empty or zero vectors and those with
    null or non-finite components take no part; vectors of different lengths do not meet, each length is searched by
    itself. Every row is a candidate of its own, so equal rows take a rank each; query rows of equal id and vector ask
    once, those of equal id and other vectors each for themselves, with ranks from 1. A query that finds fewer than
    ``k`` visits all leaves. Empty inputs give no rows.
    """
    spark = vectors.sparkSession
    good = lambda df: df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col), nonzero=True)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    every, asked = good(vectors), good(queries).distinct().withColumn("query", F.xxhash64("vector"))
    lengths = [r.n for r in every.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    found = [_of_one_length(every.filter(F.size("vector") == n), asked.filter(F.size("vector") == n), k, sample, recall, leaf) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
