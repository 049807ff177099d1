"""Embedding whitening by spectral divide and conquer.

Spark sums the covariance; its eigenvectors come from polar decompositions of the shifted covariance (QR-based,
dynamically weighted Halley iteration): the polar factor of A - sI is the sign of the matrix, half of it plus the
identity projects on the eigenvectors beyond s, and both invariant subspaces are split on in the same way until single
components are left. Only matrices of the size of one vector's square come to the driver; the whitening map goes to
every task.

Components are whole numbers: x = floor(64 c) + 1000000.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import lean
from voxlake.llm.vectors import matrix, usable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Whole numbers must stay exact as doubles.
LARGEST = 2.0**52
#: Rows whose products are summed at a time.
BLOCK = 8192
EPS = np.finfo(float).eps
MOST_STEPS = 40


def polar(x: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by QDWH: for a symmetric one, its sign.

    Each step maps every singular value through the rational function that lifts the least bound most; its inverse
    comes from a QR factorisation of the matrix above the identity.
    """
    n = len(x)
    x = x / max(np.linalg.norm(x, 2), np.finfo(float).tiny)
    least = max(np.linalg.norm(x, -2) / 2, EPS / 16)  # a lower bound may be too small, never too large
    for _ in range(MOST_STEPS):
        square = least * least
        d = np.cbrt(4 * (1 - square) / (square * square))
        a = np.sqrt(1 + d) + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))) / 2
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = b / c * x + (a - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        least = min(1.0, least * (a + b * square) / (1 + c * square))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(4 * EPS) and abs(1 - least) <= 10 * EPS:
            break
    return x


def _bases(projector: np.ndarray, rank: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of its complement."""
    n = len(projector)
    first = np.linalg.qr(projector @ rng.standard_normal((n, rank)))[0]
    whole = np.linalg.qr(projector @ first, mode="complete")[0]  # a second pass mends the first basis' rounding
    return whole[:, :rank], whole[:, rank:]


def _split(a: np.ndarray, size: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces on both sides of a shift; None if all eigenvalues are alike to rounding."""
    n = len(a)
    mean = np.trace(a) / n
    if np.linalg.norm(a - mean * np.eye(n)) <= n * EPS * size:
        return None
    diagonal = np.sort(np.diag(a))
    best = None
    for shift in (np.median(diagonal), mean, *(diagonal[0] + (diagonal[-1] - diagonal[0]) * rng.random(6)), *(mean + np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n) * (rng.random(6) - 0.5))):
        sign = polar(a - shift * np.eye(n))
        projector = (sign + sign.T) / 4 + np.eye(n) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        above, below = _bases(projector, rank, rng)
        left = np.linalg.norm(above.T @ a @ below)
        if best is None or left < best[0]:
            best = (left, above, below)
        if left <= 10 * n * EPS * size:
            break
    return best and best[1:]


def _pair(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a symmetric matrix of order two: one rotation."""
    angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    return np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(a)
    a = (a + a.T) / 2
    size, rng = np.linalg.norm(a), np.random.default_rng(0)
    done: list[np.ndarray] = []
    open_ = [np.eye(n)]
    while open_:
        basis = open_.pop()
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        parts = None if len(own) <= 2 else _split(own, size, rng)
        if len(own) == 2:
            done.append(basis @ _pair(own))
        elif parts is None:
            done.append(basis)
        else:
            open_ += [basis @ part for part in parts if part.shape[1]]
    vectors = np.hstack(done) if done else np.empty((n, 0))
    vectors = np.linalg.qr(vectors)[0] if n else vectors
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    """The fitted map; ``mean`` is whole + rest, so that differences are exact before they are rounded once."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n x - S, exact; null where one leaves 64 bits."""
        off = x.astype(np.int64) - self.whole.astype(np.int64)
        rest = [s - self.n * int(w) for s, w in zip(self.sums, self.whole, strict=True)]
        most = (self.n * int(np.abs(off).max(initial=0)) + max(map(abs, rest), default=0)) ** 2 * max(1, self.dim)
        if most < 2**63:
            return ((self.n * off - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * off.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in map(int, exact)]


def _whole(column: pa.Array) -> np.ndarray:
    x = np.floor(SCALE * matrix(column, np.float64)) + SHIFT
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError("a component is too large to be a whole number of 52 bits")
    return x


def _vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    return rows.filter(usable(F.col(vector_col)))


def _summed(vectors: DataFrame, vector_col: str, dim: int, term) -> np.ndarray:
    """The sum over all vectors of a matrix that ``term`` makes of each block: a task's lines, then Spark's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _whole(batch.column(0))
            for at in range(0, len(x), BLOCK):
                own = term(x[at : at + BLOCK])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["line", "terms"])

    lines = vectors.select(vector_col).mapInArrow(lean(run), "line int, terms array<double>")
    cells = lines.select("line", F.posexplode("terms").alias("place", "term")).groupBy("line", "place").agg(F.sum("term").alias("term"))
    out = None
    for row in cells.collect():  # at most dim * dim cells
        out = np.zeros((dim, dim)) if out is None else out
        out[row.line, row.place] = row.term
    return np.zeros((dim, dim)) if out is None else out


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean, covariance (divisor n, centred before it is multiplied) and its leading components; None without vectors.

    Vectors of another length than the most frequent one (of equally frequent ones the longest) take no part.
    Components whose eigenvalue is zero to rounding can't be whitened and are left out.
    """
    vectors = _vectors(rows, vector_col)
    lengths = vectors.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if lengths is None:
        return None
    dim, n = lengths
    own = vectors.filter(F.size(vector_col) == dim)
    whole = F.transform(vector_col, lambda c: F.floor(SCALE * c.cast("double")) + SHIFT)
    cells = own.select(F.posexplode(whole).alias("place", "x")).groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    sums = [int(x) for _, x in sorted((r.place, r.x) for r in cells)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    mean, rest = np.array(middle, float), np.array([(s - n * m) / n for s, m in zip(sums, middle, strict=True)])

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - mean) - rest
        return y.T @ y

    covariance = _summed(own, vector_col, dim, products) / n
    values, axes = eigenvectors(covariance)
    kept = min(components, int((values > dim * EPS * max(values[0], 0)).sum()))
    return Whitening(n, sums, mean, rest, values[:kept], axes[:, :kept], float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest entry, by amount, of the whitened vectors' covariance minus the identity, from all vectors."""
    k = len(model.values)
    if not k:
        return 0.0
    own = _vectors(rows, vector_col).filter(F.size(vector_col) == model.dim)

    def products(x: np.ndarray) -> np.ndarray:
        w = np.hstack([model.apply(x), np.ones((len(x), 1))])
        return w.T @ w

    found = _summed(own, vector_col, k + 1, products) / model.n
    return float(np.abs(found[:k, :k] - np.outer(found[k, :k], found[k, :k]) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: the id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` is the sum over dimensions of (n x - S)**2, null where it leaves 64 bits. Vectors that are null,
    empty, of another length or hold null or non-finite components give no rows; a null id stays null; repeated rows give
    their rows each. Extra columns take no part. Components beyond 2**52 as whole numbers raise an error.
    """
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, vector_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, rows_ = _whole(part.column(1)), part.num_rows
                again = np.repeat(np.arange(rows_), k)
                columns = [
                    part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, own.n)),
                    pa.array(own.deviations(x), pa.int64()).take(pa.array(again)), pa.array(own.apply(x).reshape(-1)),
                    pa.array(np.tile(own.values / own.trace, rows_)), pa.array(np.full(rows_ * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    own = _vectors(rows, vector_col).filter(F.size(vector_col) == model.dim)
    return own.select(F.col(id_col).cast("long").alias(id_col), vector_col).mapInArrow(lean(run), schema)
