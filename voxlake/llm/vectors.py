"""Vectors in blocks, and queries dealt to them, for the searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Whether a vector has only finite components (and one that isn't zero); null vectors are not."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    good = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)
    return good & F.exists(vector, lambda x: x != 0) if nonzero else good


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), dtype)


def parts_of(rows: DataFrame, per_part: int) -> int:
    """So many parts that each holds about ``per_part`` rows."""
    return max(1, -(-rows.count() // per_part))


def chunks(rows: DataFrame, id_col: str, vector_col: str, dtype: str, per_chunk: int, order: list[Column] | None = None) -> tuple[DataFrame, int]:
    """Vectors in chunks of about ``per_chunk`` of equal lengths, and the number of parts that the chunks come in.

    Columns: ``part`` (from 0), ``first`` (a number; those of the rows follow from it and are unique), ``dim``, ``ids``
    and ``data`` (little-endian arrays). Parts are ranges of ``order``, by default hashes of the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part, given = TaskContext.get().partitionId() % parts, 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal given
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            given += len(ids)
            values = ([part], [(part << 32) + given - len(ids)], [dim], [ids.astype("<i8").tobytes()], [np.ascontiguousarray(vectors).tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "first", "dim", "ids", "data"])

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dim)) if (lengths != dim).any() else batch
                held.setdefault(dim, []).append((own.column(0).to_numpy(), matrix(own.column(1), dtype)))
                if sum(len(ids) for ids, _ in held[dim]) >= 2 * per_chunk:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    columns = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    parts = parts_of(columns, per_chunk)
    dealt = columns.repartitionByRange(parts, *order) if order else columns.repartition(parts, "id")
    return dealt.mapInArrow(run, "part int, first long, dim long, ids binary, data binary"), parts


def unchunk(row: dict, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a chunk."""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], dtype).reshape(-1, row["dim"])


def best_of(found: DataFrame, k: int, query: tuple[str, ...] = ("query_id",), keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` best rows (largest score, then smallest vec_id) of each query, with ``rank`` from 1.

    Spark keeps k rows of a query in each task before it shuffles them.
    """
    order = Window.partitionBy(*query).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *keep)
