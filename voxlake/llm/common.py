"""Shared pieces of the training-data operators: shared storage, splits of documents, word rules."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII space and tab..carriage return; on UTF-8 bytes this is ``bytes.split()``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs in one process (tests), a temporary folder is set; on a cluster an unset
    folder is an error, because executors do not see each other's local folders.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/voxlake-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet in the shared folder and reads them back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, size: int, per_part: int) -> int:
    """So many parts that each takes about ``per_part`` of ``size``; at least the session's number of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // per_part))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """The size of all texts in UTF-8."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


#: Keys that go to every task in a join at most, and the fewest rows that make a key hot.
HOT_KEYS, HOT_ROWS = 1000, 10_000


def join_with_hot_keys(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row per key and says in ``n`` how many of the ``total`` rows have it.

    Keys of more than a thousandth of the rows, a thousand at most, are looked up in every task; the rest joins by
    key. So no task gets all rows of a key. ``rows`` are read twice.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(table.filter(F.col(n) > least))
    cold = rows.join(F.broadcast(table.filter(F.col(n) > least).select(key)), key, "left_anti").join(table.filter(F.col(n) <= least), key)
    return rows.join(hot, key).unionByName(cold)


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null gives b''."""
    for value in column:
        text = value.as_py()
        yield text.encode("utf-8", "surrogatepass") if isinstance(text, str) else (text or b"")


#: What a worker remembers from task to task, as functions that forget it.
REMEMBERED: list[Callable[[], None]] = []


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembers: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task function in little memory, though Spark keeps its workers.

    Unless it ``remembers``, the worker first forgets what tasks of other operators left; at the end it gives freed
    memory back to the system.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            for forget in REMEMBERED:
                forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return out


def packed(array: np.ndarray) -> bytes:
    """An integer array as compressed byte planes: small numbers cost about a byte each."""
    raw = np.ascontiguousarray(array)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(raw) else b""


def unpacked(data: bytes, count: int, dtype: str) -> np.ndarray:
    """The array that ``packed`` was given."""
    size = np.dtype(dtype).itemsize
    if not count:
        return np.empty(0, dtype)
    raw = pa.decompress(data, decompressed_size=count * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, count).T).reshape(-1).view(dtype)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches as dicts; for streams of few, large rows."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(names)}
