"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A record is: length of the data (u64), masked checksum of those eight bytes (u32), the data, masked checksum of the
data (u32), all little-endian. The checksum is CRC-32 (zlib's), rotated right by 15 bits plus a constant, so that
data which holds checksums doesn't check itself. The data: a flag byte (1: null id, 2: ids of four bytes, else
two), the document's id (i64) and its token ids. The index of a file lists offset, id and token count of each
record, for reads in any order. Files hold ranges of ids; within and across files ids ascend. Texts are ranged and
sorted by Spark before they are encoded, so that each task writes the files of its range in order.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm.common import cut, fresh_path, lean, parts_for, text_bytes, texts_of
from voxlake.llm.tokens import as_u32, encoder
from voxlake.sources.stores import open_store

#: Bytes of text whose records a file holds, about, and bytes of a file at which the next one begins.
FILE_BYTES, FULL_BYTES = 8_000_000, 64_000_000
#: Bytes of text, or of ids, that a task takes at most, so that very large tables have no more ranges than they need.
TASK_BYTES = 1_000_000_000
_MASK, _MAGIC = 0xA282EAD8, b"VXIX1\n"
_NULL_ID, _WIDE = 1, 2


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join([length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))])


def unframe(buffer: memoryview | bytes, at: int) -> tuple[bytes, int]:
    """The data of the record at a place and the place after it; ValueError if a checksum or the length is wrong."""
    head = bytes(buffer[at : at + 12])
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
        raise ValueError(f"damaged length at {at}")
    end = at + 12 + struct.unpack_from("<Q", head)[0]
    data, tail = bytes(buffer[at + 12 : end]), bytes(buffer[end : end + 4])
    if len(tail) < 4 or struct.unpack("<I", tail)[0] != masked(data):
        raise ValueError(f"damaged record at {at}")
    return data, end + 4


def record(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = ids.dtype.itemsize == 4
    return struct.pack("<Bq", (doc_id is None) * _NULL_ID | wide * _WIDE, doc_id or 0) + ids.tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", data)
    return None if flags & _NULL_ID else doc_id, np.frombuffer(data, "<u4" if flags & _WIDE else "<u2", offset=9)


def load_index(uri: str) -> dict[str, np.ndarray]:
    """``offset``, ``doc_id`` and ``n_tokens`` of each record of a file, from its index."""
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        data = file.read()
    if data[: len(_MAGIC)] != _MAGIC or struct.unpack("<I", data[-4:])[0] != masked(data[:-4]):
        raise ValueError(f"damaged index {uri}")
    n = struct.unpack_from("<Q", data, len(_MAGIC))[0]
    return dict(zip(("offset", "doc_id", "n_tokens"), np.frombuffer(data, "<i8", 3 * n, len(_MAGIC) + 8).reshape(3, n), strict=True))


def read_at(uri: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record, by its offset from the index."""
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        file.seek(offset)
        head = file.read(12)
        body = file.read(struct.unpack_from("<Q", head)[0] + 4) if len(head) == 12 else b""
    return parse(unframe(head + body, 0)[0])


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: a path without one lies in Hadoop's default file system, for executors as for Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!//)", "file:///", found)


def _written(folder: str, tokenizer: str, end_id: int, full: int):
    """Rows come by id. A file is written under the attempt's own name and then moved, so attempts don't meet."""

    def close(number: int, chunks: list[bytes], index: list[tuple[int, int, int]]) -> pa.RecordBatch:
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        table = np.array(index, "<i8").reshape(-1, 3).T
        head = _MAGIC + struct.pack("<Q", table.shape[1]) + np.ascontiguousarray(table).tobytes()
        stem = f"part-{number >> 20:08d}-{number & 0xFFFFF:06d}-{attempt}"
        for suffix, data in ((".rec", chunks), (".idx", [head, struct.pack("<I", masked(head))])):
            with store.open_output_stream(f"{path}/{stem}{suffix}.tmp") as file:
                for chunk in data:
                    file.write(chunk)
            store.move(f"{path}/{stem}{suffix}.tmp", f"{path}/{stem}{suffix}")
        uri = f"{folder}/{stem}"
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([f"{uri}.rec"]), pa.array([f"{uri}.idx"]), pa.array([len(index)], pa.int64()), pa.array([int(table[2].sum())], pa.int64())], ["file", "records", "index", "n_docs", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        number, chunks, index, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 20, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = np.append(own.encode(text), own.dtype.type(end_id))
                chunks.append(frame(record(doc_id, ids)))
                index.append((size, doc_id or 0, len(ids)))
                size += len(chunks[-1])
                if size >= full:
                    yield close(number, chunks, index)
                    number, chunks, index, size = number + 1, [], [], 0
        if index:
            yield close(number, chunks, index)

    return run


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, full: int = FULL_BYTES) -> DataFrame:
    """Writes the token ids of every document, in ascending order of ids, and returns the manifest.

    Manifest: ``file``, ``records`` and ``index`` (places), ``n_docs``, ``n_tokens`` and ``start`` (ids in all files
    before). Null texts are empty, null ids come first, equal ids follow each other in the order of their texts'
    hashes, so very many of them lie in several files. The manifest is written too, so files of lost attempts are
    never read. No rows give no files.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder or fresh_path(spark, "records"))
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = text_bytes(columns)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a task writes as many files as its range fills; little text still goes to several tasks
    files = max(1, -(-size // TASK_BYTES), min(tasks, -(-8 * size // file_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = columns.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    manifest = cut(ordered.mapInArrow(lean(_written(folder, tokenizer, end_id, full), remembers=True), "file long, records string, index string, n_docs long, n_tokens long"), "manifest")
    # sums of a thousand files each first, so that no task counts all files
    groups = manifest.groupBy(F.expr("file div 1048576 div 1000").alias("group")).agg(F.sum("n_tokens").alias("n"))
    before = groups.select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("group", F.expr("file div 1048576 div 1000")).withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(before, "group").select(*manifest.columns, (F.col("start") + F.col("before")).cast("long").alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, path = open_store(uri)
            with store.open_input_file(path) as file:
                data = memoryview(file.read())
            at, ids, starts, sizes, crcs = 0, [], [], [], []
            while at < len(data):
                body, at = unframe(data, at)
                doc_id, tokens = parse(body)
                ids.append(doc_id)
                starts.append(start)
                sizes.append(len(tokens))
                crcs.append(zlib.crc32(as_u32(tokens)))
                start += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every record, checked while it is read."""
    n = parts_for(manifest.sparkSession, 2 * (manifest.agg(F.sum("n_tokens")).first()[0] or 0), TASK_BYTES)
    return manifest.select("records", "start").repartition(n, "records").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
