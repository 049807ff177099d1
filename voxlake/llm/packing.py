"""Best-fit packing by large-item matching, planned on the histogram of lengths.

There are at most ``capacity`` different lengths, so the plan is made for lengths and counts, whatever the number of
documents: pieces above a third of the capacity are matched at most two to a sequence, the longest with the longest
that still fits; smaller ones, the longest first, go where the least gap is left that holds them. The plan is a
list of groups of equal sequences. Each piece then takes the slot that its rank among pieces of its length has in
the plan; ranks come from counts of (length, bucket), so that no task holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm.common import cut, lean, texts_of
from voxlake.llm.tokens import as_u32, encoder

CAPACITY = 1024


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            at, number, starts, lengths, crcs, ids_of = [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                ids = np.append(encode(text).astype(np.uint32), np.uint32(end_id))
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for j, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    data = as_u32(ids[a:b])
                    at.append(i)
                    number.append(j)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(data))
                    ids_of.append(data if with_ids else None)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs)), pa.array(ids_of, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and ``ids`` (null unless asked for) of each piece.

    A document is its token ids and ``end_id``; null texts are empty. Only documents beyond the capacity are cut; all
    their pieces but the first are full.
    """
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return columns.mapInArrow(lean(_pieces(tokenizer, end_id, capacity, with_ids), remembers=True), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: (how many, [(length, times), ...]). Every piece of the histogram has one slot."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths lie between 1 and the capacity")
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    gaps: list[int] = []

    def put(count: int, items: list[tuple[int, int]]) -> None:
        if count:
            gap = capacity - sum(n * k for n, k in items)
            if not by_gap[gap]:
                insort(gaps, gap)
            by_gap[gap].append((count, items))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fits = bisect_left(large, capacity - n + 1) - 1
        if fits < 0:
            put(left.pop(n), [(n, 1)])
            large.pop()
            continue
        m = large[fits]
        count = left[n] // 2 if m == n else min(left[n], left[m])
        if m == n and left[n] == 1:  # alone with itself: the next smaller one
            if fits == 0:
                put(1, [(n, 1)])
                large.pop()
                continue
            m, count = large[fits - 1], 1
        put(count, [(n, 2)] if m == n else [(n, 1), (m, 1)])
        left[n] -= count
        left[m] -= count
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                put(count // per, [(n, per)])
                if count % per:
                    put(1, [(n, count % per)])
                break
            gap = gaps[at]
            bins, items = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(at)
            per = gap // n
            full, some = divmod(min(count, bins * per), per)
            put(full, [*items, (n, per)])
            if some:
                put(1, [*items, (n, some)])
            rest = bins - full - (some > 0)
            if rest:
                put(rest, items)
            count -= full * per + some
    return [group for gap in gaps for group in by_gap[gap]]


def _slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Slots by (length, first rank): the group's first sequence, times a sequence and offset there."""
    ranks: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, items in groups:
        offset = 0
        for n, k in items:
            rows.append((n, ranks[n], base, k, offset))
            ranks[n] += count * k
            offset += n * k
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "base", "times", "offset"), table.T, strict=True))


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` (0, 1, ...) and ``offset`` to rows of ``pieces``; a sequence has no gap before its end.

    Only the histogram of lengths, ``capacity`` rows at most, comes to the driver. Equal pieces take each other's
    slots freely. An empty table packs into nothing.
    """
    spark = found.sparkSession
    buckets = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(offsets, ["length", "bucket"])
    ranked = ranked.select(*found.columns, (F.col("rank") + F.col("before") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = (table["length"] << 44) | table["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            i = rank - table["rank"][at]
            sequence, offset = table["base"][at] + i // table["times"][at], table["offset"][at] + i % table["times"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in found.dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of the documents with their places; texts are encoded once, the pieces are written to the shared folder."""
    found = pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids)
    return pack(cut(found if with_ids else found.drop("ids"), "pieces"), capacity)
