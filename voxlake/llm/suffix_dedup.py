"""Substring dedup on bytes: suffix order of many documents, built column by column.

A repeated string of ``window`` bytes is found by the order of suffixes and the common prefixes of neighbours in it. The
collection is dealt so that equal strings meet: every window belongs to its least 16-gram (by hash, leftmost), windows
in a row with the same one form a segment, and segments of one gram go to one bucket. There each segment is a document
of its own, laid out in columns around that gram, so equal windows start in the same column. A symbol is a byte and its
column.

A bucket's order grows from the last column to the first: each round puts one symbol before each document's suffix. As
no earlier suffix starts in that column, the round appends one pile to the collection's Burrows-Wheeler transform:
the suffixes of the pile before, stably sorted by the new symbol, and their common prefixes, one more than the least
between two neighbours. Piles are read and written from front to end, once, and only the last is needed to go on; where
a common prefix reaches the window's length, the smallest document of the run is known. (The method's external files are
these piles; a bucket is small enough to hold one in memory, and what is between stages is a Spark table or shuffle.)

Stages, with blocks of documents and buckets of grams; no shuffle has a row for each window:

1. a block's distinct grams go to their buckets; those that a second document has come back as flags;
2. the block's segments at flagged grams, each distinct one once with its smallest document, go to the buckets;
3. a bucket orders them and answers with a bit for each window;
4. the block expands the bits to spans and cuts the texts.

A gram with very many segments is hot: its windows are dealt one by one, by a hash of their own, so that no bucket has
to take them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut, lean, packed, parts_for, rows_of, text_bytes, texts_of, unpacked

WINDOW = 50
#: Bytes of a gram, and grams of a window that are compared at most (a segment's answer has 64 bits).
GRAM, MOST_GRAMS = 16, 64
#: Bytes of text in a block and, about, for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 8_000_000, 16_000_000
#: Segments that make a gram hot.
HOT = 50_000
#: Places that are hashed at a time, at most 2**20.
STRETCH = 1 << 18
#: Bytes of segments, about, that are ordered together.
COLLECTION = 4_000_000
#: Of zstd, for texts and segments.
LEVEL = 9
#: Stands for a null id in the order of documents: after all others.
LAST = np.iinfo(np.int64).max
_TEXT, _GRAMS, _FLAGS, _SEGMENTS, _PLACES, _ANSWERS = range(6)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_COLUMNS = ("ids", "sizes", "a", "b", "c", "data")
_ROW = "block long, bucket int, kind int, n int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in _COLUMNS])


def _squeezed(data: bytes) -> bytes:
    """Texts are shuffled three times: harder compression than the usual costs less than their bytes."""
    return pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True) if data else b""


def _row(block: int, bucket: int, kind: int, n: int, **data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"block": block, "bucket": bucket, "kind": kind, "n": n} | dict.fromkeys(_COLUMNS) | data], _SCHEMA)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; the data end in eight bytes to spare."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each of the first ``n`` places on."""
    eight = _words(data)
    return _mixed(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[8 : 8 + n] * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the window from each start on; it deals windows out and decides nothing."""
    eight, found = _words(data), np.zeros(len(starts), np.uint64)
    for at in [*range(0, window - 8, 8), window - 8]:
        found = _mixed(found + eight[starts + at])
    return found


def segments(data: np.ndarray, ends: np.ndarray, window: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the windows of texts that lie one after the other: first start, number of starts, place and hash of the gram.

    ``data`` ends in 16 bytes to spare. No window reaches over the end of its text.
    """
    grams = min(MOST_GRAMS, window - GRAM + 1)
    size = len(data) - 16
    out: list[tuple[np.ndarray, ...]] = []
    low = np.uint64((1 << 20) - 1)
    for at in range(0, size - window + 1, stretch):
        starts = min(stretch, size - window + 1 - at)
        hashes = gram_hashes(data[at:], starts + grams - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the leftmost
        width = 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:starts], least[grams - width :][:starts])
        valid = np.ones(starts, bool)
        for end in ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, at + starts + window, side="left")].tolist():
            valid[max(0, end - window + 1 - at) : max(0, end - at)] = False
        new = np.empty(starts, bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, starts))
        own = valid[first]
        first, count = first[own], count[own]
        gram = (least[first] & low).astype(np.int64)
        out.append((first + at, count, gram + at, _mixed(hashes[gram])))
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate([x[i] for x in out]) if out else np.empty(0, kind) for i, kind in enumerate(kinds))


def _dealt(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of a hash, in one number."""
    return ((key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def _by_bucket(dealt: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal buckets in rising numbers of ``_dealt``."""
    bucket = (dealt >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


class _Texts:
    """The texts of a block, one after the other, with 16 bytes to spare."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, text: bytes) -> None:
        self.ids, self.sizes = ids, sizes
        self.ends = np.cumsum(np.maximum(sizes, 0))
        self.text = text
        self.data = np.frombuffer(text + bytes(16), np.uint8)

    @classmethod
    def of(cls, row: dict) -> _Texts:
        sizes = unpacked(row["sizes"], row["n"], "i8")
        return cls(unpacked(row["ids"], row["n"], "i8"), sizes, pa.decompress(row["data"], int(np.maximum(sizes, 0).sum()), codec="zstd", asbytes=True) if row["data"] else b"")

    def owners(self, starts: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, starts, side="right")]

    def grams(self, window: int, buckets: int, stretch: int) -> tuple[np.ndarray, ...]:
        """Segments, and of each the number of its gram among the distinct ones."""
        first, count, gram, key = segments(self.data, self.ends, window, stretch)
        distinct, which = np.unique(_dealt(key, buckets), return_inverse=True)
        return first, count, gram, distinct, which


def _grams(window: int, buckets: int, block_bytes: int, stretch: int):
    """Stage 1 in blocks: the texts, and the distinct grams for each bucket."""

    def rows(block: int, ids: list[int], texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        own = _Texts(np.array(ids, np.int64), np.array([-1 if t is None else len(t) for t in texts], np.int64), b"".join(t for t in texts if t))
        yield _row(block, 0, _TEXT, len(ids), ids=packed(own.ids), sizes=packed(own.sizes), data=_squeezed(own.text))
        first, _, _, distinct, which = own.grams(window, buckets, stretch)
        if not len(first):
            return
        owner = own.owners(first)
        by = np.argsort(which, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(which[by]) > 0]))
        several = np.minimum.reduceat(owner[by], at) < np.maximum.reduceat(owner[by], at)
        counts = np.bincount(which)
        for bucket, part in _by_bucket(distinct):
            low = (distinct[part] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield _row(block, bucket, _GRAMS, len(low), a=packed(np.diff(low, prepend=0).astype(np.uint32)), b=packed(several[part].astype(np.uint8)), c=packed(counts[part].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        ids, texts, size, n = [], [], 0, 0
        for batch in batches:
            nulls = batch.column(1).is_null().to_pylist()
            for doc_id, text, null in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), nulls, strict=True):
                ids.append(LAST if doc_id is None else doc_id)
                texts.append(None if null else text)
                size += len(text)
                if size >= block_bytes:
                    yield from rows((part << 20) + n, ids, texts)
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield from rows((part << 20) + n, ids, texts)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    for _, rows in groupby(rows_of(batches), itemgetter(by)):
        yield list(rows)


def _flags(hot: int):
    """Stage 1 in buckets: 0 for a gram of one document, 1 for a shared one, 2 for a hot one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bucket"):
            keys = np.concatenate([np.cumsum(unpacked(r["a"], r["n"], "u4"), dtype=np.int64) for r in rows])
            several = np.concatenate([unpacked(r["b"], r["n"], "u1") for r in rows])
            counts = np.concatenate([unpacked(r["c"], r["n"], "i4") for r in rows]).astype(np.int64)
            by = np.argsort(keys)
            at = np.flatnonzero(np.concatenate([[True], np.diff(keys[by]) > 0]))
            blocks = np.diff(np.append(at, len(by)))
            shared = (blocks > 1) | (np.maximum.reduceat(several[by], at) > 0)
            flag = np.where(shared, 1 + (np.add.reduceat(counts[by], at) > hot), 0).astype(np.uint8)
            out = np.empty(len(keys), np.uint8)
            out[by] = np.repeat(flag, blocks)
            for r, own in zip(rows, np.split(out, np.cumsum([r["n"] for r in rows])[:-1]), strict=True):
                yield _row(r["block"], r["bucket"], _FLAGS, r["n"], a=packed(own))

    return run


def _cut_segments(window: int, buckets: int, stretch: int):
    """Stage 2: the distinct segments of a block at shared grams, for each bucket, and their places in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "block"):
            block, own = rows[0]["block"], _Texts.of(rows[0])
            first, count, gram, distinct, which = own.grams(window, buckets, stretch)
            flags = np.concatenate([np.empty(0, np.uint8), *[unpacked(r["a"], r["n"], "u1") for r in rows[1:]]])[which]
            shared = flags > 0
            first, count, column, dealt, flags = first[shared], count[shared], (first - gram)[shared], distinct[which[shared]], flags[shared]
            if (hot := flags == 2).any():  # their windows one by one
                alone = np.repeat(first[hot], count[hot]) + np.arange(count[hot].sum()) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
                keys = _dealt(window_hashes(own.data, alone, window), buckets)
                first, count, column, dealt = (np.concatenate([x[~hot], y]) for x, y in ((first, alone), (count, np.ones(len(alone), np.int64)), (column, np.zeros(len(alone), np.int64)), (dealt, keys)))
            by = np.argsort(dealt, kind="stable")
            first, count, column, dealt = first[by], count[by], column[by], dealt[by]
            seen: dict[bytes, int] = {}
            text, more = own.text, window - 1
            number = np.array([seen.setdefault(text[a : a + n + more], len(seen)) for a, n in zip(first.tolist(), count.tolist(), strict=True)], np.int64)
            owner = own.owners(first)
            least = np.full(len(seen), LAST)
            np.minimum.at(least, number, owner)
            head = np.empty(len(seen), np.int64)
            head[number[::-1]] = np.arange(len(number))[::-1]  # where each distinct one is first; these rise, so buckets do
            strings = list(seen)
            for bucket, part in _by_bucket(dealt[head]):
                at = head[part]
                yield _row(block, bucket, _SEGMENTS, len(at), ids=packed(least[part]), sizes=packed(count[at].astype(np.uint8)), a=packed((dealt[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), b=packed((-column[at]).astype(np.uint8)), data=_squeezed(b"".join(strings[part])))
            order = np.argsort(first)
            yield _row(block, block % buckets, _PLACES, len(first), a=packed(np.diff(first[order], prepend=0)), b=packed(number[order].astype(np.int32)), sizes=packed(count[order].astype(np.uint8)))

    return run


def ordered_repeats(data: np.ndarray, sizes: np.ndarray, columns: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Of each document of a collection a bit for every start whose window starts, in the same column, in a smaller one too.

    ``data`` holds the documents one after the other, ``sizes`` their bytes, ``columns`` the column of their first byte,
    ``docs`` what they are compared by. Rounds go from the last column to the first.
    """
    offsets = np.cumsum(sizes) - sizes
    last = columns + sizes - 1
    base = offsets - columns  # a document's byte in column x is at base + x
    bits = np.zeros(len(sizes), np.uint64)
    enter = np.argsort(-last, kind="stable")
    waiting = -last[enter]
    order = np.empty(0, np.int64)  # documents by their suffix from the next column on
    common = np.empty(0, np.int64)  # with the one before in the order, in bytes
    came = 0
    for x in range(int(last.max(initial=-1)), int(columns.min(initial=0)) - 1, -1):
        if len(order) and (ended := columns[order] > x).any():
            # who leaves hands the least common prefix on to the next that stays
            stays = np.flatnonzero(~ended)
            common = _least_between(common, np.concatenate([[-1], stays[:-1]]), stays) if len(stays) else common[:0]
            order = order[stays]
        now = int(np.searchsorted(waiting, -x, side="right"))
        if now > came:  # empty suffixes come first, in the order of the collection
            order = np.concatenate([enter[came:now], order])
            common = np.concatenate([np.zeros(now - came, np.int64), common])
            came = now
        if not len(order):
            continue
        symbols = data[base[order] + x]
        by = np.argsort(symbols, kind="stable")
        sorted_ = symbols[by]
        found = np.zeros(len(by), np.int64)
        alike = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
        left, right = by[alike - 1], by[alike]
        near = right == left + 1
        found[alike[near]] = common[right[near]] + 1
        if not near.all():
            found[alike[~near]] = _least_between(common, left[~near], right[~near]) + 1
        order, common = order[by], np.minimum(found, window)
        if x + window - 1 > int(last.max()):
            continue
        whole = common >= window
        if whole.any():
            joined = np.flatnonzero(whole | np.append(whole[1:], False))
            own = docs[order[joined]]
            starts = np.flatnonzero(~whole[joined])
            least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(own))))
            hit = order[joined[least < own]]
            bits[hit] |= np.uint64(1) << (x - columns[hit]).astype(np.uint64)
    return bits


def _least_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least value after each place ``left`` up to place ``right``; places rise or fall in stretches.

    Intervals are taken from the back, so that what lies between two of them is not read.
    """
    by = np.argsort(-right, kind="stable")
    ends = np.empty(2 * len(by), np.int64)
    ends[::2], ends[1::2] = left[by] + 1, right[by] + 1
    out = np.empty(len(by), values.dtype)
    out[by] = np.minimum.reduceat(np.append(values, 0), ends)[::2]
    return out


def _answers(window: int):
    """Stage 3: a bucket's segments in order, and of each a bit for every window that starts in a smaller document too."""

    def collection(strings: list[bytes], columns: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return ordered_repeats(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64), columns, docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bucket"):
            for r in rows:
                if r["kind"] == _PLACES:  # on their way back to their block
                    yield pa.RecordBatch.from_pylist([r], _SCHEMA)
            rows = [r for r in rows if r["kind"] == _SEGMENTS]
            if not rows:
                continue
            seen: dict[bytes, int] = {}
            numbers, owners, keys, columns = [], [], [], []
            for r in rows:
                sizes = unpacked(r["sizes"], r["n"], "u1").astype(np.int64) + window - 1
                ends = np.cumsum(sizes)
                text = pa.decompress(r["data"], int(ends[-1]), codec="zstd", asbytes=True)
                numbers.append(np.array([seen.setdefault(text[b - n : b], len(seen)) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64))
                owners.append(unpacked(r["ids"], r["n"], "i8"))
                keys.append(unpacked(r["a"], r["n"], "u4"))
                columns.append(-unpacked(r["b"], r["n"], "u1").astype(np.int64))
            number, owner, key, column = map(np.concatenate, (numbers, owners, keys, columns))
            least, of_key, of_column = np.full(len(seen), LAST), np.empty(len(seen), np.int64), np.empty(len(seen), np.int64)
            np.minimum.at(least, number, owner)
            of_key[number], of_column[number] = key, column
            strings = list(seen)
            by = np.argsort(of_key, kind="stable")
            size = np.cumsum([len(strings[i]) for i in by.tolist()])
            new_key = np.concatenate([[True], np.diff(of_key[by]) > 0])
            bits, at = np.empty(len(seen), np.uint64), 0
            while at < len(by):  # whole grams, until they are enough
                full = int(np.searchsorted(size, (size[at - 1] if at else 0) + COLLECTION))
                later = np.flatnonzero(new_key[full + 1 :]) if full < len(by) else []
                to = full + 1 + int(later[0]) if len(later) else len(by)
                part = by[at:to]
                bits[part] = collection([strings[i] for i in part.tolist()], of_column[part], least[part])
                at = to
            bits = np.where(owner > least[number], _ALL, bits[number])
            for r, own in zip(rows, np.split(bits, np.cumsum([r["n"] for r in rows])[:-1]), strict=True):
                yield _row(r["block"], r["bucket"], _ANSWERS, r["n"], a=packed(own))

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _spans(window: int):
    """Stage 4: a block's answers become spans of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "block"):
            own = _Texts.of(next(r for r in rows if r["kind"] == _TEXT))
            places = next(r for r in rows if r["kind"] == _PLACES)
            first, number, count = np.cumsum(unpacked(places["a"], places["n"], "i8")), unpacked(places["b"], places["n"], "i4"), unpacked(places["sizes"], places["n"], "u1")
            answers = np.concatenate([np.empty(0, np.uint64), *[unpacked(r["a"], r["n"], "u8") for r in rows if r["kind"] == _ANSWERS]])
            owner = own.owners(first)
            least = np.full(len(answers), LAST)
            np.minimum.at(least, number, owner)
            bits = np.where(owner > least[number], _ALL, answers[number])
            hit = np.flatnonzero(bits)
            marked = np.zeros(len(own.text) + 1, bool)
            for bit in range(int(count.max(initial=0))):
                some = hit[(count[hit] > bit) & ((bits[hit] >> np.uint64(bit)) & np.uint64(1) == 1)]
                marked[first[some] + bit] = True
            at = np.flatnonzero(marked)
            new = np.concatenate([[True], np.diff(at) > window]) if len(at) else np.empty(0, bool)
            new[1:] |= np.diff(np.searchsorted(own.ends, at, side="right")) > 0  # runs of two texts that touch
            starts, ends = at[new], at[np.append(new[1:], True)[: len(at)]] + window
            begin = own.ends - np.maximum(own.sizes, 0)
            cuts = np.searchsorted(starts, np.append(begin, len(own.text) + 1))
            out: list[tuple] = []
            held = 0
            for i, (doc_id, size) in enumerate(zip(own.ids.tolist(), own.sizes.tolist(), strict=True)):
                a, b, off = cuts[i], cuts[i + 1], int(begin[i])
                s, e = starts[a:b].tolist(), ends[a:b].tolist()
                kept = None if size < 0 else b"".join(own.text[x:y] for x, y in zip([off, *e], [*s, off + size], strict=True))
                size = max(0, size)
                out.append((None if doc_id == LAST else doc_id, kept, size, size - len(kept or b""), [x - off for x in s], [y - off for y in e]))
                held += size
                if held >= BLOCK_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None, block_bytes: int = BLOCK_BYTES, stretch: int = STRETCH) -> DataFrame:
    """Every text without the bytes that a repeated string of ``window`` bytes (16 at least) covers.

    A string repeats if it also starts in a document with a smaller id; strings are judged on the input and never reach
    over two documents. Columns: ``doc_id``, ``kept`` (the bytes left; null for a null text), ``n_bytes``, ``n_removed``,
    ``starts`` and ``ends`` (the maximal removed runs, in bytes). One row per input row. Null and empty texts have no
    strings; a null id counts as the largest; rows of one id are no repeat of each other, whatever their texts. Extra
    columns take no part.
    """
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} bytes at least")
    spark = docs.sparkSession
    parts = parts_for(spark, text_bytes(docs, text_col), BUCKET_BYTES)
    buckets = buckets or max(64, parts)
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    blocks = cut(columns.mapInArrow(lean(_grams(window, buckets, block_bytes, stretch)), _ROW), "blocks")  # later stages must meet the same blocks
    texts = blocks.filter(f"kind = {_TEXT}")

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.repartition(2 * buckets if by == "bucket" else parts, by).sortWithinPartitions(by, "kind", "bucket", "block")

    flags = dealt(blocks.filter(f"kind = {_GRAMS}"), "bucket").mapInArrow(lean(_flags(HOT)), _ROW)
    found = dealt(texts.unionByName(flags), "block").mapInArrow(lean(_cut_segments(window, buckets, stretch)), _ROW)
    answers = dealt(found, "bucket").mapInArrow(lean(_answers(window)), _ROW)
    return dealt(texts.unionByName(answers), "block").mapInArrow(lean(_spans(window)), "doc_id long, kept binary, n_bytes long, n_removed long, starts array<long>, ends array<long>")
