"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Three shuffles, none of which carries a row per window:

1. every map task hashes all windows of its documents (rolling polynomials modulo 2**64), keeps for each hash the
   occurrence in the smallest document of its block and packs the rest of the answer (windows that repeat inside the
   block) beside it; packed blocks go to hash buckets;
2. a bucket sorts its hashes and marks every window that also starts in a smaller document;
3. marks return to their block, merge into maximal removal intervals and join the documents.

A hash key has two parts: a 64-bit polynomial hash and 16 more bits of a second one with another base and other word
hashes. The probability that two different windows share a key is about 2**-80.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import lean, packed, parts_for, rows_of, text_bytes, texts_of, unpacked

WINDOW = 13
#: Odd multipliers of the two polynomials, 3 modulo 4, so that a swap of neighbours costs one bit at most.
BASES = (0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F)
#: Windows in a map task's block; about 110 bytes each while it is sorted.
BLOCK_WINDOWS = 1_000_000
#: Bytes of text, about, whose windows a hash bucket holds, and buckets at most (a block has a row for each).
BUCKET_BYTES, MOST_BUCKETS = 16_000_000, 4096
#: Words whose hashes a task keeps at a time.
KNOWN_WORDS = 100_000
#: Stands for a null id in the order of documents: after all others.
LAST = np.iinfo(np.int64).max

_BLOCK = "block long, bucket int, kind int, n_docs int, n int, docs binary, ranks binary, counts binary, places binary, keys binary, extra binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n_docs", pa.int32()), ("n", pa.int32())] + [(k, pa.binary()) for k in ("docs", "ranks", "counts", "places", "keys", "extra")])
_KEYS, _REMOVED, _ALIAS, _TABLE = 0, 1, 2, 3


class _WordHashes(dict):
    """Two 64-bit hashes of a word."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = (xxhash.xxh3_64_intdigest(word), xxhash.xxh64_intdigest(word, 7))
        return found


def _signed(x: int) -> int:
    """As Spark's xxhash64 gives it."""
    return x - (1 << 64) if x >> 63 else x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Windows whose hashes are rolled at a time, so that the tables of powers stay small.
ROLLED = 65_536


@lru_cache(maxsize=4)
def _powers(window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each base the powers and those of its inverse modulo 2**64, as many as a stretch of windows needs."""
    n, out = ROLLED + window, []
    for base in BASES:
        pair = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        out.append((pair[0], pair[1]))
    return out


def window_hashes(words: list[bytes], window: int, known: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The two polynomial hashes of each window of ``window`` words, rolled from one window to the next.

    With S the running sum of word hash times base**-place, a window's hash is (S at its end - S at its start) times
    a power of the base, all modulo 2**64.
    """
    n = len(words) - window + 1
    pairs = np.array([known[w] for w in words], np.uint64)
    out = []
    for j, (power, inverse) in enumerate(_powers(window)):
        h = np.empty(n, np.uint64)
        for at in range(0, n, ROLLED):
            m = min(ROLLED, n - at)
            sums = np.zeros(m + window, np.uint64)
            np.cumsum(pairs[at : at + m + window - 1, j] * inverse[: m + window - 1], out=sums[1:])
            h[at : at + m] = (sums[window:] - sums[:m]) * power[window - 1 : window - 1 + m]
        out.append(_mixed(h))
    return out[0], out[1]


class _Block:
    """Documents of one map task until they hold enough windows."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.texts: list[int] = []
        self.hashes: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, doc_id: int | None, text: int, hashes: tuple[np.ndarray, np.ndarray]) -> None:
        self.ids.append(LAST if doc_id is None else doc_id)
        self.texts.append(text)
        self.hashes.append(hashes)
        self.n += len(hashes[0])

    def rows(self, block: int, buckets: int) -> Iterator[dict]:
        ids, texts = np.array(self.ids, np.int64), np.array(self.texts, np.int64)
        order = np.lexsort((texts, ids))
        ids, texts, hashes = ids[order], texts[order], [self.hashes[i] for i in order]
        sizes = np.array([len(h[0]) for h in hashes])
        doc = np.repeat(np.arange(len(ids)), sizes)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key, more = (np.concatenate([h[i] for h in hashes]) for i in (0, 1))
        more = more.astype(np.uint16)
        by = np.argsort(key, kind="stable")  # within a key by document and place
        k, m = key[by], more[by]
        start = np.ones(len(by), bool)
        start[1:] = k[1:] != k[:-1]
        if (~start[1:] & (m[1:] != m[:-1])).any():  # equal first parts of different windows
            by = np.lexsort((more, key))
            k, m = key[by], more[by]
            start[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        d = doc[by]
        own_start = start.copy()
        own_start[1:] |= d[1:] != d[:-1]
        at_first = lambda flags: by[np.maximum.accumulate(np.where(flags, np.arange(len(by)), 0))]
        smaller, owner = np.empty(len(by), bool), np.empty(len(by), np.int64)
        smaller[by] = ids[doc[at_first(start)]] < ids[d]
        owner[by] = at_first(own_start)
        head = ~smaller & (owner == np.arange(len(by)))
        bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)

        def row(kind: int, to: int, at: np.ndarray, keys: bytes = b"", extra: bytes = b"") -> dict:
            which, counts = np.unique(doc[at], return_counts=True)
            return {"block": block, "bucket": to, "kind": kind} | _packed_places(ids[which], which, counts, place[at]) | {"keys": keys, "extra": extra}

        own = block % buckets
        yield {"block": block, "bucket": own, "kind": _TABLE, "n_docs": len(ids), "n": 0, "docs": packed(ids), "keys": packed(texts)}
        at = np.flatnonzero(head)
        at = at[np.argsort(bucket[at], kind="stable")]
        for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1) if len(at) else []:
            yield row(_KEYS, int(bucket[part[0]]), part, key[part].tobytes() + more[part].tobytes())
        if len(at := np.flatnonzero(smaller)):
            yield row(_REMOVED, own, at)
        if len(at := np.flatnonzero(~smaller & ~head)):
            yield row(_ALIAS, own, at, extra=packed(place[owner[at]].astype(np.int32)))


def _packed_places(ids: np.ndarray, ranks: np.ndarray, counts: np.ndarray, places: np.ndarray) -> dict:
    steps = np.diff(places, prepend=0).astype(np.int32)
    return {"n_docs": len(ids), "n": len(places), "docs": packed(np.diff(ids, prepend=0)), "ranks": packed(np.diff(ranks, prepend=0)), "counts": packed(counts.astype(np.int32)), "places": packed(steps)}


def _places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of a packed row: document, the document's rank in its block, and place."""
    counts = unpacked(row["counts"], row["n_docs"], "i4")
    docs, ranks = (np.cumsum(unpacked(row[k], row["n_docs"], "i8")) for k in ("docs", "ranks"))
    return np.repeat(docs, counts), np.repeat(ranks, counts), np.cumsum(unpacked(row["places"], row["n"], "i4"), dtype=np.int64)


def _hashed(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, n = _WordHashes(), _Block(), 0
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                block.add(doc_id, _signed(xxhash.xxh64_intdigest(text, 42)), window_hashes(words, window, known))
                if block.n >= BLOCK_WINDOWS:
                    for row in block.rows((part << 20) + n, buckets):
                        yield pa.RecordBatch.from_pylist([row], _SCHEMA)
                    block, n = _Block(), n + 1
        if block.n:
            for row in block.rows((part << 20) + n, buckets):
                yield pa.RecordBatch.from_pylist([row], _SCHEMA)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket; the keys of a bucket turn into the places whose window starts in a smaller document too."""
    bucket, rows = None, []
    for row in rows_of(batches):
        if row["kind"] != _KEYS:
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)
            continue
        if row["bucket"] != bucket and rows:
            yield from _marked(rows)
            rows = []
        bucket = row["bucket"]
        rows.append(row)
    if rows:
        yield from _marked(rows)


def _marked(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    sizes = [row["n"] for row in rows]
    key = np.concatenate([np.frombuffer(row["keys"], np.uint64, row["n"]) for row in rows])
    more = np.concatenate([np.frombuffer(row["keys"], np.uint16, row["n"], 8 * row["n"]) for row in rows])
    by = np.argsort(key)
    k = key[by]
    equal = k[1:] == k[:-1]
    shared = np.zeros(len(by), bool)
    shared[1:] |= equal
    shared[:-1] |= equal
    by = by[shared]
    doc = np.concatenate([_places(row)[0] for row in rows])
    by = by[np.lexsort((doc[by], more[by], key[by]))]
    k, m, d = key[by], more[by], doc[by]
    start = np.ones(len(by), bool)
    start[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    least = d[np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))] if len(by) else d
    repeated = np.zeros(len(key), bool)
    repeated[by[least < d]] = True
    for row, flags in zip(rows, np.split(repeated, np.cumsum(sizes)[:-1]), strict=True):
        if flags.any():
            docs, ranks, places = (x[flags] for x in _places(row))
            starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            found = _packed_places(docs[starts], ranks[starts], np.diff(np.append(starts, len(docs))), places)
            yield pa.RecordBatch.from_pylist([row | found | {"kind": _REMOVED, "keys": b""}], _SCHEMA)


_SPANS = "ord long, text_hash long, starts array<int>, ends array<int>"
_SPANS_SCHEMA = pa.schema([("ord", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _merged(window: int):
    """Rows come by block; the marks of a block turn into a document's maximal removal intervals, in words."""

    def spans(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        table = next(row for row in rows if row["kind"] == _TABLE)
        ids, texts = (unpacked(table[k], table["n_docs"], "i8") for k in ("docs", "keys"))
        kinds = {kind: [row for row in rows if row["kind"] == kind] for kind in (_REMOVED, _ALIAS)}
        placed = lambda row: (lambda _, ranks, places: (ranks << 32) | places)(*_places(row))
        marks = np.unique(np.concatenate([np.empty(0, np.int64), *map(placed, kinds[_REMOVED])]))
        for row in kinds[_ALIAS]:  # later places of a window in its document go if the first does
            owners = (placed(row) >> 32 << 32) | unpacked(row["extra"], row["n"], "i4")
            marks = np.union1d(marks, placed(row)[np.isin(owners, marks)])
        if not len(marks):
            return
        at, place = marks >> 32, marks & 0xFFFFFFFF
        new_doc = np.concatenate([[True], at[1:] != at[:-1]])
        opens = new_doc.copy()
        opens[1:] |= place[1:] > place[:-1] + window
        closes = np.append(opens[1:], True)
        starts, ends, whose = place[opens].astype(np.int32), (place[closes] + window).astype(np.int32), at[opens]
        offsets = np.append(np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]])), len(whose)).astype(np.int32)
        seen = whose[offsets[:-1]]
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(texts[seen]), *lists], schema=_SPANS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for row in rows_of(batches):
            if row["block"] != block and rows:
                yield from spans(rows)
                rows = []
            block = row["block"]
            rows.append(row)
        if rows:
            yield from spans(rows)

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the join's shuffle."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        nulls = batch.column(1).is_null().to_pylist()
        texts = pa.array([None if null else squeeze(text) for text, null in zip(texts_of(batch.column(1)), nulls, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2), batch.column(3)], batch.schema.names)


def _removed(keep_untouched: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezed = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for data, starts, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = squeezed.decompress(data) if data is not None else b""
                words = text.split()
                n_words.append(len(words))
                if starts:
                    left = []
                    for start, end in zip([0, *ends], [*starts, len(words)], strict=True):
                        left += words[start:end]
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                else:
                    n_removed.append(0)
                    kept.append((None if data is None else text) if keep_untouched else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), batch.column(2), batch.column(3)], ["doc", "kept", "n_words", "n_removed", "starts", "ends"])

    return run


def removal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Maximal intervals of words to remove: ``ord`` (the id; null ids count as the largest), ``text_hash``, ``starts``, ``ends``.

    One row per document with something to remove. Rows with the same id and text get the same intervals. Texts of
    fewer than ``window`` words, empty and null texts have none.
    """
    parts = parts_for(docs.sparkSession, text_bytes(docs, text_col), BUCKET_BYTES)
    buckets = buckets or min(MOST_BUCKETS, max(64, parts))
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    blocks = columns.mapInArrow(lean(_hashed(window, buckets)), _BLOCK)
    marks = blocks.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_repeats), _BLOCK)
    spans = marks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(lean(_merged(window)), _SPANS)
    return spans.groupBy("ord", "text_hash").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_untouched: bool = False, buckets: int | None = None) -> DataFrame:
    """Every document without the words that a repeated window covers.

    A window repeats if its words also start a window in a document with a smaller id. Columns: ``doc`` (struct of
    the input's columns other than the text), ``kept`` (the words left, joined by one space; with ``keep_untouched``
    the original text where nothing goes, null if it was), ``n_words``, ``n_removed``, ``starts`` and ``ends`` (null where nothing
    goes). One row per input row. Null texts have no words; a null id counts as the largest; equal ids are no repeat
    of each other. Extra columns stay inside ``doc``, so their names cannot clash.
    """
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("doc"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("ord"), F.xxhash64(text).alias("text_hash"))
    doc_type = rows.schema["doc"].dataType.simpleString()
    rows = rows.mapInArrow(lean(_squeezed), f"doc {doc_type}, text binary, ord long, text_hash long")
    parts = parts_for(docs.sparkSession, text_bytes(docs, text_col), BUCKET_BYTES)
    spans = removal_spans(docs, id_col, text_col, window, buckets).repartition(parts, "ord", "text_hash")
    joined = rows.repartition(parts, "ord", "text_hash").join(spans, ["ord", "text_hash"], "left")
    out = joined.select("doc", "text", "starts", "ends")
    schema = f"doc {doc_type}, kept binary, n_words long, n_removed long, starts array<int>, ends array<int>"
    return out.mapInArrow(lean(_removed(keep_untouched)), schema).withColumn("kept", F.col("kept").cast("string"))
