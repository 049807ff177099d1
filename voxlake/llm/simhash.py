"""SimHash near-dedup: fingerprints of word shingles, linked by multi-index hashing.

A fingerprint has two 32-bit segments. Two fingerprints that differ in at most three bits differ in at most one bit of
one of the segments, so each fingerprint asks, per segment, for the 33 values of its Hamming ball of radius one; what
the table holds there is verified over all 64 bits. Exact copies share a fingerprint and enter once. A bucket never
gives all its pairs: a task links each bucket by a search over what is not linked yet, and buckets beyond
``SPLIT`` members are dealt out as pairs of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut, join_with_hot_keys, texts_of
from voxlake.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Segments of a fingerprint: (shift, bits); with two segments and radius 1 no link of up to three bits is lost.
SEGMENTS = ((0, 32), (32, 32))
#: Members of a bucket that one task compares.
SPLIT = 20_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash as a signed number: a bit is 1 if set in over half of the shingles' XXH64. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: len(words) - shingle]])
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    bits = np.zeros(64, np.int64)
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for at in range(0, len(hashes), 4096):
        bits += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">i8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(text, shingle, seed) for text in texts_of(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``print`` (the fingerprint as a signed long) of each row; null and empty texts get 0.

    A-Z are lower-cased, no other letters. A text of fewer words than a shingle is one shingle.
    """
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return columns.mapInArrow(_fingerprints(shingle, seed), "doc_id long, print long")


def _ball(segment: Column, bits: int) -> Column:
    return F.concat(F.array(segment), *[F.array(segment.bitwiseXOR(F.lit(1 << i).cast("long"))) for i in range(bits)])


def _ask(segment: int, key: Column, place: Column) -> Column:
    return F.struct(F.lit(segment).alias("segment"), key.alias("key"), (place == 0).alias("held"))


def _linked(members: np.ndarray, askers: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what lies within the distance, as few as connect it: each asker not linked yet is looked at once."""
    out = []
    every = np.unique(np.concatenate([members, askers]))
    is_member, is_asker = np.isin(every, members), np.isin(every, askers)
    todo = np.ones(len(every), bool)
    for seed in range(len(every)):
        if not todo[seed]:
            continue
        todo[seed] = False
        stack = [seed]
        while stack:
            at = stack.pop()
            open_ = np.flatnonzero(todo & (is_asker if is_member[at] and not is_asker[at] else is_member if is_asker[at] and not is_member[at] else True))
            near = open_[np.bitwise_count(every[open_] ^ every[at]) <= distance]
            todo[near] = False
            out += [(int(every[at]), int(every[i])) for i in near]
            stack += near.tolist()
    return out


def _bucket_edges(distance: int):
    """Rows come by bucket: whole buckets are linked, and only the links that connect go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(prints: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
            pairs = _linked(prints[held].view(np.uint64), prints[~held].view(np.uint64), distance)
            flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])

        rest: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            rows = np.concatenate([*rest, rows], axis=1) if rest else rows
            cuts = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            parts = np.split(rows, cuts, axis=1)
            rest = [parts.pop()]
            for part in parts:
                yield edges(part[4], part[5].astype(bool))
        if rest and rest[0].shape[1]:
            yield edges(rest[0][4], rest[0][5].astype(bool))

    return run


def links(prints: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs of distinct prints that differ in at most ``distance`` bits.

    ``distance`` is at most 3: with two segments one of them then differs in at most one bit.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments and balls of radius 1 find links of up to three bits")
    column = F.col("print")
    rows = []
    for number, (shift, bits) in enumerate(SEGMENTS):
        part = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        rows.append(F.transform(_ball(part, bits), partial(_ask, number)))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = prints.repartition(n, "print").select("print", F.explode(F.concat(*rows)).alias("ask")).select("ask.*", "print")
    buckets = asked.groupBy("segment", "key").agg(F.count("*").alias("n"), F.count_if("held").alias("n_held")).filter("n > 1 and n_held > 0")
    # few buckets have anything to compare; an explode's rows are more than Spark takes them for: they are not sent to every task
    shared = asked.join(buckets.hint("merge"), ["segment", "key"])
    # a print in a bucket of its own segment value is both held and an asker: it meets every other member once
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / split).cast("int"))
    own = F.pmod(F.xxhash64("print"), F.greatest(F.lit(1), F.ceil(F.col("n") / split)).cast("long")).cast("int")
    own_held = F.pmod(F.xxhash64("print", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("n_held") / split)).cast("long")).cast("int")
    as_held = F.when(F.col("held"), F.transform(F.sequence(F.lit(0), parts(F.col("n")) - 1), lambda p: F.struct(own_held.alias("h"), p.alias("p"), F.lit(True).alias("is_held"))))
    as_asker = F.transform(F.sequence(F.lit(0), parts(F.col("n_held")) - 1), lambda h: F.struct(h.alias("h"), own.alias("p"), F.lit(False).alias("is_held")))
    dealt = shared.select("segment", "key", "print", F.explode(F.concat(F.coalesce(as_held, F.array().cast(as_array_type())), as_asker)).alias("to")).select("segment", "key", "to.h", "to.p", "print", "to.is_held")
    return dealt.repartition(n, "segment", "key", "h", "p").sortWithinPartitions("segment", "key", "h", "p").mapInArrow(_bucket_edges(distance), "a long, b long")


def as_array_type() -> str:
    return "array<struct<h:int,p:int,is_held:boolean>>"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` (the smallest id reachable by links) of each row.

    Fingerprints link at ``distance`` or fewer differing bits; equal fingerprints always link. Null ids have no
    order: their component is that of the smallest id they reach, or null if they reach none.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    edges = cut(links(distinct.select("print"), distance).distinct(), "links")
    groups = components(edges, "a", "b")  # print -> root, for prints with a link
    return with_components(prints, distinct, groups).select("doc_id", "print", "component_id")


def with_components(rows: DataFrame, distinct: DataFrame, groups: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``doc_id``, ``print``, ``root`` (the print that stands for the component) and ``component_id`` of rows of ``doc_id`` and ``print``, and their columns ``keep``.

    ``distinct`` has each print's ``least`` id and count ``n``, ``groups`` the ``root`` of each print (``node``) that
    has a link. A print of very many rows, and a component of very many prints, are looked up in every task.
    """
    rooted = distinct.join(groups.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("root"), "least", "n")
    rooted = cut(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    by_print = cut(join_with_hot_keys(rooted.select("print", "root", "n"), least, "root", "prints", rooted.count()).select("print", "root", "component_id", "n"), "by-print")
    return join_with_hot_keys(rows.select("doc_id", "print", *keep), by_print, "print", "n", rows.count()).select("doc_id", "print", *keep, "root", "component_id")
