"""Substring dedup on bytes against brute force, also on nulls, ties, long texts, clashing names and empty tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import suffix_dedup

DOCS = "doc_id long, text string, lang string"


def rows():
    rng = np.random.default_rng(3)
    words = [f"wörd{i}" for i in range(300)]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, 300, n))
    base, long = text(80), text(6000)
    shared = text(14)
    found = [(5, base, "a"), (1, base, "a"), (9, base[:200] + "EDITED" + base[200:], "a"), (2, None, None), (3, "", "b"), (4, "x" * 49, "b"), (7, "y" * 300, "b"), (8, "y" * 120 + "z", "b"), (8, "y" * 120 + "z", "b")]
    found += [(None, base, "a"), (None, None, None), (11, long, "c"), (10, long[5000:] + text(200), "c"), (12, "日本語🙂" * 40, "d"), (13, "🙂日本語" * 40, "d"), (6, "ab" * 90, "e"), (14, "ba" * 70 + base[100:160], "e")]
    found += [(100 + i, text(rng.integers(3, 40)) + " " + shared[: rng.integers(20, len(shared))] + " " + text(5), "f") for i in range(60)]
    return found


def brute(found, window):
    order = lambda i: math.inf if i is None else i
    least = {}
    for i, t, *_ in found:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            key = b[p : p + window]
            least[key] = min(least.get(key, math.inf), order(i))
    out = Counter()
    for i, t, *_ in found:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < order(i):
                gone[p : p + window] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0)).tolist()
        kept = None if t is None else bytes(v for v, g in zip(b, gone, strict=False) if not g)
        out[i, kept, len(b), int(gone.sum()), tuple(edges[::2]), tuple(edges[1::2])] += 1
    return out


def got(frame, **options):
    return Counter((r.doc_id, None if r.kept is None else bytes(r.kept), r.n_bytes, r.n_removed, tuple(r.starts), tuple(r.ends)) for r in suffix_dedup.remove_repeats(frame, **options).collect())


@pytest.mark.parametrize(("clash", "window", "hot", "block", "stretch"), [(False, 50, 50_000, 8_000_000, 1 << 18), (True, 50, 3, 3000, 500), (False, 16, 0, 1000, 1 << 18), (False, 90, 50_000, 2000, 700)])
def test_equals_brute_force(spark, monkeypatch, clash, window, hot, block, stretch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    frame = spark.createDataFrame(rows(), DOCS).repartition(5)
    if clash:
        frame = frame.withColumns({c: F.lit("clash") for c in ("block", "bucket", "kind", "n", "ids", "sizes", "a", "b", "c", "data", "kept", "starts", "ends")})
    assert got(frame, window=window, block_bytes=block, stretch=stretch) == brute(rows(), window)


def test_empty_tables(spark):
    assert got(spark.createDataFrame([], DOCS)) == Counter()
    assert got(spark.createDataFrame([(1, None, None)], DOCS)) == brute([(1, None)], 50)


@pytest.mark.parametrize("letters", [2, 5, 250])
def test_order_of_columns(letters):
    """The bits of a collection whose documents start and end in different columns, against all pairs."""
    rng = np.random.default_rng(letters)
    sizes, columns, docs = rng.integers(6, 40, 300), -rng.integers(0, 30, 300), rng.integers(0, 90, 300)
    base = rng.integers(0, letters, 200).astype(np.uint8)
    strings = [base[n : n + k].copy() if rng.random() < 0.5 else rng.integers(0, letters, k).astype(np.uint8) for n, k in zip(columns + 100, sizes, strict=True)]
    bits = suffix_dedup.ordered_repeats(np.concatenate(strings), sizes, columns, docs, 6)
    least = {}
    for s, c, d in zip(strings, columns, docs, strict=True):
        for i in range(len(s) - 5):
            key = (c + i, s[i : i + 6].tobytes())
            least[key] = min(least.get(key, 99), d)
    assert bits.tolist() == [sum(1 << i for i in range(len(s) - 5) if least[c + i, s[i : i + 6].tobytes()] < d) for s, c, d in zip(strings, columns, docs, strict=True)]
    assert bits.any()


def test_more_parts_change_nothing(spark):
    frame = spark.createDataFrame(rows(), DOCS)
    assert got(frame.repartition(11), buckets=3) == got(frame.repartition(2), buckets=97)
