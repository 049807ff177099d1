"""The Merkle manifest against a tree built by hand, also on nulls, ties, repeated rows, clashing names and empty tables."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxlake.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    found = [(i, f"Text NUMBER {i} é", "en" if i % 3 else "fr", None if i % 5 == 0 else f"s{i % 4}", i) for i in range(1, 180)]
    found += [(None, None, None, None, None), (None, "x", None, "a", 1), (500, "", "de", "", 0), (7, "Text NUMBER 7 é", "en", "s3", 7), (7, "Text NUMBER 7 é", "en", "s3", 7), (7, "other", "en", "s3", 7)]
    return found + [(600 + i, "A" * 70_000, f"l{i:02}", "s", 9) for i in range(20)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(leaves):
    """Root, and of each leaf the steps (left siblings, right siblings)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    steps = [[("".join(level[i // 8**k // 8 * 8 : i // 8**k]), "".join(level[i // 8**k + 1 : i // 8**k // 8 * 8 + 8])) for k, level in enumerate(levels[:-1])] for i in range(len(leaves))]
    return levels[-1][0], steps


def expected(found):
    blank = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in found}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {lang: sorted((r for r in found if r[2] == lang), key=lambda r: (blank(r[0]), leaf(*r))) for lang in langs}
    trees = {lang: tree([leaf(*r) for r in own]) for lang, own in groups.items()}
    root, above = tree([trees[lang][0] for lang in langs])
    out = Counter()
    for at, lang in enumerate(langs):
        for r, steps in zip(groups[lang], trees[lang][1], strict=True):
            path = steps + above[at]
            changed = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0 and r[1] is not None
            node = leaf(r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:]) if changed else leaf(*r)
            for left, right in path:
                node = sha(left, node, right)
            out[r[0], leaf(*r), trees[lang][0], root, sha(*[left + right for left, right in path]), node, node == root] += 1
    return out


@pytest.mark.parametrize(("clash", "bound"), [(False, 10_000), (True, 10_000), (False, 0)])
def test_manifest(spark, monkeypatch, clash, bound):
    monkeypatch.setattr(merkle, "BROADCAST_ANCESTORS", bound)
    frame = spark.createDataFrame(rows(), DOCS).repartition(7)
    if clash:
        frame = frame.withColumns({name: F.lit("clash") for name in ("leaf", "root", "proof", "t", "i", "l", "node", "at", "tampered", "verified", "_group", "_id", "_part")})
    got = merkle.document_manifest(frame)
    assert Counter(tuple(r)[:7] for r in got.collect()) == expected(rows())


def test_single_rows_and_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.document_manifest(empty).collect() == []
    one = [(3, "A b", "en", None, 3)]
    got = merkle.document_manifest(spark.createDataFrame(one, DOCS)).first()
    assert got.root == got.subroot == got.leaf == leaf(*one[0]) and got.proof == [] and got.proof_sha256 == sha("")
    assert Counter([tuple(got)[:7]]) == expected(one)


def test_every_proof_reaches_the_root(spark):
    got = merkle.document_manifest(spark.createDataFrame(rows(), DOCS), one_in=10**6).select("leaf", "root", "proof", "verified").collect()
    for row in got:
        node = row.leaf
        for step in row.proof:
            node = sha(bytes(step.left).hex(), node, bytes(step.right).hex())
        assert node == row.root
