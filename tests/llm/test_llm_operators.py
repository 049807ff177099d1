"""Training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from voxlake.llm import ann_tree, common, components, impact_search, langid, lm_scoring, mixing, near_copies, packing, records, simhash, substring_dedup, tokens, toxicity
from voxlake.llm import queries as llm_queries
from voxlake.llm.vectors import usable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def text(start, n):
    return " ".join(WORDS[(start + 7 * i + i * i) % 400] for i in range(n))


def rows():
    base = text(0, 120)
    near = base.split()
    near[60] = "edited"
    found = [
        (5, base, "en", "a", 1), (1, base, "en", "a", 1), (9, " ".join(near), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t", "fr", "b", 3),
        (7, "é 日本 🙂 ...", "fr", "b", 9), (8, "x " * 3000, "en", "a", 1), (10, text(3, 40), "en", None, 1), (10, text(3, 40), "en", None, 1), (11, "w1", "en", "c", 2), (12, text(50, 4000), "fr", "c", 1),
    ]
    return found + [(None, base, "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same documents with extra columns that bear the operators' own names."""
    names = ("kept", "starts", "ends", "ord", "text_hash", "size", "taken", "start", "block", "n", "end", "shard", "score", "predicted", "doc", "part", "print", "component_id", "length", "bucket")
    return docs.withColumns({name: F.lit("clash") for name in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_substring_dedup(which, request):
    frame = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(frame).select("doc.doc_id", "n_words", "n_removed", "kept").collect())
    order = lambda i: math.inf if i is None else i
    least = {}
    for i, x, *_ in rows():
        w = words(x)
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            least[key] = min(least.get(key, math.inf), order(i))
    expected = Counter()
    for i, x, *_ in rows():
        w = words(x)
        gone = {p + j for p in range(len(w) - 12) if least[tuple(w[p : p + 13])] < order(i) for j in range(13)}
        expected[i, len(w), len(gone), " ".join(v for p, v in enumerate(w) if p not in gone)] += 1
    assert got == expected


def brute_print(x):
    w = [v.translate({c: c + 32 for c in range(65, 91)}) for v in words(x)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, ids):
    """Smallest id reachable by links of up to three bits."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                parent[find(a)] = find(b)
    return [min((ids[j] for j in range(len(prints)) if find(j) == find(k) and ids[j] is not None), default=None) for k in range(len(prints))]


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_simhash(which, request):
    got = Counter((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(request.getfixturevalue(which)).collect())
    prints, ids = [brute_print(x) for _, x, *_ in rows()], [r[0] for r in rows()]
    assert got == Counter(zip(ids, prints, roots(prints, ids), strict=True))


@pytest.mark.parametrize(("hot_keys", "hot_rows"), [(1000, 10_000), (4, 3), (10**9, 0)])
def test_components_with_hubs(spark, monkeypatch, hot_keys, hot_rows):
    """Stars, chains and rings, with hubs looked up in every task or joined."""
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    edges = [(500, i) for i in range(1, 60)] + [(i, i + 1) for i in range(600, 640)] + [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(60, 600), (800, 800), (None, 3), (5, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    expected = {500: 1, **dict.fromkeys(range(1, 60), 1), **dict.fromkeys([60, *range(600, 641)], 60), **dict.fromkeys(range(700, 709), 700), 800: 800}
    assert got == expected


@pytest.mark.parametrize("hot_rows", [0, 1])
def test_simhash_with_hot_prints(docs, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    prints, ids = [brute_print(x) for _, x, *_ in rows()], [r[0] for r in rows()]
    got = Counter((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter(zip(ids, prints, roots(prints, ids), strict=True))


def test_simhash_links_between_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 63), 1 << 63, 6, dtype=np.int64)
    prints = sorted({int(c ^ np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.integers(0, 63, k)), initial=np.int64(0))) for c in centres for k in (0, 1, 2, 3, 4) for _ in range(25)})
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    for split in (20_000, 7):
        edges = [(r.a, r.b) for r in simhash.links(frame, split=split).collect()]
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in edges)
        groups = {p: {p} for p in prints}
        for a, b in edges:
            if groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[a]:
                    groups[x] = groups[a]
        masked = [p & (1 << 64) - 1 for p in prints]
        expected = roots(masked, list(range(len(prints))))
        got = [min(prints.index(x) for x in groups[p]) for p in prints]
        assert got == expected


def test_near_copies_with_edited_words(spark):
    rng = np.random.default_rng(5)
    texts = []
    for edits in (0, 2, 3, 4, 6):  # a base and 30 copies with that many of 200 words edited
        base = [f"v{i}" for i in rng.integers(0, 5000, 200)]
        for _ in range(31):
            texts.append(" ".join(base))
            base = base if not edits else [*base]
            for at in rng.integers(0, 200, edits):
                base = [*base[:at], f"e{rng.integers(0, 1 << 30)}", *base[at + 1 :]]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    groups = {i: {i} for i in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[a]:
                    groups[x] = groups[a]
    expected = {i: min(groups[i]) for i in groups}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for few, part in ((8, 256), (2, 5), (100, 256)):
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame, few=few, part=part).collect()} == expected
    full = frame.selectExpr("doc_id", "text", "'en' AS lang", "'a' AS source", "length(text) AS n_chars")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, full, "").collect()} == set(expected.values())


def test_exploded_rows_are_not_sent_to_every_task(spark):
    """Spark sizes an explode by the rows that go into it, so a join would take its many rows for a table to broadcast."""
    prints = spark.range(100).selectExpr("id as print")
    marked = spark.range(100).selectExpr("0L as bucket", "id as print", "100L as n", "id as root")
    own = spark.range(100).selectExpr("id as print", "cast('' as binary) as text")
    for found in (simhash.links(prints), near_copies._dealt(marked, own, 2, across=True)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()


def test_near_copies_are_found_by_fingerprints():
    """Fingerprints within three bits share a table, and most copies that differ in a word of 2,000 are that near."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        own = int(rng.integers(0, 1 << 63))
        other = own
        for bit in rng.choice(64, 3, replace=False):
            other ^= 1 << int(bit)
        assert any((own ^ other) & mask == 0 for mask in near_copies._MASKS)
    hashes = rng.integers(0, 1 << 63, 5000, np.uint64)
    votes = [2 * sum(int(x) >> k & 1 for x in hashes) > len(hashes) for k in range(64)]
    assert near_copies.fingerprint(hashes) == sum(1 << k for k, vote in enumerate(votes) if vote)
    found = 0
    for _ in range(20):
        base = [f"v{i}" for i in rng.integers(0, 5000, 2000)]
        a, b = (near_copies.shingles(" ".join(w).encode()) for w in (base, [*base[:7], "x", *base[8:]]))
        assert set(near_copies.tables(a)) <= set(near_copies.buckets(a))
        near = (near_copies.fingerprint(a) ^ near_copies.fingerprint(b)).bit_count() <= 3
        found += near
        assert not near or set(near_copies.tables(a)) & set(near_copies.tables(b))
    assert found >= 10


@pytest.mark.parametrize(("which", "shard", "group"), [("docs", 50_000, 4096), ("clashing", 50_000, 4096), ("docs", 300, 2)])
def test_mixing(which, shard, group, request, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", shard)
    monkeypatch.setattr(mixing, "GROUP", group)
    found = [r for r in mixing.mix(request.getfixturevalue(which)).collect()]
    again = mixing.mix(request.getfixturevalue(which)).collect()
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in again)
    sizes = Counter()
    for _, x, _, source, _ in rows():
        sizes[source] += len(words(x))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    by_source = {i: s for i, _, _, s, _ in rows()}
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[by_source[r.doc_id]])
        taken[by_source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]), s
    assert len(found) == len(rows())


def test_sainte_lague(spark):
    votes = [("p", i, float(v)) for i, v in enumerate((53, 24, 23, 0, 10, 10))]
    for seats in (0, 1, 7, 50):
        quota, counts = Counter(), Counter()
        for _ in range(seats):
            i = max(range(6), key=lambda j: (votes[j][2] / (2 * counts[j] + 1), -j))
            counts[i] += 1
        frame = spark.createDataFrame([(*v, seats) for v in votes], "g string, i int, votes double, seats long")
        quota = {r.i: r.quota for r in mixing.sainte_lague(frame, ["g"], "votes", "seats", "i").collect()}
        assert quota == {i: counts[i] for i in range(6)}


TEXTS = ["", " ", "Hello  world's end\n\nnext\tline", "don't <|endoftext|> stop", "é é İ Σς ½ ②", "a b c", "日本語🙂", "x" * 500, "1234 5,6", "tab\tin\r\nlines  "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(name):
    own = tokens.Encoder(public_tokenizers.path(name))
    for x in TEXTS + [text(0, 50), text(9, 300).title(), text(3, 60_000), "y" * 20_000, "é" * 9000]:
        assert own.encode(x.encode()).tolist() == own.tokenizer.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize(("which", "file_bytes", "full"), [("docs", 8_000_000, 64_000_000), ("docs", 2000, 300), ("clashing", 40_000, 5000)])
def test_records_round_trip(which, file_bytes, full, request, tmp_path):
    docs = request.getfixturevalue(which)
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = records.write_records(docs, path, end_id=1, folder=str(tmp_path / "out"), file_bytes=file_bytes, full=full)
    assert full > 1000 or manifest.count() > 4
    encode = tokens.Encoder(path).tokenizer.encode
    expected, start = [], 0
    key = lambda r: (r[0] is not None, r[0] or 0)
    for i, x, *_ in sorted(rows(), key=key):
        ids = encode(x or "", add_special_tokens=False).ids + [1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in records.read_records(manifest).collect()), key=lambda r: r[1]) == expected
    first = manifest.orderBy("file").first()
    index = records.load_index(first["index"])
    at = len(index["offset"]) - 1
    doc_id, ids = records.read_at(first.records, int(index["offset"][at]))
    assert len(ids) == index["n_tokens"][at] and (doc_id or 0) == index["doc_id"][at]
    with open(first.records.removeprefix("file://"), "r+b") as file:
        file.seek(20)
        byte = file.read(1)
        file.seek(20)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(ValueError, match="damaged"):
        records.read_at(first.records, 0)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_packing(which, request):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack_documents(request.getfixturevalue(which), path, end_id=2, capacity=256).collect()
    encode = tokens.Encoder(path).tokenizer.encode
    expected = Counter()
    for i, x, *_ in rows():
        ids = encode(x or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by_sequence) <= math.ceil(sum(r.length for r in found) / 256) + 2


def test_packing_plan():
    rng = np.random.default_rng(0)
    histogram = Counter(rng.integers(1, 1025, 5000).tolist()) + Counter({1024: 77, 512: 31, 341: 9, 342: 8, 1: 3})
    groups = packing.plan(dict(histogram))
    used = Counter()
    for count, items in groups:
        assert sum(n * k for n, k in items) <= 1024 and sum(k for n, k in items if 3 * n > 1024) <= 2
        for n, k in items:
            used[n] += count * k
    assert used == histogram
    assert sum(c for c, _ in groups) <= math.ceil(sum(n * c for n, c in histogram.items()) / 1024) * 1.03 + 2


def best_scores(ids, vectors, query_id, query, k):
    """Scores and ids of the k best candidates by brute force, ties to smaller ids; equal rows count each."""
    scores = vectors @ query
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != query_id][:k]
    return [(int(ids[j]), int(scores[j])) for j in order]


def answers(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


@pytest.mark.parametrize("sample", [0, 40, 2048])
def test_impact_search(spark, monkeypatch, sample):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(impact_search, "BLOCK", 70)
    vectors = rng.normal(size=(300, 8)).round(1) * rng.choice([1, 1, 40], size=(300, 1))
    vectors[100:160] = vectors[0]  # ties
    vectors[170:180] = 0
    ids = np.arange(300)
    ids[250:260] = 7  # repeated ids, also of a query
    ids[200] = 50
    data = [(int(i), [float(x) for x in v], "clash") for i, v in zip(ids, vectors)] + [(300, None, ""), (301, [1.0, None] + [0.0] * 6, ""), (302, [float("nan")] * 8, ""), (303, [1.0], ""), (350, [2.0], ""), (None, [1.0] * 8, ""), (304, [], "")]
    whole = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    ints = whole.filter(usable(F.col("embedding"))).withColumn("embedding", impact_search.quantised(F.col("embedding")))
    queries_ = ints.filter("vec_id % 50 = 0")
    got = answers(impact_search.exact_top_k(ints, queries_.union(queries_), 5, sample=sample))
    matrix = np.floor(256 * vectors).astype(np.int64)
    for q in (0, 100, 150):
        assert got[q] == [(rank, *x) for rank, x in enumerate(best_scores(ids, matrix, q, matrix[q], 5), 1)]
    two = [best_scores(ids, matrix, 50, matrix[i], 5) for i in (50, 200)]  # an id with two vectors asks twice
    assert got[50] == sorted((rank, *x) for found in two for rank, x in enumerate(found, 1))
    assert got[350] == [(1, 303, 2 * 256 * 256)] and 300 not in got
    assert impact_search.exact_top_k(ints.limit(0), ints.limit(0)).count() == 0
    one = ints.filter("vec_id in (0, 50)").limit(2)
    assert [(r.query_id, r.vec_id) for r in impact_search.exact_top_k(one, one.filter("vec_id = 0")).collect()] == [(0, 50)]


def test_tree_recall(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "BLOCK", 300)
    monkeypatch.setattr(ann_tree, "LIMB", 200)
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(size=(2500, 16)) + 2 * rng.normal(size=(1, 16)), np.tile(rng.normal(size=16), (1300, 1)), np.zeros((2, 16))]).astype(np.float32)
    data = [(i, v.tolist(), "clash") for i, v in enumerate(vectors)] + [(9000, None, ""), (9020, [float("inf")] * 16, ""), (None, vectors[0].tolist(), ""), (20, vectors[20].tolist(), ""), (9040, [1.0, 2.0], ""), (9041, [3.0, 1.0], ""), (9042, [3.0, 1.0], "")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    asked = frame.filter("vec_id % 20 = 0")
    found = answers(ann_tree.nearest(frame, asked.union(asked), 20, sample=1500))
    exact = vectors.astype(float)
    hits = total = 0
    for q in range(0, 3800, 20):
        scores = exact @ exact[q]
        scores[[q, 3800, 3801]] = -np.inf
        true = np.lexsort((np.arange(len(scores)), -scores))[:20]
        hits += len({v for _, v, _ in found[q]} & set(true.tolist()))
        total += 20
        assert [r for r, _, _ in found[q]] == list(range(1, 21))
        assert all(s == pytest.approx(scores[v]) for _, v, s in found[q])
    assert hits / total >= 0.9 and 9020 not in found and 3800 not in found
    assert found[9040] == [(1, 9041, 5.0), (2, 9042, 5.0)]
    assert ann_tree.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(3)
    centres = 4 * rng.normal(size=(40, 8))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))
    tree = ann_tree.grow(vectors, leaf=20)
    ends = tree.assign(vectors)
    assert np.bincount(ends).max() <= 40 and tree.leaves == len(np.unique(ends))
    trunk = ann_tree.Trunk(tree, np.arange(500), vectors[:500])
    marks = trunk.marks(np.arange(1000, 1100), vectors[1000:1100])
    need = tree.needed(vectors[1000:1100], marks)
    for i, mark in enumerate(marks):
        assert sorted(tree.best_bins(vectors[1000 + i], mark, 0.5)) == np.flatnonzero(need[i] <= 0.5).tolist()
    assert (need <= 0.5).mean() < 0.2


def test_language(spark, docs, empty):
    train = [(i, " ".join(f"the of and {'ing'.join(WORDS[i % 9 : i % 9 + 2])}" if i % 2 else f"le la des {'eau'.join(WORDS[i % 9 : i % 9 + 2])}" for _ in range(5)), "en" if i % 2 else "fr") for i in range(200)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    got = {r.text: (r.lang_pred, r.score) for r in spark.createDataFrame([(1, "the running"), (2, "le beau"), (3, None), (4, "12 ..."), (5, "")], "doc_id long, text string").join(langid.predict(spark.createDataFrame([(1, "the running"), (2, "le beau"), (3, None), (4, "12 ..."), (5, "")], "doc_id long, text string"), model), "doc_id").collect()}
    assert got["the running"][0] == "en" and got["le beau"][0] == "fr"
    assert got[None] == got["12 ..."] == got[""] == ("und", 0.0)
    assert langid.predict(docs, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(docs, langid.fit(docs)).count() == len(rows())


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_language_equals_brute_force(spark, which, request):
    """Every prediction by counting anew: words first, then the longest n-grams of which any is known."""
    rng = np.random.default_rng(8)
    syllables = {"aa": "ba ke lo mi nu".split(), "bb": "ka lo mé sti ru".split(), "cc": "日 本 語 lo".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))).title() + rng.choice(["", ",", "-x"]) for _ in range(n))
    langs = [("aa", "bb", "cc")[i % 7 % 3] for i in range(150)]
    texts = [make(lang, 12) for lang in langs]
    frame = spark.createDataFrame([(i, x, lang) for i, (x, lang) in enumerate(zip(texts, langs))] + [(None, texts[0], "aa"), (500, None, "bb"), (501, texts[1], None)], "doc_id long, text string, lang string")
    asked = request.getfixturevalue(which).select("doc_id", "text").union(frame.select("doc_id", "text"))
    words_of = lambda x: re.findall(r"[^\W\d_]+", (x or "").lower())
    pieces = lambda w, k: [w[i : i + k] for i in range(len(w) - k + 1)] if k == 1 else [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]
    counts = {k: {lang: Counter() for lang in syllables} for k in range(6)}  # 0: words
    for i, x, lang in frame.collect():
        if x and lang and zlib.crc32(str("" if i is None else i).encode()) % 5:
            for w in words_of(x):
                counts[0][lang][w] += 1
                for k in range(1, 6):
                    counts[k][lang].update(pieces(w, k))
    names, known = sorted(syllables), {k: set().union(*counts[k].values()) for k in counts}
    logs = lambda k, key: np.array([math.log(counts[k][x][key] + 0.5) - math.log(sum(counts[k][x].values()) + 0.5 * len(known[k])) for x in names])

    def score(w):
        if w in known[0]:
            return logs(0, w)
        for k in range(5, 0, -1):
            found = [logs(k, g) for g in pieces(w, k) if g in known[k]]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(names))

    def predict(x):
        total = sum((score(w) for w in words_of(x)), np.zeros(len(names)))
        if not words_of(x):
            return "und", 0.0
        best = int(np.argmax(total))
        return names[best], round(1 / np.exp(np.maximum(total - total[best], -700)).sum(), 9)

    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(asked, langid.fit(frame)).collect())
    assert got == Counter((i, *predict(x)) for i, x in asked.collect())


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(5)
    def passage(bad):
        w = [WORDS[k] for k in rng.integers(0, 400, 80)]
        if bad:
            for k in rng.integers(0, 80, 4):
                w[k] = f"vile{k % 5}"
        return " ".join(w)

    found = [(i, passage(i % 8 == 0), int(i % 8 == 0)) for i in range(1200)]
    frame = spark.createDataFrame([(i, x) for i, x, _ in found], "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame([(i, 1, y) for i, _, y in found], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(frame, model).select("doc.doc_id", "score", "predicted", "passages").collect()}
    held = [(i, y) for i, _, y in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert all(got[i].passages for i, y in held if y) and all(0 <= got[i].score <= 1 for i, _ in held)
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs.withColumn("score", F.lit("clash")), none).filter("predicted = 1").count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_maximal_segments():
    scores = np.array([1.0, -0.5, 2.0, -4.0, 3.0, -1.0, 0.5])
    assert toxicity.maximal_segments(scores) == [(0, 3, 2.5), (4, 5, 3.0), (6, 7, 0.5)]
    assert toxicity.maximal_segments(np.array([-1.0, 0.0])) == []
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 60):
        for _ in range(20):
            s = rng.normal(-0.2, 1, n)
            assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == all_segments(s, 0, n)
            assert [x for _, _, x in toxicity.maximal_segments(s)] == pytest.approx([s[a:b].sum() for a, b in all_segments(s, 0, n)])


def all_segments(s, low, high):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    best, a, b = max(((s[i:j].sum(), i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0))
    return [] if best <= 0 else all_segments(s, low, a) + [(a, b)] + all_segments(s, b, high)


def test_toxicity_scores_equal_brute_force(spark, docs, clashing):
    """Scores and passages from all segments of every document, by the definition."""
    rng = np.random.default_rng(9)
    odds = {w.encode(): float(x) for w, x in zip(WORDS[:60], rng.normal(0, 1.5, 60))} | {b"abcd*": 2.5, b"abcdef*": -1.0}
    model = toxicity.Model(odds, lam=0.7, k=0.4, slope=1.3, shift=-2.0)
    frame = docs.filter("length(text) < 600 or text is null").select("doc_id", "text").union(spark.createDataFrame([(700 + i, " ".join([WORDS[k] if k < 90 else "(Abcdefgh)," if k < 95 else "abcde!" for k in rng.integers(0, 100, 50)])) for i in range(20)], "doc_id long, text string"))
    def value(w):
        bare = re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", w.lower())
        for key in (bare, *[bare[:n] + "*" for n in (6, 5, 4) if len(bare) > n]):
            if key.encode() in odds:
                return odds[key.encode()] - 0.2
        return -0.2

    expected = Counter()
    for i, x in frame.collect():
        s = np.array([value(w) for w in words(x)])
        found = all_segments(s, 0, len(s))
        sums = [float(s[a:b].sum()) for a, b in found]
        base = math.log(0.4 * max(1, len(s)))
        above = [0.7 * v - base for v in sums if 0.7 * v > base]
        evidence = math.asinh(sum(above) if above else 0.7 * max(sums, default=0.0) - base)
        shown = tuple((a, b) for (a, b), v in zip(found, sums) if 0.4 * max(1, len(s)) * math.exp(-0.7 * v) < 1)
        expected[i, round(1 / (1 + math.exp(2.0 - 1.3 * evidence)), 9), shown] += 1
    for extra in ({}, {"score": F.lit("clash"), "passages": F.lit(1), "doc": F.lit("x")}):
        got = toxicity.score(frame.withColumns(extra) if extra else frame, model).select("doc.doc_id", "score", "predicted", "passages").collect()
        assert Counter((r.doc_id, round(r.score, 9), tuple((x.start, x.end) for x in r.passages)) for r in got) == expected
        assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    lattice = lm_scoring.Lattice(path, {300: 5, 1000: 2}, 3)

    def total(x):
        if not x:
            return 1.0
        ways = [math.exp(lattice.pieces[x[:n]]) * total(x[n:]) for n in range(1, len(x) + 1) if x[:n] in lattice.pieces]
        if x[0] not in lattice.pieces:
            ways.append(math.exp(sum(lattice.bytes[b] for b in x[0].encode())) * total(x[1:]))
        return sum(ways)

    for word in ("the", "straße", "日x", "aaaa", "\U0001f642"):
        assert lattice.word(word.encode()) == pytest.approx(math.log(total(lm_scoring.SPACE + word)))
    whole = sum(math.exp(p) for p in [*lattice.pieces.values(), *lattice.bytes.values()]) + math.exp(lattice.end)
    assert whole == pytest.approx(1.0, abs=1e-3)


def test_rank_law_is_likeliest():
    rng = np.random.default_rng(5)
    ranks = np.arange(2000.0)
    for s, q in ((0.7, 30.0), (1.6, 3.0), (0.0, 1.0)):
        p = (ranks + q) ** -s
        counts = rng.multinomial(200_000, p / p.sum())
        logs = lm_scoring.rank_law(ranks, counts)
        assert np.exp(logs).sum() == pytest.approx(1)
        assert counts @ logs >= counts @ (np.log(p) - np.log(p.sum())) - 5
    assert lm_scoring.rank_law(ranks, 0 * ranks)[0] > lm_scoring.rank_law(ranks, 0 * ranks)[9]


@pytest.mark.parametrize("learn_pieces", [False, True])
def test_lm_scores_are_marginal_probabilities(docs, learn_pieces):
    """Each document's score against a backward sum over all segmentations of its whole text, words not taken apart."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
    lower = lambda x: " ".join(w.translate({c: c + 32 for c in range(65, 91)}) for w in words(x))
    train = [x for i, x, *_ in rows() if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    counts = Counter(i for x in train for w in lower(x).split() for i in vocabulary.encode(w))
    lattice = lm_scoring.Lattice(path, counts, len(train), learn_pieces)
    assert math.exp(lattice.end) == pytest.approx((len(train) + 0.5) / (sum(counts.values()) + len(train) + 1))
    assert sum(math.exp(p) for p in [*lattice.pieces.values(), *lattice.bytes.values()]) + math.exp(lattice.end) == pytest.approx(1)

    def marginal(x):
        whole = lm_scoring.SPACE + x.replace(" ", lm_scoring.SPACE) if x else ""
        sums = [0.0] * (len(whole) + 1)
        for i in range(len(whole) - 1, -1, -1):
            ways = [lattice.pieces[whole[i:j]] + sums[j] for j in range(i + 1, min(len(whole), i + 20) + 1) if whole[i:j] in lattice.pieces]
            if whole[i] not in lattice.pieces:
                ways.append(sum(lattice.bytes[b] for b in whole[i].encode()) + sums[i + 1])
            sums[i] = float(np.logaddexp.reduce(ways))
        return (sums[0] + lattice.end) / math.log(10)

    assert lattice.longest <= 20
    expected = sorted((-1 if i is None else i, marginal(lower(x))) for i, x, *_ in rows())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in lm_scoring.score(docs, path, hot_words=20, learn_pieces=learn_pieces).collect())
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert [x for _, x in got] == pytest.approx([x for _, x in expected], rel=1e-9)


def test_lm_base_scores(docs, clashing, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lower = lambda x: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(x)] + [None]
    train = Counter()
    for i, x, *_ in rows():
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            train.update(lower(x))
    n, v = sum(train.values()), len(train)
    expected = Counter()
    for i, x, *_ in rows():
        w = lower(x)
        expected[i, len(w), sum(train[t] > 0 for t in w), n, round(sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w), 4)] += 1
    for frame, hot in ((docs, 200_000), (clashing, 5)):
        got = lm_scoring.score(frame, path, hot_words=hot, word_arcs=hot == 5).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score(empty, path).count() == 0


def test_lm_query_is_near_the_base_score(spark):
    """Held-out texts by the query's model; by the vocabulary's ranks alone they cost more than twice the base score."""
    found = llm_queries.op9_lm_scoring(spark, "/root/testdata/sf0.001").filter("held_out").collect()
    assert found and all(r.score is not None and math.isfinite(r.score) for r in found)
    assert sum(r.score for r in found) > 1.4 * sum(r.base_score for r in found)


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert packing.pack_documents(empty, path, 2).count() == 0
    assert records.read_records(records.write_records(empty, path, 1)).count() == 0


PIPELINE = [name for name, _ in corpus_pipeline.STAGES]


def stage(spark, name, frame, tmp_path, labels=(), times=0):
    folder = str(tmp_path / f"{name.replace(' ', '-')}-{times}")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(corpus_pipeline.STAGES)[name](spark, frame, folder)


def plain(found):
    return Counter(tuple(r) for r in found.collect())


def test_pipeline_stages(spark, docs, tmp_path):
    assert PIPELINE == ["toxicity", "simhash near-dedup", "substring dedup", "mixing", "packing"]
    assert plain(stage(spark, "toxicity", docs, tmp_path, [(1, 1, 0)])) == plain(docs)  # one label teaches nothing
    single = stage(spark, "simhash near-dedup", docs, tmp_path)
    by_id = lambda r: (r[0] is not None, r[0] or 0)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (words(r[1]) for r in rows())]
    gone = {j for j, b in enumerate(sets) for i, a in enumerate(sets) if rows()[j][0] is not None and rows()[i][0] is not None and (by_id(rows()[i]), i) < (by_id(rows()[j]), j) and (a == b or (a | b and len(a & b) / len(a | b) >= 0.8))}
    assert plain(single) == Counter(r for j, r in enumerate(rows()) if j not in gone)
    whole = {(r.doc_id, r.text) for r in stage(spark, "substring dedup", docs, tmp_path).collect()}
    near = text(0, 120).split()
    near[60] = "edited"
    assert {(1, text(0, 120)), (5, ""), (7, "é 日本 🙂 ..."), (2, None), (3, ""), (4, " \n\t"), (9, " ".join(near[60:61]) if len(near[61:]) >= 13 else ""), (None, "")} <= whole
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    mixed = Counter()
    for r in stage(spark, "mixing", docs, tmp_path).collect():
        mixed[r.doc_id] += len(words(r.text))
    assert {i: n for i, n in plan.items() if n} == {i: n for i, n in mixed.items() if n}
    packed = stage(spark, "packing", docs, tmp_path)
    assert packed.select("doc_id").distinct().count() == len({r[0] for r in rows()})


def test_pipeline_rejects_toxic_documents(spark, tmp_path):
    calm = lambda i: " ".join(f"calm{(i * j) % 50}" for j in range(40))
    data = [(i, (calm(i) + (" rage hate filth" * 4 if i % 4 == 0 else "")) if i % 31 else None, "en", "a", 9) for i in range(600)] + [(None, "", "en", "a", 0), (601, "rage hate filth " * 5, None, None, None)]
    frame = spark.createDataFrame(data, DOCS)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(500) if i % 31] + [(None, 1, 1), (3, None, None), (900, 0, 1)]
    kept = stage(spark, "toxicity", frame, tmp_path, labels)
    assert kept.columns == frame.columns
    assert plain(kept) == Counter(r for r in data if "rage" not in (r[1] or ""))


def test_pipeline_keeps_texts_that_share_an_id(spark, tmp_path):
    one, two = text(0, 60), text(200, 60)
    data = [(1, one, "en", "a", 1), (1, two, "en", "a", 1), (1, one, "fr", "b", 1), (2, two, "en", "a", 1), (3, None, "en", "a", 7), (4, "", "en", "a", None), (None, one, "en", "a", 1), (None, one, "en", "a", 1)]
    frame = spark.createDataFrame(data, DOCS)
    kept = plain(stage(spark, "simhash near-dedup", frame, tmp_path))
    assert kept == Counter([data[0], data[1], data[4], data[6], data[7]])  # empty texts are copies of each other
    after = plain(stage(spark, "substring dedup", frame, tmp_path))
    assert after[data[4]] == 1 and after[data[5]] == 1 and after[(2, "", "en", "a", 0)] == 1


def test_pipeline_with_columns_of_any_type(spark, docs, tmp_path):
    more = docs.withColumns({"m": F.create_map(F.lit("k"), F.col("n_chars")), "b": F.lit(b"x"), "v": F.array(F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(2))))})
    kept = stage(spark, "simhash near-dedup", more, tmp_path)
    assert kept.columns == more.columns and plain(kept.select(*docs.columns)) == plain(stage(spark, "simhash near-dedup", docs, tmp_path, times=1))


@pytest.mark.parametrize("name", PIPELINE)
def test_pipeline_on_clashing_and_empty_tables(spark, docs, clashing, empty, name, tmp_path):
    labels = [(r[0], 1, int(r[0] % 2)) for r in rows() if r[0] is not None]
    base, more = stage(spark, name, docs, tmp_path, labels), stage(spark, name, clashing, tmp_path, labels, 1)
    if name == "packing":
        assert plain(base.drop("sequence_id", "offset")) == plain(more.drop("sequence_id", "offset"))
    else:
        assert more.columns == clashing.columns
        assert plain(base) == plain(more.select(*docs.columns))
    assert stage(spark, name, empty, tmp_path, labels, 2).count() == 0
    assert stage(spark, name, empty, tmp_path, [], 3).count() == 0


def test_pipeline_run(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert packed
    for places in by_sequence.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024


def test_impact_search_refuses_what_leaves_64_bits(spark):
    data = [(1, [2**31, 1]), (2, [2**33, 0]), (3, [1, 1])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<long>")
    with pytest.raises(ValueError, match="64 bits"):
        impact_search.exact_top_k(frame, frame)
    fits = frame.filter("vec_id <> 2")
    assert [(r.query_id, r.vec_id, r.score) for r in impact_search.exact_top_k(fits, fits).orderBy("query_id").collect()] == [(1, 3, 2**31 + 1), (3, 1, 2**31 + 1)]
