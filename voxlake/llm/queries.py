"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import ann_tree, impact_search, langid, lm_scoring, merkle, mixing, packing, records, simhash, substring_dedup, suffix_dedup, toxicity, whitening
from voxlake.llm.common import fold, table
from voxlake.llm.merkle_sql import OP11_SQL
from voxlake.llm.vectors import usable


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.drop("lang"), langid.fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op2_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(usable(F.col("embedding")))
    whole = vectors.select("vec_id", impact_search.quantised(F.col("embedding")).alias("embedding"))
    return impact_search.exact_top_k(whole, whole.filter("vec_id % 50 = 0"), k=5)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _seats_sql(rows: str, votes: str, tie: str, group: str, keep: str, name: str) -> str:
    """Highest quotients votes / (2k + 1) within a group, around the rounded share of each part."""
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    order = f"OVER ({f'PARTITION BY {group} ' if group else ''}ORDER BY {votes} / (2 * k + 1) DESC, {tie}, k)"
    return f"""{name}1 AS (SELECT *, CASE WHEN seats > 0 AND {votes} > 0 THEN CAST(floor({votes} / (CAST(sum({votes}) {over} AS DOUBLE) / seats) + 0.5) AS BIGINT) ELSE 0 END AS near FROM {rows}),
{name}2 AS (SELECT *, CAST(abs(seats - sum(near) {over}) + 1 AS BIGINT) AS slack FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN {votes} > 0 THEN greatest(0, near - slack) ELSE 0 END AS least_seats FROM {name}2),
{name}4 AS (SELECT *, seats - sum(least_seats) {over} AS open_seats FROM {name}3),
{name}5 AS (SELECT *, unnest(CASE WHEN {votes} > 0 THEN range(CAST(least_seats AS BIGINT), CAST(near + slack + 1 AS BIGINT)) ELSE [CAST(0 AS BIGINT)] END) AS k FROM {name}4),
{name}6 AS (SELECT *, row_number() {order} <= open_seats AND {votes} > 0 AS won FROM {name}5),
{name} AS (SELECT {keep}, CAST(min(least_seats) + count(*) FILTER (WHERE won) AS BIGINT) AS quota FROM {name}6 GROUP BY {keep})"""


_BEFORE = "OVER (ORDER BY lim / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _chosen_sql(x: str) -> str:
    return f"((({x}) * more + first_block) // n - first_block // n)"


def _words_sql(x: str) -> str:
    return f"(base * {x} + block * {_chosen_sql(f'{x} // block')} + ({x} % block) * ({_chosen_sql(f'{x} // block + 1')} - {_chosen_sql(f'{x} // block')}))"


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS seeded FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS ord FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][(ord - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS lim FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights, coalesce(sum(lim) {_BEFORE}, 0) AS before, coalesce(sum(weight) {_BEFORE}, 0) AS weights_before FROM s2),
s4 AS (SELECT *, lim * (weights - weights_before) <= weight * (total - before) AS limited FROM s3),
s5 AS (SELECT *, coalesce(sum(lim) FILTER (WHERE limited) OVER (), 0) AS gone, coalesce(sum(weight) FILTER (WHERE limited) OVER (), 0) AS weights_gone FROM s4),
s6 AS (SELECT source, ord, source_size, total, CASE WHEN limited THEN lim ELSE weight * (total - gone) / (weights - weights_gone) END AS target FROM s5),
s7 AS (SELECT *, greatest(1, least(64, CAST(floor(coalesce(min(target) FILTER (WHERE target > 0) OVER (), 0) / 100) AS BIGINT))) AS block, greatest(1, CAST(floor(source_size / 50000.0) AS BIGINT)) AS shards FROM s6),
s8 AS (SELECT *, CAST(floor(total / block + 0.5) AS BIGINT) AS seats FROM s7),
{_seats_sql("s8", "target", "ord", "", "source, ord, source_size, target, block, shards", "a")},
e AS (SELECT d.doc_id, d.size, d.seeded, a.*, CAST('0x' || substr(d.seeded, 17, 8) AS BIGINT) % shards AS shard FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
l AS (SELECT ord, shard, block, quota AS seats, CAST(sum(size) AS BIGINT) AS line FROM e GROUP BY ord, shard, block, quota),
{_seats_sql("l", "line", "shard", "ord", "ord, shard, block, line", "b")},
c AS (SELECT ord, shard, quota, greatest(1, CAST(ceil(line / block) AS BIGINT)) AS n FROM b),
f AS (SELECT ord, shard, n, least(quota, 3 * n) // n AS base, least(quota, 3 * n) % n AS more, CAST('0x' || substr(md5('0:' || ord || ':' || shard), 1, 8) AS BIGINT) % n AS first_block FROM c),
g AS (SELECT e.*, f.n, f.base, f.more, f.first_block, CAST(sum(size) OVER (PARTITION BY e.ord, e.shard ORDER BY seeded, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM e JOIN f ON e.ord = f.ord AND e.shard = f.shard)
SELECT doc_id, size, source_size, target, CAST({_words_sql("stop")} - {_words_sql("(stop - size)")} AS BIGINT) AS taken FROM g
"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return records.read_records(records.write_records(docs, tokenizer_file("word_bpe_49k.json"), end_id=1))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc.doc_id", (fold(F.col("doc.doc_id")) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
r AS (SELECT DISTINCT k.doc_id, k.i + j.j AS pos FROM k JOIN m ON k.h = m.h AND m.least < k.doc_id CROSS JOIN (SELECT unnest(range(13)) AS j) j),
g AS (SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id),
x AS (SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM x
"""


def op8_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_tree.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_scoring.score(docs, tokenizer_file("piece_bpe_32k.model"), learn_pieces=True, word_arcs=True)
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.document_manifest(docs).drop("proof")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT row, doc_id, unnest(range(length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100),
k AS (SELECT p.row, p.doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS h FROM p JOIN d ON p.row = d.row),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
r AS (SELECT k.row, k.i, coalesce(k.i > lag(k.i) OVER (PARTITION BY k.row ORDER BY k.i) + 50, true) AS opens FROM k JOIN m ON k.h = m.h AND m.least < k.doc_id),
g AS (SELECT row, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY row ORDER BY i) AS span FROM r),
s AS (SELECT row, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY row, span),
e AS (SELECT row, a, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a) AS before FROM s),
l AS (SELECT s.row, string_agg(substr(x, 2 * before + 1, 2 * (s.a - before)), '' ORDER BY s.a) || substr(any_value(x), 2 * max(b) + 1) AS kept, sum(b - s.a) AS gone, count(*) AS n FROM s JOIN e ON s.row = e.row AND s.a = e.a JOIN d ON s.row = d.row GROUP BY s.row)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN l ON d.row = l.row
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_impact_search": op2_impact_search,
    "op3_mixing": op3_mixing,
    "op4_records": op4_records,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_ann_tree": op8_ann_tree,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op2_impact_search": OP2_SQL, "op3_mixing": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op11_merkle": OP11_SQL, "op12_suffix_dedup": OP12_SQL}
