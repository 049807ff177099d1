"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets by water filling, blocks to sources and then to each source's shards by highest quotients, and a seeded
choice of blocks within each shard. A shard is a line of words: its documents in seeded order, cut into blocks of
equal length. With a quota of q blocks out of n, every block is taken q div n times and q mod n blocks once more,
spread evenly from a seeded start; so what a document gives follows from its place on the line, and no table of
blocks is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm.common import WORD_PATTERN, cut, lean, texts_of

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
REPEATS = 3
#: Words in a block at most; a hundredth of the smallest target if that is less, one at least.
BLOCK = 64
#: Words in a shard, about, and shards that are apportioned together; groups of shards come before them.
SHARD, GROUP = 50_000, 4096
SEED = 0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _order(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _number(digest: Column, at: int) -> Column:
    """Eight hex digits of a digest as a number."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per source its order, size, weight and target, from rows of ``source`` and ``size``.

    Sources weigh ``weights`` in the order of their names by code point, null last, and share the sum of all sizes;
    a target stops at ``repeats`` times its source's size and the excess is shared anew by weight. Sources come in
    the order in which they reach their limit, so the limited ones are a prefix. One row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    found = by_source.select("*", F.row_number().over(by_name).alias("ord"))
    found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("ord") - 1) % len(weights) + 1).cast("int")).cast("double"))
    found = found.withColumn("limit", (F.col("source_size") * repeats).cast("double"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("limit") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("*", F.sum("source_size").over(every).cast("double").alias("all"), F.sum("weight").over(every).alias("weights"), F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("before"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weights_before"))
    found = found.withColumn("limited", F.col("limit") * (F.col("weights") - F.col("weights_before")) <= F.col("weight") * (F.col("all") - F.col("before")))
    found = found.select("*", F.coalesce(F.sum(F.when(F.col("limited"), F.col("limit"))).over(every), F.lit(0.0)).alias("gone"), F.coalesce(F.sum(F.when(F.col("limited"), F.col("weight"))).over(every), F.lit(0.0)).alias("weights_gone"))
    share = F.col("weight") * (F.col("all") - F.col("gone")) / (F.col("weights") - F.col("weights_gone"))
    return found.select("source", "ord", "source_size", "all", F.when(F.col("limited"), F.col("limit")).otherwise(share).alias("target"))


def sainte_lague(parts: DataFrame, group: list[str], votes: str, seats: str, tie: str) -> DataFrame:
    """Adds ``quota``: the seats of each part of a group by the highest quotients votes / (2k + 1), ties to the smaller ``tie``.

    Each part starts from its votes over the mean votes of a seat, rounded; these sum up to nearly the seats. What
    is missing or over, d seats, can move a part by d at most, so only the quotients around the start are compared.
    """
    whole = Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.sum(votes).over(whole).cast("double") / F.col(seats)
    near = parts.withColumn("near", F.when((F.col(seats) > 0) & (F.col(votes) > 0), F.floor(F.col(votes) / mean + 0.5)).otherwise(0).cast("long"))
    near = near.withColumn("slack", F.abs(F.col(seats) - F.sum("near").over(whole)) + 1)
    near = near.withColumn("floor", F.when(F.col(votes) > 0, F.greatest(F.lit(0).cast("long"), F.col("near") - F.col("slack"))).otherwise(0))
    near = near.withColumn("open", F.col(seats) - F.sum("floor").over(whole))
    tries = near.withColumn("k", F.explode(F.when(F.col(votes) > 0, F.sequence("floor", F.col("near") + F.col("slack"))).otherwise(F.array(F.lit(0).cast("long")))))
    by_quotient = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("k") + 1)).desc(), tie, "k")
    won = tries.withColumn("won", (F.row_number().over(by_quotient) <= F.col("open")) & (F.col(votes) > 0))
    return won.groupBy(*parts.columns, "floor").agg((F.first("floor") + F.sum(F.col("won").cast("long"))).alias("quota")).drop("floor")


def block_quotas(slim: DataFrame, seed: int = SEED, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """The sources with targets and the shards with quotas, from rows of ``doc_id``, ``source`` and ``size``."""
    sources = targets(slim, weights, repeats)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.coalesce(least, F.lit(0.0)) / 100))).cast("long"))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.floor(F.col("source_size") / SHARD)).cast("long")).withColumn("one", F.lit(1))
    sources = sources.withColumn("blocks", F.floor(F.col("all") / F.col("block") + 0.5).cast("long"))
    sources = cut(sainte_lague(sources, ["one"], "target", "blocks", "ord").drop("one", "blocks", "all"), "sources")
    lines = on_shards(slim, sources, seed).groupBy("ord", "shard", "block", "quota").agg(F.sum("size").alias("line"))
    lines = cut(lines.withColumn("group", F.expr(f"shard div {GROUP}")), "lines")
    groups = lines.groupBy("ord", "group", F.col("quota").alias("seats")).agg(F.sum("line").alias("votes"))
    groups = sainte_lague(groups, ["ord"], "votes", "seats", "group").select("ord", "group", F.col("quota").alias("seats"))
    shards = sainte_lague(lines.drop("quota").join(groups, ["ord", "group"]), ["ord", "group"], "line", "seats", "shard").drop("seats", "group")
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("line") / F.col("block")).cast("long"))
    shards = shards.withColumn("n", n).withColumn("quota", F.least("quota", F.col("n") * repeats)).select("ord", "shard", "n", F.expr("quota div n").alias("base"), F.expr("quota % n").alias("more"), F.pmod(_number(F.md5(F.concat_ws(":", F.lit(str(seed)), "ord", "shard").cast("binary")), 1), F.col("n")).alias("first"))
    return sources, cut(shards, "shards")


def on_shards(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    keyed = docs.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    return keyed.withColumn("at", _order(F.col("doc_id"), seed)).withColumn("shard", F.pmod(_number(F.col("at"), 17), F.col("shards")))


def _chosen(x: str) -> str:
    """Of the first x blocks of a shard, how many are taken once more."""
    return f"((({x}) * more + first) div n - first div n)"


def _words(x: str) -> str:
    """Words taken from the first x words of a shard's line, repeats counted."""
    return f"(base * ({x}) + block * {_chosen(f'({x}) div block')} + (({x}) % block) * ({_chosen(f'({x}) div block + 1')} - {_chosen(f'({x}) div block')}))"


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None, seed: int = SEED, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """What a mix takes from each document: ``doc`` (struct of the columns ``keep``), ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and the place on its shard's line.

    One row per input row; words are runs of other characters than ASCII white space, null texts have none. A null
    source is a source of its own. No document gives more than ``repeats`` times its size. Rows with equal ids lie
    side by side in any order of equal sizes. An empty table gives no rows.
    """
    keep = [id_col] if keep is None else keep
    sized = docs.select(F.struct(*keep).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    slim = cut(sized.select("doc_id", "source", "size", "doc") if text_col not in keep else sized.select("doc_id", "source", "size"), "sizes")
    sources, shards = block_quotas(slim.select("doc_id", "source", "size"), seed, block, weights, repeats)
    placed = on_shards(slim if text_col not in keep else sized, sources, seed).join(shards, ["ord", "shard"])
    line = Window.partitionBy("ord", "shard").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))
    taken = F.expr(f"{_words('`end`')} - {_words('start')}")
    return placed.select("doc", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "start", "block", "n", "base", "more", "first")


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        numbers = {k: columns[k].to_pylist() for k in ("size", "start", "block", "n", "base", "more", "first")}
        at, texts, whole = [], [], []
        for i, text in enumerate(texts_of(columns["text"])):
            size, start, block, n, base, more, first = (numbers[k][i] for k in numbers)
            x = np.arange(start, start + size) // block
            chosen = ((x + 1) * more + first) // n > (x * more + first) // n
            at += [i] * base
            texts += [None] * base
            if chosen.any():
                at.append(i)
                texts.append(None if chosen.all() else b" ".join([w for w, c in zip(text.split(), chosen.tolist(), strict=True) if c]))
        yield pa.RecordBatch.from_arrays([columns["doc"].take(pa.array(at, pa.int64())), pa.array(texts, pa.binary())], ["doc", "part"])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: ``doc`` (struct of all columns of the document) and ``part``.

    A document is there once for each whole pass (``part`` null), and once more with the words of the chosen blocks
    alone, joined by one space, where they aren't all of it.
    """
    plan = mix(docs, id_col, source_col, text_col, keep=docs.columns, **options).filter("taken > 0")
    rows = plan.select("doc", F.col("doc")[text_col].cast("binary").alias("text"), "size", "start", "block", "n", "base", "more", "first")
    return rows.mapInArrow(lean(_given), f"doc {rows.schema['doc'].dataType.simpleString()}, part binary").withColumn("part", F.col("part").cast("string"))
