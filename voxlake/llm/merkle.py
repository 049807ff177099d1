"""Merkle manifest of a dataset: a tree of fan-out 8 in each group, one above the groups, and a proof for every row.

Proofs come by pointer jumping. Every node first points at its parent and holds the sibling digests of that step; a
self-join replaces each pointer by the ancestor's own pointer and appends its segments, so the distance doubles until
every leaf points at the root. A join of distance d meets at most 8**d rows for an ancestor, and as soon as few
ancestors are left they are broadcast, so no key gathers a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm.common import cut

FAN_OUT = 8
#: Ancestors whose pointers every task gets, at most; beyond that the join shuffles, and an ancestor has few rows.
BROADCAST_ANCESTORS = 10_000
#: The tree above the groups.
TOP = -1
_SEGMENTS = "array<struct<left:binary,right:binary>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """The SHA-256 of all parts together, as 32 bytes; nodes enter a digest as lowercase hex."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(node: Column) -> Column:
    """Lowercase hex of one digest or of several in a row."""
    return F.lower(F.hex(node))


def _ordered(rows: DataFrame, order: list[Column], group: str, name: str) -> DataFrame:
    """Adds ``name``: a row's number from 0 within its group, whose rows follow ``order`` (that begins with the group).

    Spark ranges and sorts the rows, so that a large group lies in many parts; only counts of (part, group) are summed.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), name)
    runs = placed.groupBy("_part", F.col(group).alias("_run_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_run_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("_part").alias("_run"), "_run_group", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    found = placed.join(starts, (F.col("_part") == F.col("_run")) & F.col(group).eqNullSafe(F.col("_run_group")))
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def _runs(nodes: DataFrame) -> DataFrame:
    """Every eight consecutive nodes of a level (t, l, i, node): ``members`` in order and their digest ``up``."""
    runs = nodes.groupBy("t", "l", F.floor(F.col("i") / FAN_OUT).alias("p")).agg(F.sort_array(F.collect_list(F.struct("i", "node"))).alias("members"))
    return runs.withColumn("members", F.expr("transform(members, m -> m.node)")).withColumn("up", digest(text_of(_joined(F.col("members")))))


def _joined(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(b""), lambda all_, node: F.concat(all_, node))


def _levels(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """All runs of the trees above leaves (t, i, node), the trees' roots (t, node, height) and the greatest height."""
    level = leaves.select("t", F.lit(0).alias("l"), "i", "node")
    all_runs, roots, height = None, None, 0
    sizes = leaves.groupBy("t").agg(F.count("*").alias("n"))
    level = level.join(sizes, "t")
    while True:
        done = level.filter("n = 1").select("t", "node", F.col("l").alias("height"))
        roots = done if roots is None else roots.unionByName(done)
        more = level.filter("n > 1")
        runs = cut(_runs(more.drop("n")).join(sizes, "t"), f"level-{height}")
        if runs.isEmpty():
            return (runs.drop("n") if all_runs is None else all_runs), roots, height
        all_runs = runs.drop("n") if all_runs is None else all_runs.unionByName(runs.drop("n"))
        height += 1
        sizes = runs.groupBy("t").agg(F.count("*").alias("n"))
        level = runs.select("t", F.lit(height).alias("l"), F.col("p").alias("i"), F.col("up").alias("node")).join(sizes, "t")


def _children(runs: DataFrame) -> DataFrame:
    """One row for each member of a run: the pointer to its parent and the siblings left and right of it."""
    rows = runs.select("t", "l", "p", "members", F.posexplode("members").alias("at", "node"))
    side = F.struct(_joined(F.expr("slice(members, 1, at)")).alias("left"), _joined(F.expr("slice(members, at + 2, 8)")).alias("right"))
    return rows.select("t", "l", (F.col("p") * FAN_OUT + F.col("at")).alias("i"), F.col("t").alias("at"), (F.col("l") + 1).alias("al"), F.col("p").alias("ai"), F.array(side).cast(_SEGMENTS).alias("proof"))


def _jump(rows: DataFrame, ancestors: DataFrame, few: bool) -> DataFrame:
    """Each pointer replaced by that of the node it points at, whose segments follow."""
    far = ancestors.select(F.col("t").alias("at"), F.col("l").alias("al"), F.col("i").alias("ai"), F.col("at").alias("_t"), F.col("al").alias("_l"), F.col("ai").alias("_i"), F.col("proof").alias("_proof"))
    found = rows.join(F.broadcast(far) if few else far, ["at", "al", "ai"], "left")
    new = {"at": F.coalesce("_t", "at"), "al": F.coalesce("_l", "al"), "ai": F.coalesce("_i", "ai"), "proof": F.concat("proof", F.coalesce("_proof", F.array().cast(_SEGMENTS)))}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(proof, leaf, lambda node, step: digest(text_of(step["left"]), text_of(node), text_of(step["right"])))


def manifest(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """A row for each input row (``leaf``, and any columns to keep): ``subroot``, ``root``, ``proof`` and all columns.

    ``leaf`` is a digest of 32 bytes. Leaves of a group ascend by the id (null first, equal ids by leaf); groups ascend
    as strings by their bytes, null first. ``proof`` holds the siblings left and right of the path, step by step to the
    root; it is empty for a single row. An empty table gives no rows.
    """
    order = [F.col(group).asc_nulls_first(), F.col(id_col).asc_nulls_first(), F.col("leaf")]
    placed = _ordered(cut(rows, "leaves"), order, group, "i")
    groups = cut(_ordered(placed.select(F.col(group).alias("_name")).distinct().withColumn("_one", F.lit(0)), [F.col("_one"), F.col("_name").asc_nulls_first()], "_one", "t").select("_name", "t"), "groups")
    # a group has one row in this table, and a large group many in the other: few groups go to every task
    names = F.broadcast(groups) if groups.count() <= BROADCAST_ANCESTORS else groups
    leaves = cut(placed.join(names, F.col(group).eqNullSafe(F.col("_name"))).drop("_name"), "placed")
    runs, subroots, height = _levels(leaves.select("t", "i", F.col("leaf").alias("node")))
    subroots = cut(subroots, "subroots")
    # written, as a join by a tree that is one constant would be none by key
    top = cut(subroots.select(F.lit(TOP).cast("long").alias("t"), F.col("t").alias("i"), "node"), "top")
    top_runs, roots, top_height = _levels(top)
    steps = height + top_height + 1
    # the root of a group is a leaf of the tree above: a step without siblings
    aliases = subroots.select("t", F.col("height").alias("l"), F.lit(0).cast("long").alias("i"), F.lit(TOP).cast("long").alias("at"), F.lit(0).alias("al"), F.col("t").alias("ai"), F.array().cast(_SEGMENTS).alias("proof"))
    pointers = cut(_children(runs.unionByName(top_runs)).unionByName(aliases), "pointers")
    start = pointers.filter(f"l = 0 and t <> {TOP}").drop("l")
    found = leaves.join(start, ["t", "i"])
    tops = aliases.select("t", F.col("l").alias("_height"))
    tops = F.broadcast(tops) if groups.count() <= BROADCAST_ANCESTORS else tops
    inner = pointers.join(tops, "t", "left")
    distance = 1
    while distance < steps:
        held = cut(inner.filter(f"t = {TOP} or l >= {distance} or l = _height"), f"ancestors-{distance}")
        few = held.count() <= BROADCAST_ANCESTORS
        found = _jump(found, held, few)
        if not few:
            found = cut(found, f"proofs-{distance}")
        inner = _jump(held.filter(f"t = {TOP} or l >= {2 * distance} or l = _height"), held, few)
        distance *= 2
    known = subroots.select("t", F.col("node").alias("subroot"))
    found = found.join(F.broadcast(known) if groups.count() <= BROADCAST_ANCESTORS else known, "t")
    root = roots.first()  # the only row; none if the table is empty
    return found.select(*rows.columns, "subroot", F.lit(bytes(root.node) if root else None).cast("binary").alias("root"), "proof")


def document_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", id_col: str = "doc_id", text_col: str = "text", one_in: int = 3) -> DataFrame:
    """Leaves, roots and proofs of documents, and what a check of tampered rows says.

    A leaf is the digest of the fields. Every row whose unsigned crc32 of the decimal id is divisible by ``one_in`` is
    checked with A-Z of its text lower-cased, the others as they are; ``folded_root`` is the root that their leaf and
    the true siblings give. Columns: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (hex),
    ``verified`` and ``proof``. A null id counts as empty text in the checksum; null fields are ``-``. One row per input row; repeated rows are leaves of
    their own. Extra columns take no part.
    """
    shown = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % one_in == 0
    own = {c: field(F.col(c)) for c in fields}
    changed = own | {text_col: field(F.translate(F.col(text_col), UPPER, LOWER))}
    leaf = digest(*own.values())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group).cast("string").alias("_group"), leaf.alias("leaf"), F.when(shown, digest(*changed.values())).alias("tampered"))
    found = manifest(rows, "_group", "_id")
    out = found.withColumn("folded_root", text_of(folded(F.coalesce("tampered", "leaf"), F.col("proof"))))
    proof = F.sha2(text_of(_joined(F.expr("transform(proof, s -> concat(s.left, s.right))"))).cast("binary"), 256)
    return out.select(F.col("_id").alias(id_col), text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == text_of(F.col("root"))).alias("verified"), "proof")
