"""Value representations of elements that came without: a dictionary of tags, learnt or given, and late typing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.deid_tags import DATE_TAGS, ID_TAGS, NAME_TAGS, UID_TAGS
from voxlake.sources.element_parser import BINARY, NUMBERS, nested_elements, typed_value

#: Entries of a dictionary at most; the standard's has some 5,000.
MOST_TAGS = 100_000


def listed_dictionary() -> dict[str, str]:
    """What the de-identification's own lists say: identifiers UI, names PN, dates and times as listed, ids LO."""
    return dict.fromkeys(ID_TAGS, "LO") | dict.fromkeys(UID_TAGS, "UI") | dict.fromkeys(NAME_TAGS, "PN") | DATE_TAGS


def learned_dictionary(elements: DataFrame) -> DataFrame:
    """``tag`` and ``vr``: of each public tag the representation that most elements state, of equals the first by name.

    Files in explicit form so name the representations for those in implicit form.
    """
    known = elements.filter(F.col("vr").isNotNull() & ~F.col("vr").isin("UN", "") & F.substring("tag", 4, 1).isin(*"02468ACE"))
    counts = known.groupBy("tag", "vr").agg(F.count("*").alias("n"))
    return counts.groupBy("tag").agg(F.min_by("vr", F.struct(-F.col("n"), F.col("vr"))).alias("vr"))


def dictionary_of(*tables: DataFrame | dict[str, str]) -> dict[str, str]:
    """Dictionaries as one mapping; later ones win. A table of more than ``MOST_TAGS`` tags is an error, not cut."""
    out: dict[str, str] = {}
    for table in tables:
        if isinstance(table, dict):
            out |= table
            continue
        rows = table.select("tag", "vr").limit(MOST_TAGS + 1).collect()
        if len(rows) > MOST_TAGS:
            raise ValueError(f"a dictionary has {MOST_TAGS} tags at most")
        out |= {r.tag: r.vr for r in rows}
    return out


def typed(elements: DataFrame, vr_of: dict[str, str]) -> DataFrame:
    """Elements whose representation is UN and in the dictionary, with its value as text where that is what it is.

    ``value_bin`` gives way to ``value``; binary representations keep their bytes. An unknown value that is a sequence
    becomes its items' elements, typed as well. Rows that the dictionary doesn't know stay; so does everything, where
    the rows have no binary values. Text is decoded in the JVM; numbers and sequences, which are few, in Arrow batches.
    """
    if "value_bin" not in elements.columns:
        return elements
    spark = elements.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(vr_of.items()) or [("", "")], "tag string, _vr string"))
    unknown = F.coalesce(F.col("vr"), F.lit("UN")).isin("UN", "") & F.col("value_bin").isNotNull()
    marked = elements.join(known, "tag", "left").withColumn("_vr", F.when(unknown & (F.col("_vr") != "UN"), F.col("_vr")))
    parsed = F.coalesce(F.col("_vr").isin("SQ", "AT", *NUMBERS), F.lit(False))
    text = F.col("_vr").isNotNull() & ~F.col("_vr").isin(*BINARY)
    plain = marked.filter(~parsed).withColumns({
        "value": F.when(text, F.decode("value_bin", "ISO-8859-1")).otherwise(F.col("value")),
        "value_bin": F.when(text, F.lit(None)).otherwise(F.col("value_bin")),
        "vr": F.coalesce("_vr", "vr"),
    }).select(*elements.columns)
    others = [c for c in elements.columns if c not in ("path", "elem_idx", "tag", "vr", "vl", "value", "value_bin")]
    own = ["path", "tag", *[c for c in ("elem_idx", "vl") if c in elements.columns], "value_bin", "_vr"]
    schema = elements.select(F.struct(*others).alias("_other"), "path", "tag", "vr", "value", "value_bin", *own[2:-2]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, again = [], []
            for i, row in enumerate(batch.select([*own]).to_pylist()):
                path = tuple((s["tag"], s["item"]) for s in row["path"] or ())
                data, vr = row["value_bin"], row["_vr"]
                extra = {c: row[c] for c in own[2:-2]}
                if vr == "SQ":
                    try:
                        found = nested_elements(data, (*path, (row["tag"], 0)), vr_of)
                    except ValueError:
                        rows.append({"path": row["path"], "tag": row["tag"], "vr": "UN", "value": None, "value_bin": data} | extra)
                        again.append(i)
                        continue
                    rows.append({"path": row["path"], "tag": row["tag"], "vr": vr, "value": "", "value_bin": None} | extra)
                    rows += [{"path": [{"tag": t, "item": k} for t, k in p], "tag": tag, "vr": v, "value": x, "value_bin": raw} | {c: {"elem_idx": index, "vl": length}[c] for c in extra} for p, index, tag, v, length, x, raw in found]
                    again += [i] * (1 + len(found))
                else:
                    value, raw = typed_value(vr, data)
                    rows.append({"path": row["path"], "tag": row["tag"], "vr": vr, "value": value, "value_bin": raw} | extra)
                    again.append(i)
            other = batch.column(0).take(pa.array(again, pa.int64()))
            step = pa.list_(pa.struct([("tag", pa.string()), ("item", pa.int32())]))
            kinds = {"path": step, "tag": pa.string(), "vr": pa.string(), "value": pa.string(), "value_bin": pa.binary(), "elem_idx": pa.int32(), "vl": pa.int64()}
            names = schema.names[1:]
            yield pa.RecordBatch.from_arrays([other, *[pa.array([r[c] for r in rows], kinds[c]) for c in names]], ["_other", *names])

    found = marked.filter(parsed).select(F.struct(*others).alias("_other"), *own).mapInArrow(run, schema)
    return plain.unionByName(found.select("_other.*", *schema.names[1:]))
