"""Files as element rows, raw frames and payloads; element tables and copy plans as output."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.sources.element_parser import EXPLICIT, IMPLICIT, ITEM, LONG, PIXELS, Ranges, Row, elements  # noqa: F401
from voxlake.sources.element_source import element_files
from voxlake.sources.shared import numbered
from voxlake.sources.stores import opens

_SCHEMA = "file_id long, path array<struct<tag:string,item:int>>, elem_idx int, tag string, vr string, vl long, value string, value_bin binary"


def is_dicom(content: Column) -> Column:
    """``DICM`` at byte 128 or 0, else a first little-endian group of 2, 3, 5 or 8."""
    magic = F.lit(b"DICM")
    group = F.substring(content, 1, 2)
    return F.coalesce((F.substring(content, 129, 4) == magic) | (F.substring(content, 1, 4) == magic) | group.isin(*[F.lit(bytes([g, 0])) for g in (2, 3, 5, 8)]), F.lit(False))


def parse_elements(content: bytes, vr_of: dict[str, str] | None = None, up_to: str | None = None) -> list[Row]:
    """The rows of a file in memory; a damaged or cut one raises ValueError."""
    return list(elements(Ranges(io.BytesIO(content), len(content) + 1), vr_of, up_to))


def _options(tags: list[str] | None, up_to: str | None) -> dict[str, str]:
    return ({"tags": ",".join(tags)} if tags else {}) | ({"up_to": up_to} if up_to else {})


def read_elements(spark: SparkSession, path: str, tags: list[str] | None = None, up_to: str | None = None, vr_of: dict[str, str] | None = None) -> DataFrame:
    """Element rows of all files under a path; ``tags`` keeps the listed ones, at any depth. Files that can't be read give none.

    Tasks read ranges: values of other tags are skipped, and nothing after the first top-level tag beyond ``up_to`` is
    read. Folders that only Spark can open are read file by file as a whole. ``vr_of`` names representations for files
    without them (``typing.typed`` does so later too).
    """
    if opens(path):
        options = _options(tags, up_to) | ({"vr_of": json.dumps(vr_of)} if vr_of else {})
        return element_files(spark, path, whole="true", **options).drop("root_tag")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.xxhash64("path").alias("file_id"), "content")
    wanted = set(tags) if tags else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.struct([("tag", pa.string()), ("item", pa.int32())])
        names = ["file_id", "path", "elem_idx", "tag", "vr", "vl", "value", "value_bin"]
        kinds = [pa.int64(), pa.list_(step), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    data = content.as_py()
                    found = list(elements(Ranges(io.BytesIO(data), len(data) + 1), vr_of, up_to, wanted))
                except (ValueError, struct.error):
                    continue
                rows += [(file_id, [{"tag": t, "item": i} for t, i in p], *rest) for p, *rest in found]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.filter(is_dicom(F.col("content"))).mapInArrow(run, _SCHEMA)


def read_report(spark: SparkSession, path: str, tags: list[str] | None = None, up_to: str | None = None) -> DataFrame:
    """One row for each file under a path: ``file_id``, ``path``, ``size``, ``is_dicom``, ``transfer_syntax``, ``n_elements``, ``bytes_read`` and ``error``.

    It reads as ``read_elements`` does with the same arguments and says how far it came.
    """
    return element_files(spark, path, report="true", **_options(tags, up_to))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_id``, ``path``, ``dir``, ``name``, ``size`` and ``is_dicom`` of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("file_id"), "path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), is_dicom(F.col("content")).alias("is_dicom"))


def read_dicomdir(elements: DataFrame) -> DataFrame:
    """Directory records: ``file_id``, ``item``, ``next_off``, ``lower_off``, ``type``, ``ref_file`` (parts joined by /) and descriptive fields."""
    rows = elements.filter((F.size("path") == 1) & (F.col("path")[0]["tag"] == "00041220"))
    pick = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.trim("value"))).alias(name)
    found = rows.groupBy("file_id", F.col("path")[0]["item"].alias("item")).agg(pick("00041400", "next_off"), pick("00041420", "lower_off"), pick("00041430", "type"), pick("00041500", "ref_file"), pick("00100020", "patient_id"), pick("00100010", "patient_name"), pick("0020000D", "study_uid"), pick("00080020", "study_date"), pick("0020000E", "series_uid"), pick("00080060", "modality"))
    return found.withColumns({c: F.col(c).try_cast("long") for c in ("next_off", "lower_off")}).withColumn("ref_file", F.replace("ref_file", F.lit("\\"), F.lit("/")))


def read_catalog(spark: SparkSession, source: str | dict) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Patients, studies, series and images of a catalogue: a folder of Parquet tables, or JDBC options for the four tables."""
    names = ("patients", "studies", "series", "images")
    if isinstance(source, str):
        return tuple(spark.read.parquet(f"{source.rstrip('/')}/{name}.parquet") for name in names)
    return tuple(spark.read.format("jdbc").options(**source, dbtable=name).load() for name in names)


def raw_frames(pixels: DataFrame) -> DataFrame:
    """Uncompressed pixel data as one array per frame: ``file_id``, ``frame_no`` (from 1), ``pixels``, ``reason``.

    ``pixels`` has file_id, value_bin, rows, cols, samples, bits_allocated, pixel_repr and number_of_frames. What is
    compressed, too short or of another depth gives one row with a reason and no pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, frames, reasons = [], [], [], []
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                kind = {(8, 0): "u1", (8, 1): "i1", (16, 0): "<u2", (16, 1): "<i2", (32, 0): "<u4", (32, 1): "<i4"}.get((row["bits_allocated"], row["pixel_repr"] or 0))
                size = (row["rows"] or 0) * (row["cols"] or 0) * (row["samples"] or 1)
                n = row["number_of_frames"] or 1
                data = row["value_bin"]
                reason = "no uncompressed data" if data is None else "unknown depth" if kind is None else "too short" if not size or len(data) < n * size * np.dtype(kind).itemsize else None
                if reason:
                    ids.append(row["file_id"]), numbers.append(0), frames.append(None), reasons.append(reason)
                    continue
                values = np.frombuffer(data, kind, n * size).reshape(n, size).astype(float)
                for k in range(n):
                    ids.append(row["file_id"]), numbers.append(k + 1), frames.append(values[k]), reasons.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(frames, pa.list_(pa.float64())), pa.array(reasons, pa.string())], ["file_id", "frame_no", "pixels", "reason"])

    columns = ["file_id", "value_bin", "rows", "cols", "samples", "bits_allocated", "pixel_repr", "number_of_frames"]
    return pixels.select(*columns).mapInArrow(run, "file_id long, frame_no int, pixels array<double>, reason string")


def write_elements(elements: DataFrame, path: str) -> None:
    """Element rows as Parquet with their ``study_uid``, in ranges of studies: a study's rows lie together, sorted by file.

    Row groups prune by study; there is no folder per study, of which there may be millions. Rows of files without a
    study have a null.
    """
    study = F.max(F.when((F.col("tag") == "0020000D") & (F.size("path") == 0), F.trim("value"))).over(Window.partitionBy("file_id"))
    parts = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = elements.withColumn("study_uid", study).repartitionByRange(parts, "study_uid", "file_id")
    rows.sortWithinPartitions("study_uid", "file_id").write.mode("overwrite").parquet(path)


def export_manifest(selection: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """Copy plan: ``path`` and ``target_path``; every selected series gets a directory of its own, numbered by (dir, series), names stay.

    Only files that are there are copied: the join keeps what ``files`` has.
    """
    rows = files.join(numbered(selection.select("dir", "series_uid").distinct(), ["dir", "series_uid"], "no"), ["dir", "series_uid"])
    return rows.select("path", F.concat_ws("/", F.lit(target), F.lpad(F.col("no").cast("string"), 8, "0"), "name").alias("target_path"))


def _joined(parts: Column) -> Column:
    """Binary values one after the other; through text, whose joining copies each once."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def fragments(elements: DataFrame) -> DataFrame:
    """Compressed pixel data as ``file_id``, ``fragment`` (from 1), ``data``, and the ``offsets`` of the offset table (empty: none)."""
    items = elements.filter((F.col("tag") == ITEM) & (F.size("path") == 1) & (F.get("path", F.lit(0))["tag"] == PIXELS)).select("file_id", F.get("path", F.lit(0))["item"].alias("item"), "value", "value_bin")
    table = items.filter("item = 1").select("file_id", F.transform(F.filter(F.split("value", r"\\"), lambda x: x != ""), lambda x: x.cast("long")).alias("offsets"))
    return items.filter("item > 1").select("file_id", (F.col("item") - 1).alias("fragment"), F.col("value_bin").alias("data")).join(table, "file_id")


def encapsulated_frames(elements: DataFrame) -> DataFrame:
    """Compressed frames as ``file_id``, ``frame_no`` (from 1) and ``payload``, still compressed.

    A fragment belongs to the last frame whose offset is not beyond it. Without offsets each fragment is a frame, if
    the file says so many frames; else all are the first frame.
    """
    found = fragments(elements)
    n_frames = elements.filter((F.col("tag") == "00280008") & (F.size("path") == 0)).groupBy("file_id").agg(F.max(F.trim("value").try_cast("int")).alias("n_frames"))
    own = Window.partitionBy("file_id")
    before = own.orderBy("fragment").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("at", F.coalesce(F.sum(F.octet_length("data") + 8).over(before), F.lit(0))).withColumn("n", F.count("*").over(own)).join(n_frames, "file_id", "left")
    frame = F.when(F.size("offsets") > 0, F.size(F.filter("offsets", lambda x: x <= F.col("at")))).when(F.coalesce("n_frames", F.lit(1)) == F.col("n"), F.col("fragment")).otherwise(1)
    grouped = placed.withColumn("frame_no", frame.cast("int")).groupBy("file_id", "frame_no").agg(F.sort_array(F.collect_list(F.struct("fragment", "data"))).alias("parts"))
    return grouped.select("file_id", "frame_no", _joined(F.col("parts.data")).alias("payload"))


def extract_encapsulated(elements: DataFrame, syntaxes: DataFrame | None = None) -> DataFrame:
    """Payloads as ``file_id``, ``name`` and ``payload``: encapsulated documents, and video streams by transfer syntax.

    ``syntaxes`` has file_id and transfer_syntax; MPEG-2 ends in .mpg, MPEG-4 and HEVC in .mp4. A stream is its
    fragments in order, without the offset table. Documents take their suffix from the MIME type beside them and
    their length from (0042,0015), which leaves the padding out.
    """
    top = lambda tag, value: elements.filter((F.col("tag") == tag) & (F.size("path") == 0)).select("file_id", value)
    documents = top("00420011", F.col("value_bin")).join(top("00420012", F.lower(F.trim("value")).alias("mime")), "file_id", "left").join(top("00420015", F.trim("value").try_cast("int").alias("length")), "file_id", "left")
    suffix = F.when(F.contains("mime", F.lit("pdf")), ".pdf").when(F.contains("mime", F.lit("stl")), ".stl").otherwise(".bin")
    named = lambda ending: F.concat(F.col("file_id").cast("string"), ending)
    out = documents.select("file_id", named(suffix).alias("name"), F.when(F.col("length") < F.octet_length("value_bin"), F.substring("value_bin", F.lit(1), F.col("length"))).otherwise(F.col("value_bin")).alias("payload"))
    if syntaxes is None:
        return out
    ending = F.when(F.col("transfer_syntax").rlike(r"^1\.2\.840\.10008\.1\.2\.4\.10[01]"), ".mpg").when(F.col("transfer_syntax").rlike(r"^1\.2\.840\.10008\.1\.2\.4\.10[2-8]"), ".mp4")
    streams = syntaxes.select("file_id", ending.alias("_e")).filter("_e is not null")
    whole = top(PIXELS, F.col("value_bin").alias("payload")).filter("payload is not null").join(streams, "file_id")
    parts = fragments(elements.join(streams.select("file_id"), "file_id", "left_semi")).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("fragment", "data"))).alias("parts"))
    pieces = parts.select("file_id", _joined(F.col("parts.data")).alias("payload")).join(streams, "file_id")
    return out.unionByName(whole.unionByName(pieces).select("file_id", named(F.col("_e")).alias("name"), "payload"))
