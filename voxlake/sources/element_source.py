"""A Spark data source over header files: ranges instead of whole files, filters on tags, a report of every file.

``spark.read.format("element_files")`` reads element rows, or with the option ``report`` one row for each file with the
bytes that were read and the error that ended the reading.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThanOrEqual

from voxlake.sources.element_parser import Ranges, elements
from voxlake.sources.stores import open_store

FORMAT = "element_files"
ROWS = "file_id long, path array<struct<tag:string,item:int>>, elem_idx int, tag string, vr string, vl long, value string, value_bin binary, root_tag string"
REPORT = "file_id long, path string, size long, is_dicom boolean, transfer_syntax string, n_elements long, bytes_read long, error string"
#: Files and bytes of a partition at most; a file counts for a request at least.
PART_FILES, PART_BYTES, REQUEST_BYTES = 4096, 256_000_000, 64 * 1024
#: Rows and bytes of values that a batch holds, about.
BATCH_ROWS, BATCH_BYTES = 20_000, 16_000_000


def file_id(path: str) -> int:
    """As Spark's xxhash64 gives it."""
    found = xxhash.xxh64_intdigest(path.encode(), 42)
    return found - (1 << 64) if found >> 63 else found


def looks_like_a_header(head: bytes) -> bool:
    """``DICM`` at byte 128 or 0, else a first little-endian group of 2, 3, 5 or 8."""
    return head[128:132] == b"DICM" or head[:4] == b"DICM" or head[:2] in (b"\2\0", b"\3\0", b"\5\0", b"\x08\0")


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]  # as the store names them, and their sizes


class ElementReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.whole = options.get("whole", "false").lower() == "true"
        self.report = options.get("report", "false").lower() == "true"
        self.vr_of = json.loads(options.get("vr_of", "{}"))
        self.up_to = options.get("up_to") or None
        self.wanted = set(options["tags"].split(",")) if options.get("tags") else None
        self.roots: set[str] | None = None

    def partitions(self) -> list[Files]:
        store, root = open_store(self.uri)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[Files] = []
        size = 0
        whole = self.up_to is None and self.wanted is None and self.roots is None
        for one in sorted((x for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            cost = max(REQUEST_BYTES, one.size) if whole else REQUEST_BYTES
            if not out or len(out[-1].paths) >= PART_FILES or size + cost > PART_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append((one.path, one.size))
            size += cost
        return out or [Files([])]

    def _name(self, path: str) -> str:
        """The path as Spark's own sources give it."""
        scheme, found, _ = self.uri.partition(":")
        if not found or scheme == "file":
            return f"file:{path}"
        authority = self.uri.split("//", 1)[1].split("/", 1)[0] if "//" in self.uri else ""
        inner = path if path.startswith("/") else f"/{path}"
        bucket = scheme in ("s3", "s3a", "s3n", "gs")
        return f"{scheme}://{path}" if bucket else f"{scheme}://{authority}{inner}" if authority else f"{scheme}:{inner}"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.uri)
        rows: list[tuple] = []
        held = 0
        for path, size in partition.paths:
            name = self._name(path)
            own = file_id(name)
            n, syntax, error, known = 0, None, None, False
            with store.open_input_file(path) as file:
                source = Ranges(file)
                known = looks_like_a_header(source.get(0, 132))
                found_rows: list[tuple] = []
                if known:
                    try:
                        for where, index, tag, vr, length, text, raw in elements(source, self.vr_of, self.up_to, None if self.wanted is None else self.wanted | ({"00020010"} if self.report else set())):
                            n += 1
                            if tag == "00020010" and not where:
                                syntax = (text or "").strip("\x00 ")
                            root = where[0][0] if where else tag
                            if self.report or (self.roots is not None and root not in self.roots):
                                continue
                            found_rows.append((own, [{"tag": t, "item": i} for t, i in where], index, tag, vr, length, text, raw, root))
                            held += len(raw or b"") + len(text or "")
                    except (ValueError, struct.error) as found:
                        error = str(found)
                        if self.whole:
                            found_rows = []
                rows += found_rows
                if not self.report and (len(rows) >= BATCH_ROWS or held >= BATCH_BYTES):
                    for at in range(0, len(rows), BATCH_ROWS):
                        yield _batch(rows[at : at + BATCH_ROWS], _SCHEMA)
                    rows, held = [], 0
                if self.report:
                    rows.append((own, name, size, known, syntax, n, source.bytes_read, error))
        if rows:
            yield _batch(rows, _REPORT_SCHEMA if self.report else _SCHEMA)


class PushingReader(ElementReader):
    """The reader where the session pushes filters to Python sources; elsewhere Spark refuses one that could take them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over ``tag =``, ``tag IN``, ``root_tag =``, ``root_tag IN`` and ``root_tag <=``: other values aren't read, nor what follows the last root."""
        for one in filters:
            name = one.attribute[0] if getattr(one, "attribute", None) and len(one.attribute) == 1 else None
            values = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if self.report or name not in ("tag", "root_tag"):
                yield one
            elif name == "tag" and values is not None:
                self.wanted = values if self.wanted is None else self.wanted & values
            elif name == "root_tag" and values is not None:
                self.roots = values if self.roots is None else self.roots & values
                self.up_to = min(self.up_to or "G", max(self.roots, default=""))
            elif name == "root_tag" and isinstance(one, LessThanOrEqual):
                self.up_to = min(self.up_to or "G", one.value)
                yield one  # file meta information is read whatever the bound
            else:
                yield one


_STEP = pa.struct([("tag", pa.string()), ("item", pa.int32())])
_SCHEMA = pa.schema([("file_id", pa.int64()), ("path", pa.list_(_STEP)), ("elem_idx", pa.int32()), ("tag", pa.string()), ("vr", pa.string()), ("vl", pa.int64()), ("value", pa.string()), ("value_bin", pa.binary()), ("root_tag", pa.string())])
_REPORT_SCHEMA = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("is_dicom", pa.bool_()), ("transfer_syntax", pa.string()), ("n_elements", pa.int64()), ("bytes_read", pa.int64()), ("error", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class ElementFiles(DataSource):
    """Options: ``path``, ``tags`` (joined by commas), ``up_to``, ``vr_of`` (JSON), ``report``, ``whole``, ``pushdown``.

    ``pushdown`` takes filters over where ``spark.sql.python.filterPushdown.enabled`` is set. With ``whole`` a file whose
    damage was met gives nothing, so a filter may not end the reading and none is taken over; without, it gives what lies before the damage.

    The report names the error of a damaged file.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return REPORT if self.options.get("report", "false").lower() == "true" else ROWS

    def reader(self, schema) -> ElementReader:
        on = lambda name: self.options.get(name, "false").lower() == "true"
        return (PushingReader if on("pushdown") and not on("whole") else ElementReader)(dict(self.options))


def element_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The source over a path, with filters pushed down where the session allows it."""
    spark.dataSource.register(ElementFiles)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).options(pushdown=pushes, **options).load(path)


