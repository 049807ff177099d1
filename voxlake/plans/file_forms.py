"""Small header files in every syntax, for the queries that read files: written by tasks into the shared folder."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from voxlake.sources.element_parser import BIG, BINARY, DEFLATED, EXPLICIT, IMPLICIT, LONG, NUMBERS, PIXELS, WORDS
from voxlake.sources.shared import shared_folder
from voxlake.sources.stores import open_store

_UNDEFINED = 0xFFFFFFFF
#: Files that one task writes.
PART_FILES = 256


def _tag(tag: str, big: bool) -> bytes:
    return struct.pack(">HH" if big else "<HH", int(tag[:4], 16), int(tag[4:], 16))


def _value(vr: str, value, big: bool, form: str) -> bytes:
    order = ">" if big else "<"
    if vr == "SQ":
        items = [b"".join(element(*x, form) for x in item) for item in value]
        return b"".join(_tag("FFFEE000", big) + struct.pack(f"{order}I", len(x)) + x for x in items)
    if vr in NUMBERS:
        return struct.pack(f"{order}{len(value)}{NUMBERS[vr]}", *value)
    if vr in BINARY:
        word = WORDS.get(vr, 1)
        data = value + b"\0" * (-len(value) % max(2, word))
        if not big or word == 1:
            return data
        turned = bytearray(len(data))
        for i in range(word):
            turned[i::word] = data[word - 1 - i :: word]
        return bytes(turned)
    data = value.encode("latin-1")
    return data + (b"\0" if vr == "UI" else b" ") * (len(data) % 2)


def element(tag: str, vr: str, value, form: str = EXPLICIT) -> bytes:
    """One element: text, bytes, a list of numbers, or for SQ a list of items, each a list of (tag, vr, value)."""
    big = form == BIG
    order = ">" if big else "<"
    data = _value(vr, value, big, form)
    if form == IMPLICIT:
        return _tag(tag, big) + struct.pack("<I", len(data)) + data
    head = _tag(tag, big) + vr.encode()
    return head + (b"\0\0" + struct.pack(f"{order}I", len(data)) if vr.encode() in LONG else struct.pack(f"{order}H", len(data))) + data


def fragments(parts: list[bytes], offsets: list[int] | None = None) -> bytes:
    """Compressed pixel data: an offset table (empty without offsets) and a fragment for each part."""
    item = lambda data: struct.pack("<HHI", 0xFFFE, 0xE000, len(data)) + data
    table = struct.pack(f"<{len(offsets or [])}I", *(offsets or []))
    return _tag(PIXELS, False) + b"OB\0\0" + struct.pack("<I", _UNDEFINED) + item(table) + b"".join(map(item, parts)) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def file_of(elements: list[tuple], syntax: str = EXPLICIT, tail: bytes = b"") -> bytes:
    """A file with its preamble; ``syntax`` may be that of compressed pixels, which are explicit."""
    form = syntax if syntax in (IMPLICIT, BIG) else EXPLICIT
    body = b"".join(element(*x, form) for x in elements) + tail
    if syntax == DEFLATED:
        squeeze = zlib.compressobj(wbits=-15)
        body = squeeze.compress(body) + squeeze.flush()
    return b"\0" * 128 + b"DICM" + element("00020010", "UI", syntax) + body


def written(rows: DataFrame, build: Callable[[dict], tuple[str, bytes]]) -> str:
    """A new folder with a file for each row, named and made by ``build``; a task that is repeated writes the same files.

    Rows are dealt out first: they are small, so that a single task may have all of them, and their files large.
    """
    folder = f"{shared_folder(rows.sparkSession)}/voxlake-{uuid.uuid4().hex}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                name, content = build(row)
                attempt = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(attempt) as file:
                    file.write(content)
                store.move(attempt, f"{path}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    parts = max(1, -(-rows.count() // PART_FILES))
    rows.repartition(parts).mapInArrow(run, "n long").agg({"n": "sum"}).collect()
    return folder
