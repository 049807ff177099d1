"""Elements of one file, read in ranges: every syntax that is no pixel codec, compressed pixel fragments included."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

PIXELS = "7FE00010"
ITEM, ITEM_END, LIST_END = "FFFEE000", "FFFEE00D", "FFFEE0DD"
#: Value representations with a four-byte length, and those that stay binary.
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV"}
BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
#: Bytes of one word of a binary value: big-endian files store them turned round.
WORDS = {"OW": 2, "OF": 4, "OL": 4, "OD": 8, "OV": 8}
IMPLICIT, EXPLICIT, DEFLATED, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
_UNDEFINED = 0xFFFFFFFF
#: Bytes read at a time, so that a header costs few requests.
CHUNK = 64 * 1024

Row = tuple[tuple[tuple[str, int], ...], int, str, str, int, str | None, bytes | None]


class Ranges:
    """A file's bytes by place; what is skipped over is not read. ``bytes_read`` counts what was."""

    def __init__(self, file: BinaryIO, chunk: int = CHUNK) -> None:
        self.file, self.chunk, self.bytes_read = file, chunk, 0
        self._at, self._held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """The ``n`` bytes at a place, fewer at the end of the file."""
        begin = at - self._at
        if 0 <= begin and begin + n <= len(self._held):
            return self._held[begin : begin + n]
        self.file.seek(at)
        found = self.file.read(max(n, self.chunk))
        self.bytes_read += len(found)
        self._at, self._held = at, found
        return found[:n]

    def need(self, at: int, n: int) -> bytes:
        found = self.get(at, n)
        if len(found) < n:
            raise ValueError("cut inside an element")
        return found

    def ends(self, at: int) -> bool:
        return not self.get(at, 1)


class Inflated(Ranges):
    """The inflated rest of a deflated file; inflates no more than is asked for."""

    def __init__(self, source: Ranges, start: int) -> None:
        self.source, self.next, self.start = source, start, start
        self.inflate = zlib.decompressobj(-15)
        self.data = bytearray()

    @property
    def bytes_read(self) -> int:
        return self.source.bytes_read

    def get(self, at: int, n: int) -> bytes:
        begin = at - self.start
        while len(self.data) < begin + n and not self.inflate.eof:
            part = self.source.get(self.next, CHUNK)
            if not part:
                raise ValueError("cut inside deflated data")
            self.next += len(part)
            try:
                self.data += self.inflate.decompress(part)
            except zlib.error as error:
                raise ValueError("damaged deflated data") from error
        return bytes(self.data[begin : begin + n])


def typed_value(vr: str, data: bytes, big: bool = False) -> tuple[str | None, bytes | None]:
    """A value as text, or as little-endian bytes where its representation is binary."""
    order = ">" if big else "<"
    if vr in NUMBERS:
        size = struct.calcsize(NUMBERS[vr])
        return "\\".join(str(x) for x in struct.unpack(f"{order}{len(data) // size}{NUMBERS[vr]}", data[: len(data) // size * size])), None
    if vr == "AT":
        return "\\".join(f"{a:04X}{b:04X}" for a, b in struct.iter_unpack(f"{order}HH", data[: len(data) // 4 * 4])), None
    if vr in BINARY:
        word = WORDS.get(vr, 1)
        if big and word > 1:
            data = np.frombuffer(data[: len(data) // word * word], f">u{word}").astype(f"<u{word}").tobytes()
        return None, data
    return data.decode("latin-1"), None


def _tag(data: bytes, big: bool) -> str:
    return "{:04X}{:04X}".format(*struct.unpack(">HH" if big else "<HH", data[:4]))


def _fragments(source: Ranges, at: int, path: tuple, big: bool, wanted: bool) -> Iterator[Row | int]:
    """Items of compressed pixels: the offset table (as text), then the fragments; last the place after them."""
    number = 0
    while True:
        head = source.need(at, 8)
        tag, length = _tag(head, big), struct.unpack(">I" if big else "<I", head[4:])[0]
        at += 8
        if tag == LIST_END:
            yield at
            return
        if tag != ITEM or length == _UNDEFINED:
            raise ValueError("no item among the pixel fragments")
        number += 1
        if wanted:
            data = source.need(at, length)
            offsets = "\\".join(map(str, struct.unpack(f"<{length // 4}I", data[: length // 4 * 4]))) if number == 1 else None
            yield ((*path, (PIXELS, number)), 1, ITEM, "OB", length, offsets, data)
        at += length


def elements(source: Ranges, vr_of: dict[str, str] | None = None, up_to: str | None = None, wanted: set[str] | None = None, at: int | None = None, end: int | None = None, path: tuple = (), syntax: str | None = None) -> Iterator[Row]:
    """Rows (path, index, tag, vr, length, text, bytes) of a file, or of a list of items from ``at`` to ``end``.

    Items of sequences follow their sequence with the path to them. Reading stops before the first top-level tag beyond
    ``up_to``; values of tags that are not ``wanted`` are skipped, not read. A damaged or cut file raises ValueError at
    the place. Words of big-endian files are turned round, deflated ones inflated. ``vr_of`` names representations where
    the file has none; what it doesn't know is UN, or a sequence if its length is undefined.
    """
    vr_of = vr_of or {}
    explicit, big = True, False
    nested = at is not None
    if nested:
        explicit = syntax != IMPLICIT
    else:
        at = 132 if source.get(128, 4) == b"DICM" else 4 if source.get(0, 4) == b"DICM" else 0
        if source.get(at, 2) != b"\x02\x00":
            code = source.get(at + 4, 2)
            explicit = code.isalpha() and code.isupper()
    in_meta = not nested
    stack: list[tuple[tuple, int | None, bool, bool]] = [(path, end, nested, explicit)]  # path, end, whether a list of items, whether explicit
    counts: dict[tuple, int] = {}
    while stack:
        path, end, of_items, explicit = stack[-1]
        if (end is not None and at >= end) or (end is None and len(stack) == 1 and source.ends(at)):
            stack.pop()
            continue
        if len(stack) == 1 and in_meta and source.get(at, 2) != b"\x02\x00":
            in_meta = False
            if syntax == DEFLATED:
                source = Inflated(source, at)
                if source.ends(at):
                    continue
            big = syntax == BIG
            explicit = explicit and syntax != IMPLICIT
            stack[-1] = (path, end, of_items, explicit)
        head = source.need(at, 8)
        tag = _tag(head, big)
        if tag in (LIST_END, ITEM_END):
            at += 8
            stack.pop()
            continue
        long = struct.unpack(">I" if big else "<I", head[4:])[0]
        if of_items:
            if tag != ITEM:
                raise ValueError("no item in a sequence")
            at += 8
            number = counts[path] = counts.get(path, 0) + 1
            stack.append(((*path[:-1], (path[-1][0], number)), end if long == _UNDEFINED else at + long, False, explicit))
            continue
        top = len(stack) == 1
        if up_to and top and not in_meta and tag > up_to:
            return
        if explicit or in_meta:
            code = head[4:6]
            name = code.decode("latin-1")
            if code in LONG:
                length = struct.unpack(">I" if big else "<I", source.need(at + 8, 4))[0]
                at += 12
            else:
                length = struct.unpack(">H" if big else "<H", head[6:])[0]
                at += 8
        else:
            length = long
            at += 8
            name = vr_of.get(tag, "SQ" if length == _UNDEFINED and tag != PIXELS else "UN")
        index = counts[(path, "n")] = counts.get((path, "n"), 0) + 1
        use = wanted is None or tag in wanted
        if tag == PIXELS and length == _UNDEFINED:
            if use:
                yield (path, index, tag, name if name != "UN" else "OB", -1, None, None)
            for found in _fragments(source, at, path, big, use):
                if isinstance(found, int):
                    at = found
                else:
                    yield found
            continue
        if name == "SQ" or length == _UNDEFINED:
            if use:
                yield (path, index, tag, "SQ", -1 if length == _UNDEFINED else length, "", None)
            inner = (*path, (tag, 0))
            counts[inner] = 0
            # an unknown element of undefined length holds its items in implicit form
            stack.append((inner, end if length == _UNDEFINED else at + length, True, explicit and name != "UN"))
            continue
        if use or tag == "00020010":
            data = source.get(at, length)
            if len(data) < length:
                raise ValueError("cut inside a value")
            text, raw = typed_value(name, data, big and not in_meta)
            if use:
                yield (path, index, tag, name, length, text, raw)
            if tag == "00020010" and in_meta:
                syntax = (text or "").strip("\x00 ")
        elif length and not source.get(at + length - 1, 1):
            raise ValueError("cut inside a value")
        at += length


def nested_elements(data: bytes, path: tuple, vr_of: dict[str, str]) -> list[Row]:
    """The rows under a sequence of an implicit file that was taken for an unknown value; ``path`` ends in (tag, 0)."""
    import io

    return list(elements(Ranges(io.BytesIO(data), len(data) + 1), vr_of, at=0, end=len(data), path=path, syntax=IMPLICIT))
