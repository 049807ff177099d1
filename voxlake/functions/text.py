"""Text of header values by their character sets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Specific character sets and their codecs; fixed values of the format.
CODECS = {
    "": "latin-1", "ISO_IR 6": "ascii", "ISO_IR 100": "latin-1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4", "ISO_IR 144": "iso8859-5",
    "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8", "ISO_IR 148": "iso8859-9", "ISO_IR 203": "iso8859-15", "ISO_IR 13": "shift_jis", "ISO_IR 166": "tis-620",
    "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk", "ISO 2022 IR 6": "latin-1", "ISO 2022 IR 100": "latin-1", "ISO 2022 IR 101": "iso8859-2", "ISO 2022 IR 144": "iso8859-5",
    "ISO 2022 IR 126": "iso8859-7", "ISO 2022 IR 13": "iso2022_jp_ext", "ISO 2022 IR 87": "iso2022_jp_2", "ISO 2022 IR 159": "iso2022_jp_2", "ISO 2022 IR 149": "euc_kr", "ISO 2022 IR 58": "gb2312",
}


#: Escapes that name the upper half of what follows, and its codec; fixed values of the format.
UPPER = {
    b"\x1b-A": "latin-1", b"\x1b-B": "iso8859-2", b"\x1b-C": "iso8859-3", b"\x1b-D": "iso8859-4", b"\x1b-L": "iso8859-5", b"\x1b-G": "iso8859-6", b"\x1b-F": "iso8859-7",
    b"\x1b-H": "iso8859-8", b"\x1b-M": "iso8859-9", b"\x1b-b": "iso8859-15", b"\x1b-T": "tis-620", b"\x1b)I": "shift_jis", b"\x1b$)C": "euc_kr", b"\x1b$)A": "gb2312",
}
_ESCAPE = re.compile(rb"(\x1b(?:-[A-Za-z]|\)I|\([BJ]|\$\)[AC]|\$[@B]|\$\(D))")
#: After these an escape holds no longer: line ends and the parts of names and values.
_RESET = re.compile(rb"(?<=[\r\n\f^=\\])")


def _switched(data: bytes, first: str) -> str:
    """Text with escapes: each names the set of what follows it, as far as the next delimiter."""
    pieces, codec, out = _ESCAPE.split(data), first, []
    for escape, piece in zip([b"", *pieces[1::2]], pieces[::2], strict=True):
        if escape.startswith((b"\x1b$@", b"\x1b$B", b"\x1b$(")):
            out.append((escape + piece + b"\x1b(B").decode("iso2022_jp_2", "replace"))
            continue
        codec = UPPER.get(escape, codec)
        for i, part in enumerate(_RESET.split(piece)):
            codec = first if i else codec
            out.append(part.decode(codec, "replace"))
    return "".join(out)


def _decoded(data: bytes | None, charset: str | None, force: str | None) -> str | None:
    if data is None:
        return None
    first = CODECS.get((charset or "").split("\\")[0].strip(), "latin-1")
    first = "shift_jis" if first == "iso2022_jp_ext" else "latin-1" if first == "iso2022_jp_2" else first
    return bytes(data).decode(force, "replace") if force else _switched(bytes(data), first) if b"\x1b" in data else bytes(data).decode(first, "replace")


def decode_text(data: Column, charset: Column, force: str | None = None) -> Column:
    """Text of a binary value by its character set; plain ASCII without escapes never leaves the JVM. ``force`` names a codec for all."""

    @F.pandas_udf("string")
    def decoded(values: pd.Series, charsets: pd.Series) -> pd.Series:
        return pd.Series([_decoded(v, c, force) for v, c in zip(values, charsets, strict=True)], dtype=object)

    plain = F.decode(data, "ISO-8859-1")
    return F.when(plain.rlike(r"^[\x01-\x1a\x1c-\x7e]*$"), plain).otherwise(decoded(data, charset))
