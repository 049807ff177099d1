"""Token ids of whole texts by a public tokenizer, each word encoded once per task and then remembered.

The tokenizer splits texts into pieces before it merges, and no piece reaches over the places where ``units`` cuts;
so the ids of a text are those of its units in order. Whatever the fast route doesn't cover (special tokens, white
space inside a unit, letters that Unicode normalisation could change) is encoded by the tokenizer as a whole unit.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex

from voxlake.llm.common import REMEMBERED

#: Units and pieces that a worker remembers; as many older ones stay until they are asked for or fall out.
KNOWN_UNITS, KNOWN_PIECES = 250_000, 300_000
#: How byte-level tokenizers split texts unless their file says otherwise; the fixed pattern of that format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_PLAIN = re.compile("[ \\n]?[!-~\u00a1-\u012f\u0132-\u024f]+")


class _Remembered(dict):
    """Two generations of answers: what is asked for again moves to the young one, the old one is dropped when that is full."""

    def __init__(self, find, most: int) -> None:
        super().__init__()
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.find(key) if found is None else found
        return found


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode(text)`` gives the ids of a text (UTF-8 bytes), as the tokenizer's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.vocabulary <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        splits = [x["pattern"]["Regex"] for x in shape["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        self.pieces = regex.compile(splits[0] if splits else BYTE_LEVEL)
        self.lower = '"Lowercase"' in json.dumps(shape["normalizer"])
        self.drops_space = bool(splits)
        if any("<|" not in x["content"] for x in shape["added_tokens"]):
            raise ValueError("special tokens are known by <|")
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known_pieces = _Remembered(self._piece, KNOWN_PIECES)
        self.known_units = _Remembered(self._unit, KNOWN_UNITS)
        self.known_spaced = _Remembered(self._spaced, KNOWN_UNITS)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece.translate(self.letters) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _unit(self, unit: str | bytes) -> bytes:
        text = unit if isinstance(unit, str) else unit.decode("utf-8", "replace")
        core = text.rstrip(string.punctuation)
        letters = core[core[:1] == " " :].isalpha()  # one run of letters, and one of signs after it
        if not (letters and text.isascii()):
            if not _PLAIN.fullmatch(text) or "<|" in text or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
                return self._whole(text)
        if self.lower:
            text, core = text.lower(), core.lower()
        if letters:
            return self.known_pieces[core] + (self.known_pieces[text[len(core) :]] if len(core) < len(text) else b"")
        return b"".join([self.known_pieces[piece] for piece in self.pieces.findall(text)])

    def _spaced(self, word: str) -> bytes:
        return self._unit(" " + word)

    def encode(self, text: bytes) -> np.ndarray:
        known = self.known_units
        if self.drops_space:
            return np.frombuffer(b"".join([known[unit] for unit in text.split()]), self.dtype)
        letters = text.decode("utf-8", "replace")
        words, gaps = letters.split(), letters.count(" ") + letters.count("\n")
        if len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(letters):  # other white space, or more at a place
            return np.frombuffer(b"".join([known[unit] for unit in _CUT.split(letters) if unit]), self.dtype)
        found, spaced, start = [], self.known_spaced, ""
        for line in letters.split("\n"):
            first, *rest = line.split(" ")
            found.append(known[start + first])
            found += [spaced[word] for word in rest]
            start = "\n"
        return np.frombuffer(b"".join(found), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


REMEMBERED.append(encoder.cache_clear)


def as_u32(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()
