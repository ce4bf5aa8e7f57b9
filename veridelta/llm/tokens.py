"""Token ids of whole texts, as the tokenizers library gives them, at the speed a corpus needs."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from .common import tokenizer

#: Characters that Python, its regex module and the library may class or put into lower case in different ways, as their Unicode versions differ.
FAR = re.compile("[^\x00-\u024f\u0400-\u045f]")
#: Units whose ids a worker keeps in each of two generations; pieces of units are a quarter as many.
CACHE = 200_000


class TwoGenerations(dict):
    """A bounded cache: when the young generation is full it becomes the old one; what is used again moves back."""

    def __init__(self, make, limit: int = CACHE):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordIds:
    """Ids from a BPE tokenizer that drops white space, and so treats what stands between spaces independently.

    A text is cut at white space; a unit is normalised and split as the tokenizer's own file says, and each piece
    is merged once, by the ranks of the file's merges; a unit with characters beyond common alphabets goes to the library. Units and pieces are kept. The end-of-word mark is written as
    the byte 255, which no UTF-8 text has: the marked single bytes have the lowest ranks but for the bytes themselves,
    so the mark joins the last byte before any other merge, as the library has it from the start. Texts that hold a
    special string, or an ASCII separator that Python but not the library takes for white space, go to the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken

        self.library = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        mark, special = file["model"]["end_of_word_suffix"], {t["content"] for t in file["added_tokens"]}
        to_byte = byte_of_symbol()
        ranks = {}
        for token, i in file["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(mark)
                ranks[bytes(to_byte[c] for c in (token[: -len(mark)] if ends else token)) + b"\xff" * ends] = i
        made = [ranks[bytes(to_byte[c] for c in m.replace(mark, "").replace(" ", "")) + b"\xff" * m.endswith(mark)] for m in (" ".join(m) if isinstance(m, list) else m for m in file["model"]["merges"])]
        if made != sorted(made) or max(i for k, i in ranks.items() if len(k) == 1 or (len(k) == 2 and k.endswith(b"\xff"))) > made[0]:
            raise ValueError("a token's id must be the rank of its merge")
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.odd = [*sorted(special), "\x1c", "\x1d", "\x1e", "\x1f"]
        self.pieces = TwoGenerations(self.encode_piece, CACHE // 4)
        self.units = TwoGenerations(self.encode_unit)

    def encode_piece(self, piece: str) -> bytes:
        return array("I", self.merge(piece.encode() + b"\xff")).tobytes()

    def encode_unit(self, unit: str) -> bytes:
        if unit.isascii():
            unit = unit.lower()
            if unit.isalpha():
                return self.encode_piece(unit)
            pieces = self.split_ascii(unit)
        else:
            if FAR.search(unit):
                return np.array(self.library.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()
            pieces = self.split(unicodedata.normalize("NFC", unit).lower())
        return b"".join(map(self.pieces.__getitem__, pieces)) if len(pieces) != 1 else self.encode_piece(pieces[0])

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if not text:
            return b""
        if any(map(text.__contains__, self.odd)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.units.__getitem__, text.split()))


class ByteIds:
    """Ids from a byte-level BPE tokenizer: the library's vocabulary, merged by the ranks of its merges.

    The ranks are read from the tokenizer's own file. Texts that hold a special string go to the library whole.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.library = tokenizer(path)
        specials = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(specials)) if specials else None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        to_byte = byte_of_symbol()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items()}
        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text."""
        if not text:
            return np.empty(0, np.uint32)
        if self.odd is not None and self.odd.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def byte_of_symbol() -> dict[str, int]:
    """The printable symbols that byte-level vocabularies use for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder for each file in a Python worker."""
    return WordIds(path)


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    """One encoder for each file in a Python worker."""
    return ByteIds(path)
