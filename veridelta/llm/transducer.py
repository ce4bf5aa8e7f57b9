"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is compiled into a deterministic transducer over bytes whose transitions carry
the number of tokens that they emit. The compilation rests on two facts. The last token of the encoding of
a prefix is the one token that ends there and may follow the last token where it begins; and a token can only
begin at the few earlier places from where a vocabulary entry still runs. So the state after a prefix is the
tuple of those places, each with its node in the vocabulary's trie, the token that ends there and the tokens
emitted since; it doesn't grow with the text. States and transitions are made when a text first needs them.

Over the pieces stands the pre-tokenizer, also finite-state. It falls back to a known state before a space that
a visible character follows, so the state map of a chunk of text is a triple: what comes before the first such
place, the tokens between the first and the last, and what comes after. Maps compose associatively, and a
parallel prefix scan over a document's chunks gives the count before and within each.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import public_vocabulary, tokenizer, tune
from .tokens import TwoGenerations, byte_of_symbol

#: Characters of a chunk; longer texts are scanned by chunks.
CHUNK = 1 << 15
#: Transitions that are kept; beyond it a worker starts its transducer anew.
MOST_TRANSITIONS = 400_000
#: The pre-tokenizer that byte-level vocabularies name without writing it out.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE = re.compile(r" (?=\S)")
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)


class Transducer:
    """Lazily determinised: run() walks a piece's bytes and adds up what the transitions emit."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.whole: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for left, right in merges:
            made = vocabulary[left + right]
            self.whole[vocabulary[left], vocabulary[right]] = made
            self.halves[made] = (vocabulary[left], vocabulary[right])
        order = [vocabulary[a + b] for a, b in merges]
        if order != sorted(order) or min(order, default=0) < max(v for k, v in vocabulary.items() if len(k) == 1):
            raise ValueError("a token's id must be the rank of its merge")
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.more: list[bool] = [False]
        for word, i in vocabulary.items():
            node = 0
            for b in word:
                self.more[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.more.append(False)
                node = self.child[key]
            self.token[node] = i
        self.joins: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b right after token a: no merge across their border comes before those inside them."""
        known = self.joins.get((a, b))
        if known is not None:
            return known
        key, limit, good = (a, b), sys.maxsize, None
        while good is None:
            made = self.whole.get((a, b))
            if made is not None and made < limit:
                good = False
            elif a > b:  # undo the later of the two merges
                limit, a = a, self.halves.get(a, (a, a))[1]
                if a == limit:
                    limit, b = b + 1, self.halves.get(b, (b, b))[0]
                    good = True if b + 1 == limit else None
            else:
                limit, b = b + 1, self.halves.get(b, (b, b))[0]
                if b + 1 == limit:
                    limit, a = a, self.halves.get(a, (a, a))[1]
                    good = True if a == limit else None
        if len(self.joins) > MOST_TRANSITIONS:
            self.joins.clear()
        self.joins[key] = good
        return good

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state on a byte: the next state and the tokens emitted."""
        runs, last, emitted = [], None, 0
        for node, before, since in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            here = self.token[node]
            if last is None and here >= 0 and (before < 0 or self.may_follow(before, here)):
                last, emitted = here, 1 - since
            if self.more[node]:
                runs.append((node, before, since))
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        after = (*((node, before, since + emitted) for node, before, since in runs), (0, last, 0))
        at = self.number.setdefault(after, len(self.states))
        if at == len(self.states):
            self.states.append(after)
        self.moves[state << 8 | byte] = found = (at, emitted)
        return found

    def run(self, piece: str) -> int:
        """Tokens of a pre-tokenizer's piece."""
        if len(self.moves) > MOST_TRANSITIONS:
            self.restart()
        state, total, moves = 0, 0, self.moves
        for byte in piece.encode("utf-8"):
            step = moves.get(state << 8 | byte)
            state, emitted = step if step is not None else self.compile(state, byte)
            total += emitted
        return total


#: Unicode's White_Space but for the space itself.
BLANKS = frozenset([*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Runs of code points: first, last and class.
Runs = tuple[tuple[int, int, int], ...]


@lru_cache(maxsize=2)
def class_runs(path: str) -> Runs:
    """Letters and numbers above ASCII as the library's own pre-tokenizer takes them, whatever Unicode version it was built with.

    It splits the sequence of all code points where their class changes; one code point of each run tells the run's class.
    """
    split = tokenizer(path).pre_tokenizer.pre_tokenize_str
    codes = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and c not in BLANKS]
    starts = [at for _, (at, _) in split("".join(map(chr, codes)))]
    begins = {at for _, (at, _) in split("".join(f"a{chr(codes[at])}1" for at in starts))}
    ends = [*starts[1:], len(codes)]
    kinds = [LETTER if 3 * k + 1 not in begins else NUMBER if 3 * k + 2 not in begins else OTHER for k in range(len(starts))]
    return tuple((codes[a], codes[b - 1], kind) for a, b, kind in zip(starts, ends, kinds, strict=True) if kind != OTHER)


@lru_cache(maxsize=2)
def classes(runs: Runs) -> np.ndarray:
    """The pre-tokenizer's class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for first, last, kind in runs:
        table[first : last + 1] = kind
    for c in range(128):
        table[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    table[[*BLANKS]] = BLANK
    table[32], table[39] = SPACE, QUOTE
    return table


def cuts(text: str, table: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces begin, and the end.

    Its automaton looks one character back and two ahead, so all places are decided at once.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind, n = table[codes], len(codes)
    blank = (kind == SPACE) | (kind == BLANK)
    run = np.where(kind == QUOTE, OTHER, kind)
    cut = np.ones(n + 1, bool)
    was, now = run[:-1], run[1:]
    cut[1:n] = np.where(blank[1:], ~blank[:-1] | np.append(~blank[2:], False), np.where(blank[:-1], was != SPACE, was != now))
    quotes = np.flatnonzero((kind == QUOTE) & cut[:n])
    if len(quotes):  # a quote that begins a piece takes s, t, m, d, re, ve or ll with it
        for q in quotes.tolist():
            tail = text[q + 1 : q + 3]
            size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
            if size:
                cut[q + 1 : q + 1 + size] = False
                cut[q + 1 + size] = True
                if size == 1 and len(tail) == 2 and text[q + 2].isspace():
                    cut[q + 2] = True
    return np.flatnonzero(cut)


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the state that enters it: text before its first safe place, tokens up to the last, text after.

    ``inner`` is None where there is no safe place: then ``head`` is the whole chunk.
    """

    head: str
    inner: int | None = None
    tail: str = ""


class CompiledTokenizer:
    """Counts tokens of whole texts as the tokenizers library does for the same file."""

    def __init__(self, path: str, runs: Runs | None = None):
        self.classes = classes(class_runs(path) if runs is None else runs)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file["pre_tokenizer"]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or file["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is compiled")
        to_byte = byte_of_symbol()
        raw = lambda symbols: bytes(to_byte[c] for c in symbols)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        special = [t["content"] for t in file["added_tokens"]]
        vocabulary = {raw(k): v for k, v in file["model"]["vocab"].items() if k not in special}
        self.transducer = Transducer(vocabulary, [(raw(a), raw(b)) for a, b in merges])
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.counts = TwoGenerations(self.transducer.run)

    def settled(self, text: str) -> int:
        """Tokens of a text that begins and ends at safe places."""
        if not text:
            return 0
        at = cuts(text, self.classes).tolist()
        return sum(map(self.counts.__getitem__, [text[a:b] for a, b in zip(at, at[1:], strict=False)]))

    def chunk_map(self, chunk: str) -> ChunkMap:
        first = SAFE.search(chunk)
        if first is None:
            return ChunkMap(chunk)
        last = max(m.start() for m in SAFE.finditer(chunk, max(first.start(), len(chunk) - 400))) if SAFE.search(chunk, max(first.start(), len(chunk) - 400)) else max(m.start() for m in SAFE.finditer(chunk))
        return ChunkMap(chunk[: first.start()], self.settled(chunk[first.start() : last]), chunk[last:])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b; associative."""
        if a.inner is None:
            return ChunkMap(a.head + b.head, b.inner, b.tail) if b.inner is not None else self.joined(a, b)
        if b.inner is None:
            return ChunkMap(a.head, a.inner, a.tail + b.head)
        return ChunkMap(a.head, a.inner + self.settled(a.tail + b.head) + b.inner, b.tail)

    def joined(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """Two chunks without a safe place of their own; one may lie across their border."""
        if a.head.endswith(" ") and b.head and not b.head[0].isspace():
            return ChunkMap(a.head[:-1], 0, " " + b.head)
        return ChunkMap(a.head + b.head)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan in log2(n) rounds of independent compositions."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def total(self, m: ChunkMap) -> int:
        """Tokens if the text begins and ends with this map."""
        return self.settled(m.head) if m.inner is None else self.settled(m.head) + m.inner + self.settled(m.tail)

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; special strings in it are one token each."""
        if not text:
            return 0
        if self.special is not None and (parts := self.special.split(text))[1:]:
            return len(parts) - 1 + sum(self.count(p, chunk) for p in parts)
        if len(text) <= chunk:
            return self.settled(text)
        return self.total(self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])[-1])


@lru_cache(maxsize=2)
def compiled(path: str, runs: Runs | None = None) -> CompiledTokenizer:
    """One compiled tokenizer for each file in a Python worker."""
    return CompiledTokenizer(path, runs)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, repeated ones included.

    A null or empty text has no bytes and no tokens. Special strings in texts count as the library's default
    has it: one token each. An empty table gives no rows; a null doc_id stays null.
    """
    tune(docs.sparkSession)
    path = vocabulary or public_vocabulary("byte_bpe_50k.json")
    runs = class_runs(path)  # asked of the library once, on the driver

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = compiled(path, runs)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), counted(F.col(text)).alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
