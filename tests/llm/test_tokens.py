"""Counts, files and packing against the library and exact round trips."""

import random
import sys
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridelta.llm import packing, simple8b, transducer
from veridelta.llm.common import public_vocabulary, tokenizer
from veridelta.llm.tokens import byte_ids, word_ids

BYTES, WORDS = public_vocabulary("byte_bpe_50k.json"), public_vocabulary("word_bpe_49k.json")


def library_ids(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


PARTS = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "Z", "9", "½", "é", "!", "***", "日", "don", "ve", "the", "　", "\x1f", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "é"]


def samples(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_cached_ids_are_the_librarys():
    for text in samples(600):
        assert np.frombuffer(word_ids(WORDS)(text), "<u4").tolist() == library_ids(WORDS, text), text
        assert byte_ids(BYTES)(text).tolist() == library_ids(BYTES, text), text


def test_compiled_counts_are_the_librarys():
    compiled = transducer.compiled(BYTES)
    for text in samples(800, 2):
        expected = len(library_ids(BYTES, text))
        for chunk in (1, 3, 7, 1 << 15):
            assert compiled.count(text, chunk) == expected, (text, chunk)


def every_character():
    """Every assigned code point, and of the unassigned each that lies beside an assigned one or is a 61st."""
    assigned = [not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co") for c in range(sys.maxunicode + 1)]
    return [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (any(assigned[max(0, c - 1) : c + 2]) or c % 61 == 0)]


def test_every_character_is_the_librarys():
    """Letters, digits, quotes and blanks around each character: the library's own Unicode tables decide, not Python's."""
    compiled, ids, points = transducer.compiled(BYTES), word_ids(WORDS), every_character()
    for at in range(0, len(points), 4):
        text = " ".join(f"a{c}b {c}s '{c} 1{c}2  {c}{c}" for c in points[at : at + 4])
        assert compiled.count(text) == len(library_ids(BYTES, text)), ascii(text)
        assert np.frombuffer(ids(text), "<u4").tolist() == library_ids(WORDS, text), ascii(text)


def test_chunk_maps_compose_associatively():
    c = transducer.compiled(BYTES)
    text = "it's a long   text\nof 123 words, and more of them " * 5
    maps = [c.chunk_map(text[i : i + 6]) for i in range(0, len(text), 6)]
    left = maps[0]
    for m in maps[1:]:
        left = c.compose(left, m)
    assert c.total(c.scan(maps)[-1]) == c.total(left) == len(library_ids(BYTES, text))


def test_token_counts(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = transducer.token_counts(odd_docs).collect()
    expected = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), len((r["text"] or "").encode()), len(library_ids(BYTES, r["text"]))) for r in rows)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got) and transducer.token_counts(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    assert (simple8b.decode(simple8b.encode(ids), len(ids)) == ids).all()


def test_id_files(spark, odd_docs, no_docs):
    manifest = simple8b.write_ids(odd_docs)
    got = simple8b.read_ids(spark, manifest).orderBy("start").collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*library_ids(WORDS, r["text"]), 2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"], g["ids"]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    assert simple8b.read_ids(spark, simple8b.write_ids(no_docs)).count() == 0
    with open(f"{manifest.first()['path']}", "rb") as f:
        assert f.read(8) == simple8b.MAGIC


def check_packing(rows, capacity=1024):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_packing(spark, odd_docs, no_docs):
    got = packing.pack(odd_docs).collect()
    check_packing(got)
    expected = []
    for r in odd_docs.collect():
        ids = np.array([*library_ids(BYTES, r["text"]), 2], "<u4")
        first = len(ids) - 1024 * ((len(ids) - 1) // 1024)
        pieces = [(0, first), *((s, s + 1024) for s in range(first, len(ids), 1024))]
        expected += [(-1 if r["doc_id"] is None else r["doc_id"], k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(pieces)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "documents", "middle", "hot", "large", "one"])
def test_plans_are_tight(spark, kind):
    rng = np.random.default_rng(2)
    lengths = {"uniform": rng.integers(1, 1025, 4000), "documents": np.clip(rng.lognormal(5.5, 1, 4000), 1, 1024).astype(int), "middle": rng.integers(200, 701, 4000), "hot": np.r_[np.full(3000, 400), rng.integers(1, 300, 2000)], "large": rng.integers(600, 1025, 500), "one": np.array([7])}[kind]
    pieces = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    got = packing.place(pieces).collect()
    assert len(got) == len(lengths)
    used = check_packing(got)
    halves, bins = sorted((lengths[lengths <= 1024]).tolist(), reverse=True), []
    for n in halves:  # plain best fit, longest first
        fits = [b for b in range(len(bins)) if bins[b] + n <= 1024]
        if fits:
            bins[max(fits, key=bins.__getitem__)] += n
        else:
            bins.append(n)
    assert used <= 1.002 * len(bins) + 1 and (kind not in ("middle", "hot") or used < 0.99 * len(bins))


def test_ids_beyond_doubles(spark):
    """Ids that a double can't hold stay exact beside a null id."""
    ids = [2**53 + 1, None, 2**62 + 5, 2**63 - 1, -(2**63), None]
    docs = spark.createDataFrame([(i, "same text") for i in ids], "doc_id long, text string").coalesce(1)
    want = sorted(map(str, ids))
    assert sorted(str(r["doc_id"]) for r in packing.pack(docs).collect()) == want
    assert sorted(str(r["doc_id"]) for r in simple8b.read_ids(spark, simple8b.write_ids(docs)).collect()) == want


def test_pieces_are_cut_whole(spark):
    text = "word " * 5000
    rows = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("piece").collect()
    assert [r["length"] for r in rows[1:]] == [1024] * (len(rows) - 1) and 0 < rows[0]["length"] <= 1024 and sum(r["length"] for r in rows) == len(library_ids(BYTES, text)) + 1
    assert packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).agg(F.max("length")).first()[0] == 1024
