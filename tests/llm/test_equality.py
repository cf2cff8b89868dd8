"""Unlike texts, words and pieces stay unlike: Thue-Morse strings collide under polynomial hashes modulo 2^64."""

import hashlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from gavel.llm import bpe, near_dup, packing, substring_dedup, suffix_dedup
from gavel.llm.batches import PRIME, RangeHash, mix64, times61
from gavel.llm.queries import tokenizer_file


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (1024, 4096)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [t for pair in PAIRS for t in pair]
    rows += [" ".join(f"w{i} {t}" for i in range(7)) for t in PAIRS[0]]  # words
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)


def test_hash_is_the_polynomial():
    gen = np.random.default_rng(4)
    a, b = gen.integers(0, PRIME, 50_000).astype(np.uint64), gen.integers(0, PRIME, 50_000).astype(np.uint64)
    assert times61(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b)]
    h = RangeHash(9)
    for data in (gen.integers(0, 256, 60_000).astype(np.uint8), gen.integers(0, 1 << 62, 40_000).astype(np.uint64) * np.uint64(4) + np.uint64(3)):
        prefixes, plus = h.prefixes(data), int(data.dtype == np.uint8)
        for s, e in ((0, 0), (0, 9), (16_380, 16_390), (32_760, 32_800), (3, 30_000)):
            want = sum((int(x) + plus) * pow(h.radix, i, PRIME) for i, x in enumerate(data[s:e])) % PRIME
            assert h.ranges(prefixes, np.array([s]), np.array([e])).tolist() == mix64(np.array([want], np.uint64)).tolist()
    for one, two in PAIRS:
        x = np.frombuffer((one + two).encode(), np.uint8)
        p = h.prefixes(x)
        assert h.ranges(p, np.array([0]), np.array([len(one)])) != h.ranges(p, np.array([len(one)]), np.array([len(x)]))


def test_ids_and_bytes(docs):
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    encoded = bpe.encode(docs, tokenizer_file())
    both = bpe.decode(encoded, tokenizer_file()).collect()
    for r in both:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode()


def test_pieces_under_one_hash(monkeypatch, docs):
    """Even a hash that is always equal gives each piece its own ids."""
    one = bpe.ByteBpe(tokenizer_file())
    data = np.frombuffer("some words, some others\n  and 12 numbers".encode(), np.uint8)
    want = one.encode(data, np.array([0, 10, len(data)]))
    monkeypatch.setattr(bpe._PIECE, "ranges", lambda prefixes, starts, ends: np.zeros(len(starts), np.uint64))
    got = bpe.ByteBpe(tokenizer_file()).encode(data, np.array([0, 10, len(data)]))
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_packed_ids(docs):
    pieces = packing.pack_documents(docs, tokenizer_file()).collect()
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for doc in docs.collect():
        mine = sorted((p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in pieces if p.doc_id == doc.doc_id)
        assert sum((ids for _, ids in mine), []) == library.encode_ordinary(doc.text) + [1]


def test_near_duplicates_and_windows(docs):
    assert all(r.kept for r in near_dup.near_duplicates(docs, words=3, per_cent=85).collect())
    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(docs).collect())


def test_repeated_strings(docs):
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    seen = {}
    for t in texts.values():
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    for r in suffix_dedup.remove_repeats(docs).collect():
        t = texts[r.doc_id]
        gone = {b for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1 for b in range(i, i + 400)}
        assert hashlib.sha256(bytes(r.kept)).digest() == hashlib.sha256(bytes(c for i, c in enumerate(t) if i not in gone)).digest()
