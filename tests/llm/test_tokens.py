"""Byte-level BPE and packing against the reference libraries, and their edge cases."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from gavel.llm import batches, bpe, packing, queries  # noqa: E402

FILE = P.path("byte_bpe_50k.json")
MARKS = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "a", "Z", "é", "1", "²", "٣", "_", "-", "'s", "'LL", "'t", "'re", "'ll", "'v", "'", "汉", "😀", "́", "‍", "<|endoftext|>", "\x00", "ß", "İ", "d"]


@pytest.fixture(scope="module")
def spoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_the_library_on_odd_texts(spoken):
    rng = random.Random(5)
    texts = ["".join(rng.choice(MARKS) for _ in range(rng.randint(0, 16))) for _ in range(4000)] + [None, "", "x" * 5000, " " * 300 + "a"]
    tool, got = bpe.tokenizer(FILE), []
    for _, data, at in batches.text_pieces(iter([pa.record_batch([pa.array(texts, pa.string())], ["t"])]), "t", 2000):
        ids, upto = tool.encode(data, at)
        assert bytes(tool.decode(ids)) == bytes(data)
        got += [ids[upto[i] : upto[i + 1]].tolist() for i in range(len(upto) - 1)]
    assert got == [spoken.encode_ordinary(t or "") for t in texts]


def test_forgetting_changes_nothing(spoken, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 7)
    tool = bpe.ByteBpe(FILE)
    for text in ("one two three four five six seven eight nine", "ten one two eleven twelve", "one"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert tool.encode(data, np.array([0, len(data)]))[0].tolist() == spoken.encode_ordinary(text)


def test_offsets_name_split_characters(spark):
    docs = spark.createDataFrame([(1, "a 😀漢 b"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.encode(docs, FILE, offsets=True).collect()}
    first, last = (np.frombuffer(rows[1][c], "<u4") for c in ("starts", "ends"))
    text = "a 😀漢 b"
    tool = bpe.tokenizer(FILE)
    for i, a, b in zip(np.frombuffer(rows[1].ids, "<u4"), first, last):
        assert bytes(tool.decode(np.array([i]))) in text[a:b].encode()
    assert bytes(rows[2].ids) == b"" and bytes(rows[3].starts) == b""


def test_decode_of_a_cut_character(spark):
    ids = np.array(bpe.tokenizer(FILE).library.encode("漢").ids[:1], "<u4").tobytes()
    df = spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids binary")
    rows = {r.doc_id: r for r in bpe.decode(df, FILE).collect()}
    assert rows[1].text == "�" and rows[2].text == "" and "漢".encode().startswith(bytes(rows[1].decoded))


def test_op10_equals_the_library(spark, sf, spoken):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = spoken.encode_ordinary(r.text or "")
        raw = np.array(ids, "<u4").tobytes()
        want[r.doc_id] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_byte_bpe(spark, sf).collect()}
    assert got == want


def _check_packing(rows, texts, spoken, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, parts in pieces.items():
        ids = spoken.encode_ordinary(texts[doc] or "") + [1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0 and {r.sequence_length for r in parts} == {at}


def test_op9_covers_every_id_once_without_padding(spark, sf, spoken):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    _check_packing(queries.op9_multi_length_packing(spark, sf).collect(), texts, spoken, 2048)


def test_packing_edges(spark, spoken):
    texts = {1: None, 2: "", 3: "long word " * 3000, 4: "a", 5: "tie", 6: "tie"}
    docs = spark.createDataFrame([(k, v, "x", 0) for k, v in texts.items()], "doc_id long, text string, length string, offset int")
    rows = packing.pack_documents(docs, FILE, pending_tokens=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    _check_packing(rows, texts, spoken, 2048)
    assert packing.pack_documents(docs.limit(0), FILE).count() == 0
    assert bpe.encode(docs.limit(0), FILE).count() == 0
    twice = packing.pack_documents(docs.filter("doc_id = 4").union(docs.filter("doc_id = 4")), FILE).collect()
    assert len(twice) == 2


def test_shorter_tiers_fill_the_gaps_of_long_windows():
    packer = packing.TierPacker(2048, (256, 512, 1024, 2048), 4)
    for i, n in enumerate((1500, 548, 1300, 700, 48, 2048, 5000)):
        packer.add(i, 0, n)
    done = packer.pack(True)
    assert all(sum(p[0] for p in pieces) == size for _, size, pieces in done)
    assert [(1500, 548)] == [tuple(p[0] for p in x[2]) for x in done if x[2][0][0] == 1500]


def test_step_groups_are_balanced():
    rng, packer = random.Random(1), packing.TierPacker(2048, (256, 512, 1024), 8)
    for i in range(600):
        packer.add(i, 0, rng.choice((40, 300, 900, 1800, 4000)))
    cost = defaultdict(int)
    for group, _, pieces in packer.pack(False):
        cost[group] += sum(p[0] ** 2 for p in pieces)
    full = sorted(cost.values())
    assert full[-1] <= 1.5 * full[0]


def test_each_tier_is_packed_by_itself():
    def run(tiers):
        rng, packer = random.Random(2), packing.TierPacker(2048, tiers, 8)
        for i in range(600):
            packer.add(i, 0, rng.choice((20, 90, 200, 240, 300, 480, 700, 1000, 1500, 2000)))
        done = packer.pack(False)
        assert all(sum(p[0] for p in pieces) == size for _, size, pieces in done)
        return [(size, [p[0] for p in pieces]) for _, size, pieces in done]

    all_tiers, fewer = run((256, 512, 1024, 2048)), run((256, 1024, 2048))
    assert {size for size, _ in all_tiers} == {256, 512, 1024, 2048} and {size for size, _ in fewer} == {256, 1024, 2048}
    assert all(max(pieces) > size // 2 for size, pieces in all_tiers if size > 256)  # opened with a piece of its own tier
    assert any(size == 2048 and min(pieces) <= 256 for size, pieces in all_tiers)  # gaps are filled from shorter tiers
    with pytest.raises(ValueError):
        packing.TierPacker(2048, (300, 2048), 8)
