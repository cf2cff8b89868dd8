"""Duplicate operators against brute force on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from gavel.llm import chat, exact_dedup, near_dup, packed, substring_dedup, suffix_dedup
from gavel.llm.links import components

rng = random.Random(17)
WORDS = [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = sentence(5000)
PASSAGE = sentence(110)
BASE = sentence(200).split()


def edited(k):
    words = list(BASE)
    for i in rng.sample(range(len(words)), k):
        words[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


ROWS = (
    [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "ONE\ttwo"), (7, LONG), (8, LONG), (9, LONG + " tail")]
    + [(10 + i, sentence(30) + "\n" + PASSAGE + "\n" + sentence(30)) for i in range(12)]
    + [(30 + i, " ".join(BASE)) for i in range(5)]
    + [(40 + i, edited(1 + i % 4)) for i in range(15)]
    + [(60 + i, sentence(40)) for i in range(10)]
    + [(80, "ab" * 900), (81, "é" * 700), (82, "x" + "é" * 500)]
)


@pytest.fixture(scope="module")
def docs(spark):
    # an extra column with a name that clashes with results
    return spark.createDataFrame([(d, t, -1, "z") for d, t in ROWS], "doc_id long, text string, n_words int, kept string").repartition(4).cache()


def test_exact_dedup(docs):
    groups = {}
    for d, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    want = {d: (min(g)[1], len(g), d == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, d in g}
    for runs, fan_in in ((1, 2), (5, 2), (64, 4)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, runs=runs, fan_in=fan_in).collect()}
        assert got == want


def test_exact_dedup_edges(spark, docs):
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "a"), (1, "a b"), (-(2**63), "q"), (2**63 - 1, "q")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == 7
    assert {r.keep_id for r in rows if r.group_size == 4} == {1}
    assert {r.keep_id for r in rows if r.group_size == 2} == {-(2**63)}
    assert None not in {r.doc_id for r in exact_dedup.drop_copies(odd).collect()}
    longer = spark.createDataFrame([(None, "a "), (1, "a")], "doc_id long, text string")
    assert [(r.keep_id, r.kept) for r in exact_dedup.exact_dedup(longer).orderBy("doc_id").collect()] == [(None, True), (None, False)]


def test_one_row_of_repeated_rows_stays(spark):
    rows = [(1, PASSAGE, "a"), (1, PASSAGE, "a"), (1, PASSAGE, "b"), (2, PASSAGE, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, "x y", "a"), (3, "xy", "a"), (3, "x\ty", "a")]
    rows += [(None, "q", "a"), (None, "q", "a"), (None, None, "a"), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r.doc_id, r.text or "") for r in exact_dedup.drop_copies(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, PASSAGE), (2, LONG), (3, "x\ty"), (None, "q"), (None, "")], key=repr)


def _shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _components(rows, n, per_cent):
    sets = {d: _shingles(t, n) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= per_cent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("n,per_cent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, n, per_cent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, n, per_cent).collect()}
    assert got == _components(ROWS, n, per_cent)


def test_near_duplicates_of_a_cloud_without_a_centre(spark):
    rows = [(i, edited(rng.choice((2, 5, 8, 12)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, 3, 85).collect()}
    assert got == _components(rows, 3, 85)


def test_near_duplicates_edges(spark, docs):
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (None, None)], "doc_id long, text string")
    rows = near_dup.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (0, 3, False), (3, 3, True), (3, 3, True)]


def test_every_pair_under_the_distance_shares_a_bucket():
    gen = np.random.default_rng(3)
    from itertools import combinations

    for _ in range(200):
        a = gen.integers(0, 1 << 16, (12, 5))
        b = a.copy()
        flat = gen.choice(60, 23, replace=False)
        b.reshape(-1)[flat] ^= 1
        assert any((a[c][list(k)] == b[c][list(k)]).all() for c in range(12) for k in combinations(range(5), 4))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(7, i) for i in range(8, 60)] + [(9, 9), (8, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 7 for i in range(7, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _cut(rows, length):
    raw = {d: (t or "").encode() for d, t in rows}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, kept)
    return out


@pytest.mark.parametrize("length,hot", [(400, 6000), (130, 6000), (400, 1)])
def test_suffix_removal(docs, length, hot):
    rows = suffix_dedup.remove_repeats(docs.drop("kept"), length, hot_runs=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == _cut(ROWS, length)


def test_suffix_removal_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    twice = spark.createDataFrame([(1, PASSAGE * 2), (1, PASSAGE * 2), (None, "short")], "doc_id long, text string")
    assert sorted((r.n_bytes, len(r.kept)) for r in suffix_dedup.remove_repeats(twice).collect()) == [(5, 5), *[(len(PASSAGE) * 2, 0)] * 2]
    cut = spark.createDataFrame([(1, "a" + "é" * 300 + "b"), (2, "c" + "é" * 300)], "doc_id long, text string")
    whole = suffix_dedup.remove_repeats(cut, 399, whole_characters=True).collect()
    assert sorted(bytes(r.kept).decode() for r in whole) == ["ab", "c"]


def test_the_cover_covers():
    for period in (4, 16, 32, 64):
        cover = suffix_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def _words_cut(rows, n):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window", [13, 4, 1])
def test_block_anchors(docs, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, window).collect()}
    assert got == _words_cut(ROWS, window)


def test_block_anchor_edges(spark, docs):
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, PASSAGE), (5, PASSAGE), (5, PASSAGE), (9, PASSAGE), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect())
    assert got == [(0, 0, 0), (0, 110, 0), (5, 110, 0), (5, 110, 0), (9, 110, 110)]


def test_packed_values_survive_the_trip():
    gen = np.random.default_rng(1)
    hashes = np.sort(gen.integers(0, 2**64, 1000, dtype=np.uint64))
    first = np.array([0, 10, 500, 900])
    places = gen.integers(0, 1000, 1000)
    rows, ids = np.array([5, -7, 2**62, 0]), np.array([3, 1, -(2**62), 9])
    h, p, r, o = packed.unpack(packed.pack(hashes, places, rows, ids, first))
    which = np.searchsorted(first, places, side="right") - 1
    assert (h == hashes).all() and (p == places - first[which]).all() and (r == rows[which]).all() and (o == ids[which]).all()


def _format_counts(turns):
    rows = chat.read_back(chat.prefix_targets(turns))
    return {r.conv_id: r for r in rows.collect()}


def test_chat_round_trip(spark):
    nasty = ["", "a\\b", "</turn>", "###", "####", "\\e\\h\\b", "### assistant: x</turn>\n", ": \n", "\\c", "</turn", "<</turn>>", "é😀"]
    turns = [(1, i, ["user", "assistant", "sys: ###x"][i % 3], t, 0) for i, t in enumerate(nasty)] + [(2, 0, "assistant", None, 0), (3, 0, None, "q", 0), (None, None, "user", "z", 0), (4, 1, "assistant", "b", 0), (4, 1, "assistant", "b", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, target int")
    got = _format_counts(df)
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t, _ in turns[: len(nasty)]]
    assert got[1].loss == "".join(t for _, _, r, t, _ in turns[: len(nasty)] if r == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "")] and got[2].loss == ""
    assert got[3].turns[0].role == "" and got[None].turns[0].text == "z" and got[4].loss == "bb"
    assert _format_counts(df.limit(0)) == {}


def test_chat_examples_are_prefixes(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")]
    rows = chat.prefix_targets(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("target").collect()
    assert [(r.target, r.n_context, r.loss_length) for r in rows] == [(2, 1, 1), (4, 3, 1), (6, 5, 0)]
    assert rows[0].formatted == "### user: q</turn>\n### assistant: a</turn>\n" and rows[1].formatted.startswith(rows[0].formatted)
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in rows[:2]] == ["a", "b"]
