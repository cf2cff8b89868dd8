"""Exact top-k, collocations and the filter audit against brute force on small tables with every odd case."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from gavel.llm import collocations, filter_audit, topk

rng = random.Random(23)


# --- exact top-k --------------------------------------------------------------------------------


def brute_top(rows, asked, k):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors[i] = max(vectors.get(i, v), v)
    codes = {i: [max(-(2**63), min(2**63 - 1, math.floor(1024 * x))) for x in v] for i, v in vectors.items()}
    out = {}
    for q in sorted(asked & set(codes)):
        scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(codes[q], codes[i])))), i) for i in codes if i != q and len(codes[i]) == len(codes[q])]
        for rank, (score, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1):
            out[q, rank] = (i, score)
    return out


VECTORS = (
    [(i, [rng.gauss(0, 1) + 4 * (i % 5 == j) for j in range(6)]) for i in range(300)]
    + [(300 + i, [1.5, 0.0, -2.25, 0.0, 0.0, 1.0]) for i in range(150)]  # a third of all rows are one vector
    + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (504, [0.0] * 6), (505, [1.0, 2.0]), (510, [2.0, 2.0]), (-1, [3.0] * 6)]
    + [(520, []), (530, []), (7, [9.0] * 6)]  # no components; an id twice
)


@pytest.mark.parametrize("shard_rows, block_rows, block_queries", [(4096, 64, 2048), (40, 7, 5)])
def test_top_products(spark, shard_rows, block_rows, block_queries):
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in VECTORS], "vec_id long, embedding array<double>, score string, rank int").repartition(5)
    got = topk.top_inner_products(rows, rows.filter("vec_id % 5 = 0"), k=4, shard_rows=shard_rows, block_rows=block_rows, block_queries=block_queries)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute_top(VECTORS, {i for i, _ in VECTORS if i is not None and i % 5 == 0}, 4)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()} == want


def test_top_products_edges(spark):
    kind = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([], kind)
    some = [(1, [1e18, -3.0]), (2, [1e300, 1.0]), (3, [2e15, 5.0]), (4, [-1e300, 0.5])]
    rows = spark.createDataFrame(some, kind)
    assert topk.top_inner_products(none, none).count() == topk.top_inner_products(rows, none).count() == 0
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_inner_products(rows, rows, k=10).collect()}
    assert got == brute_top(some, {1, 2, 3, 4}, 10)


def test_clustered_blocks_are_pruned():
    gen = np.random.default_rng(3)
    centres = gen.integers(-900, 900, (40, 16))
    codes = np.repeat(centres, 64, axis=0) + gen.integers(-20, 20, (40 * 64, 16))
    blocks = [codes[a : a + 64] for a in range(0, len(codes), 64)]
    ids = [np.arange(a, a + 64) for a in range(0, len(codes), 64)]
    queries, own = codes[::50], np.arange(0, len(codes), 50)
    high, low = np.stack([b.max(axis=0) for b in blocks]), np.stack([b.min(axis=0) for b in blocks])
    used, names, score, scored = topk.search_blocks(queries, own, np.full(len(own), topk.LEAST), ids, blocks, high, low, 10)
    assert used.all() and scored < 0.4 * len(queries) * len(blocks)  # of which the first wave is a half
    full = queries @ codes.T
    full[np.arange(len(own)), own] = -(10**9)
    assert (np.sort(score, axis=1) == np.sort(full, axis=1)[:, -10:]).all()


def test_products_of_any_size_are_exact():
    for top in (10, 1 << 28, 1 << 40):
        a = np.array([[rng.randrange(-top, top) for _ in range(5)] for _ in range(4)])
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in a] for p in a]
        assert topk.product(a, a).tolist() == want


# --- collocations -------------------------------------------------------------------------------


def brute_phrases(rows, least, top, per_cent):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            sizes[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    for lang in sizes:
        live = {p: f for (la, p), f in counts.items() if la == lang and f >= least}
        found = []
        for p, a in live.items():
            if len(p) < 2 or any(
                100 * f >= per_cent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in live.items() if len(q) > len(p)
            ):
                continue
            score, k = min((2000000 * a // (live[p[:k]] + live[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), live[p[:k]], live[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def phrase_rows():
    vocabulary = ["the", "The", "of", "out", "air", "zoé", "été", "ab", "ba", "A", "x" * 5000] + ["abba" * 256, "baab" * 256]
    vocabulary += ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(2048)) for flip in (0, 1)]  # Thue-Morse words
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;", "de"), ("no\x0bend\x0cof, the: piece", "")]
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for w in words)
        rows.append((text, [None, "en", "de", "und"][i % 4]))
    return rows + [("New York City is  out of the question", "en")] * 70 + [("one word\n" * 40, "de")] * 2


@pytest.mark.parametrize("budget", [1_000_000, 40])
def test_collocations(spark, budget):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, la, 1, "p") for t, la in rows], "text string, lang string, n int, phrase string").repartition(6)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=8, top=25, budget=budget).collect())
    assert got == brute_phrases(rows, 8, 25, 80)


def test_collocations_edges(spark):
    kind = "text string, lang string"
    for rows in ([], [(None, None)], [("a b c d", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, kind)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 1 << 61
    words = spark.createDataFrame([("en", w, c, n) for w, c, n in (("a", 1, big + 5), ("b", 2, big + 1), ("c", 3, big))], "lang string, word string, code long, n long")
    phrases = spark.createDataFrame([([1, 2], big), ([2, 3], big - 7), ([1, 2, 3], 5)], "key array<long>, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.best_phrases(phrases, words, 1, 10, 80).collect()}
    assert got["a b"] == (big, big + 5, big + 1, 2000000 * big // (2 * big + 6))
    assert got["a b c"] == (5, big + 5, big - 7, 2000000 * 5 // (2 * big - 2))


def test_hot_prefixes_are_split():
    gen = np.random.default_rng(1)
    groups = collocations.Groups(np.zeros(256, np.int64), 1, np.sort(collocations.mixed([np.array([5], np.uint64), np.array([6], np.uint64)])), 8)
    columns = [np.full(1000, 5, np.uint64), np.full(1000, 6, np.uint64), gen.integers(1, 9, 1000).astype(np.uint64), gen.integers(0, 99, 1000).astype(np.uint64)]
    share = Counter(groups.of(columns).tolist())
    assert min(share) >= 1 and len(share) == 8 and max(share.values()) < 400
    assert set(groups.of([c + np.uint64(1) for c in columns]).tolist()) == {0}


# --- filter audit -------------------------------------------------------------------------------


def brute_audit(docs, labels):
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    good, toxic = ({d for d, *marks in labels if marks[i] == 1 and d is not None} for i in (0, 1))
    parts = {}
    for d, t, lang in docs:
        text = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)}
        fails |= {"D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > smallest[text]}
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            alive = [True] * len(rows)
            for step, f in enumerate(order, 1):
                gone = [i for i, r in enumerate(rows) if alive[i] and f in r[0]]
                redundant = sum(f in r[0] and not alive[i] for i, r in enumerate(rows))
                for i in gone:
                    alive[i] = False
                shapley[part, f] += len(gone)
                out[part, order, step] = (sum(alive), len(gone), redundant, sum(r[0] == {f} for r in rows), sum(rows[i][1] for i in gone), sum(rows[i][2] for i in gone))
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_rows():
    varied = " ".join(f"word{i}" for i in range(150))
    texts = [None, "", varied, varied + " #", "A" * 50 + " b", "same " * 120, varied.upper(), "x " * 99, "\x0b\x0c " + varied, "one|two", "ÉÉ é", "w" * 200_000]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(200 + i, varied, "en") for i in range(60)]  # a third are copies
    docs += [(5, "twice", "en"), (5, "twice", "en"), (4, "twice", "fr"), (None, "twice", "en"), (None, None, "de"), (9, "twice", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 0, 0), (4, 1, 0), (None, 1, 1), (5, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_filter_audit(spark):
    docs, labels = audit_rows()
    table = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, lang string, mask int, n int").repartition(5)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(filter_audit.mask_counts(table, marks)).collect()
    figures = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.FIGURES) for r in got}
    assert len(got) == len(figures) and figures == brute_audit(docs, labels)


def test_filter_audit_edges(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = filter_audit.audit(filter_audit.mask_counts(one, labels)).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and {r.kept for r in rows if r.filter_order == "BCDEA"} == {0, 1}


def test_fields_never_carry(spark):
    most = (1 << 62) - 1
    counts = spark.createDataFrame([("p", 1, False, True, most), ("p", 0, True, False, most), ("p", 1, True, False, 1)], "part string, mask int, good boolean, toxic boolean, n long")
    row = next(r for r in filter_audit.audit(counts).collect() if r.filter_order == "BACDE" and r.step == 2)
    assert (row.kept, row.removed, row.redundant, row.unique_fails, row.good_lost, row.toxic_lost) == (most, most + 1, 0, most + 1, 1, most)
