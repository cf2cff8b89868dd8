"""Similarity joins against brute force, and how many candidates they make."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from gavel.functions import similarity as si

rng = random.Random(3)


def grams(text):
    import re

    return {f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", text.lower()) if w for i in range(len(w) + 1)}


def names(n):
    parts = ["marina", "tower", "palm", "royal", "one", "été", "the", "bay", "residence", "x", "Tower", "12"]
    return sorted({" ".join(rng.choice(parts) + rng.choice(["", "", "s", "1"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)} | {"", " "})


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0])
def test_trigram_pairs(spark, threshold):
    left, right = names(80), names(90)
    want = set()
    for a, b in product(left, right):
        ga, gb = grams(a), grams(b)
        if ga and gb and len(ga & gb) / len(ga | gb) >= threshold:
            want.add((a, b))
    one, two = (spark.createDataFrame([(x,) for x in s], "t string") for s in (left, right))
    got = si.trigram_pairs(one, "t", two, "t", threshold)
    assert {(r.a, r.b) for r in got.collect()} == want
    if threshold == 0.3:  # where prefixes alone leave nearly all pairs
        assert si.trigram_candidates(one, "t", two, "t", threshold).count() <= 3 * len(want) + 10


def test_pairs_stay_in_their_block(spark):
    rows = [(u, t) for u in ("u", "v", None) for t in ("palm tower", "palm tower one", "bay")]
    df = spark.createDataFrame(rows, "user string, t string")
    got = {(r.user, r.a, r.b) for r in si.trigram_pairs(df, "t", df, "t", 0.5, ["user"]).collect()}
    pairs = {(a, b) for a, b in product({t for _, t in rows}, repeat=2) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5}
    assert got == {(u, *p) for u in "uv" for p in pairs}


def test_few_candidates_on_parts(spark):
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    asked = parts.filter(F.crc32("t") % 20 == 0)
    hits = si.trigram_pairs(asked, "t", parts, "t", 0.3).count()
    assert 0 < si.trigram_candidates(asked, "t", parts, "t", 0.3).count() <= 5 * hits


def kept(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, d in enumerate(y, 1):
            row[j], last = (last + 1 if c == d else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_fuzzy_areas(spark):
    areas = ["Dubai Marina", "Marina Dubai Gate", "Palm Jumeirah", "Al Barsha", "al barsha"]
    aliases = [("JVC", "Jumeirah Village Circle"), ("palm jumeira", "The Palm")]
    values = ["jvc", " DUBAI marina ", "marina, dubai", "Palm Jumeirh", "palm jumeira", "barsha al", "nothing", "", None, "AL BARSHA"]
    token = lambda t: " ".join(sorted(w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()))
    want = {}
    for v in {v.strip().lower() for v in values if v and v.strip()}:
        alias = dict((a.lower(), n) for a, n in aliases).get(v)
        same = [a for a in areas if a.lower() == v]
        scored = [(-200 * kept(token(v), token(a)) / (len(token(v)) + len(token(a))), min(x for x in areas if x.lower() == a.lower())) for a in areas]
        if alias or same:
            want[v] = alias or min(same)
        elif min(scored)[0] <= -80:
            want[v] = min(scored)[1]
    from gavel.operators.search import fuzzy_area

    got = fuzzy_area(spark.createDataFrame([(v,) for v in values], "v string"), "v", spark.createDataFrame([(a,) for a in areas], "n string"), "n", spark.createDataFrame(aliases, "alias string, name string"))
    assert {r.value: r.hit for r in got.collect()} == want and want["marina, dubai"] == "Dubai Marina"


@pytest.mark.parametrize("flat", [False, True])
def test_heavy_hitters(spark, flat):
    from gavel.operators import hitters
    from gavel.operators.aggregates import heavy_hitters

    rows = [(None if i % 997 == 0 else f"k{i % 5000}", 1.0) for i in range(20_000)] + ([] if flat else [(f"big{i % 7}", 50.0 + i % 3) for i in range(3000)]) + [("k1", None)]
    df = spark.createDataFrame(rows, "k string, c double").repartition(6)
    some = hitters.largest_sums(df, "k", "c", 5, capacity=60)
    assert (some is None) == flat
    if some is not None:
        assert some.select("k").distinct().count() <= 60
    got = [tuple(r) for r in heavy_hitters(df, "k", "c", 5, 40.0).collect()]
    sums = {}
    for k, c in rows:
        n, t, m = sums.get(k, (0, 0.0, 0))
        sums[k] = (n + 1, t + (c or 0.0), m + (c is not None))
    want = sorted(((-t, k is not None, k or "", k, n, t, t / m, t / m >= 40.0) for k, (n, t, m) in sums.items()))[:5]
    assert got == [(k, n, t, mean, slow) for *_, k, n, t, mean, slow in want]
    assert hitters.largest_sums(df.withColumn("c", -F.col("c")), "k", "c", 5) is None
    assert heavy_hitters(df.limit(0), "k", "c", 5, 40.0).count() == 0
