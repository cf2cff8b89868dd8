"""The skew-safe building blocks against brute force on skewed data."""

import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gavel.functions import scale as sc
from gavel.functions import similarity as sm


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 6000
    keys = np.where(rng.random(n) < 0.4, "hot", np.char.add("k", rng.integers(0, 40, n).astype(str)))
    pdf = pd.DataFrame({"id": np.arange(n), "k": keys, "v": np.round(rng.lognormal(3, 2, n), 2), "t": rng.integers(0, 400_000, n)})
    pdf.loc[pdf.k == "k3", "k"] = None
    pdf.loc[rng.random(n) < 0.05, "v"] = 5.0
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "NaN", F.col("k"))).withColumn("ts", F.timestamp_seconds(F.col("t")).cast("timestamp_ntz"))
    return pdf, df


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_group_percentiles(skewed, buckets):
    pdf, df = skewed
    got = sc.group_percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}, buckets=buckets).toPandas()
    assert got["n"].sum() == len(pdf)
    for row in got.itertuples():
        vals = pdf[pdf.k.isna()].v if row.k is None else pdf[pdf.k == row.k].v
        want = np.percentile(vals, [0, 10, 50, 99, 100])
        assert np.allclose([row.a, row.b, row.c, row.d, row.e], want)


def test_percentiles_of_small_keys_need_no_sketch(skewed):
    plan = sc.group_percentiles(skewed[1], ["k"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan and plan.count("Relation") == 1


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("buckets", [7, 64])
def test_percentiles_of_large_keys_in_buckets(skewed, keys, buckets):
    """Keys of more than ``one_task`` values are cut into buckets, the others beside them are not."""
    pdf, df = skewed
    got = sc.group_percentiles(df, keys, "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}, buckets=buckets, one_task=100).toPandas()
    assert got["n"].sum() == len(pdf)
    for row in got.itertuples():
        vals = pdf.v if not keys else pdf[pdf.k.isna()].v if row.k is None else pdf[pdf.k == row.k].v
        assert np.allclose([row.a, row.b, row.c, row.d, row.e], np.percentile(vals, [0, 10, 50, 99, 100]))


def test_percentiles_do_not_depend_on_the_order_of_rows(spark):
    """Sketches come out differently when their parts arrive in another order, as on several executors; every use must see the same."""

    def dealt(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.random.default_rng().integers(0, 64, b.num_rows))], names=["k", "__v", "__c", "r"])

    rows = spark.range(0, 240_000, 1, 4).select((F.col("id") % 2).alias("k"), F.floor("id").cast("double").alias("__v"), F.lit(1).cast("bigint").alias("__c"))
    rows = rows.mapInArrow(dealt, "k bigint, __v double, __c bigint, r bigint").repartition(8, "r").drop("r")
    before = {c: spark.conf.get(c) for c in ("spark.sql.exchange.reuse", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probs = {f"p{i}": i / 16 for i in range(1, 16)}
        got = sc.counted_percentiles(rows, ["k"], probs).toPandas().set_index("k")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    for k in (0, 1):
        assert np.allclose([got.loc[k, p] for p in probs], np.percentile(np.arange(k, 240_000, 2), [100 * q for q in probs.values()]))


def test_whole_table_percentile(skewed):
    pdf, df = skewed
    row = sc.group_percentiles(df, [], "v", {"m": 0.5}).first()
    assert row.n == len(pdf) and abs(row.m - np.percentile(pdf.v, 50)) < 1e-9


def test_split_lag(skewed):
    pdf, df = skewed
    got = sc.split_lag(df, ["k"], "ts", "id", ["id"], "prev_").select("id", "prev_id").toPandas().set_index("id").prev_id
    ordered = pdf.assign(k=pdf.k.fillna("~")).sort_values(["k", "t", "id"])
    want = ordered.groupby("k").id.shift(1)
    for i, w in zip(ordered.id, want):
        assert (pd.isna(w) and pd.isna(got[i])) or got[i] == w


def test_gap_sessions(skewed):
    pdf, df = skewed
    got = sc.gap_sessions(df, ["k"], "ts", "id", 600).select("id", "session_first").toPandas().set_index("id").session_first
    ordered = pdf.assign(k=pdf.k.fillna("~")).sort_values(["k", "t", "id"])
    for _, g in ordered.groupby("k"):
        start, last = None, None
        for r in g.itertuples():
            if last is None or r.t - last > 600:
                start = r.id
            last = r.t
            assert got[r.id] == start


def test_score_rank(spark):
    pdf = pd.DataFrame({"a": [f"x{i:03d}" for i in range(300)], "s": [float((i * 37) % 101) / 2 for i in range(300)]})
    got = sc.score_rank(spark.createDataFrame(pdf), "s", [F.col("a")]).toPandas().sort_values("rank")
    want = pdf.sort_values(["s", "a"], ascending=[False, True])
    assert list(got["rank"]) == list(range(1, 301)) and list(got.a) == list(want.a)


WORDS = ["red", "blue", "bolt", "ring", "small", "tower", "palm", "view", "creek", "gate"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [" ".join(rnd.sample(WORDS, rnd.randint(1, 4))) for _ in range(90)]
    noisy = [t[: rnd.randint(1, len(t))] + rnd.choice(["", "x", " q"]) + t[rnd.randint(0, len(t)) :] for t in base]
    return sorted(set(base + noisy + ["a", "re"]))


def _grams(t):
    words = [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    return {("  " + w + " ")[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_containment_pairs(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r.needle, r.text) for r in sm.containment_pairs(df, "t", df, "t").collect()}
    assert got == {(a, b) for a, b in itertools.product(texts, texts) if a in b}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_trigram_pairs(spark, texts, threshold):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r.a, r.b) for r in sm.trigram_pairs(df, "t", df, "t", threshold).collect()}
    g = {t: _grams(t) for t in texts}
    want = {(a, b) for a, b in itertools.product(texts, texts) if g[a] and g[b] and len(g[a] & g[b]) / len(g[a] | g[b]) >= threshold}
    assert got == want


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cutoff", [70, 80])
def test_fuzzy_pairs(spark, texts, cutoff):
    some = texts[:70]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    got = {(r.a, r.b) for r in sm.fuzzy_pairs(df, "t", df, "t", cutoff).collect()}
    norm = {t: " ".join(sorted(t.split())) for t in some}
    want = {(a, b) for a, b in itertools.product(some, some) if 200 * _lcs(norm[a], norm[b]) / (len(norm[a]) + len(norm[b])) >= cutoff}
    assert got == want
