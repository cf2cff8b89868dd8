"""Sorted sweeps against brute force; a hot key is split by time."""

import datetime as dt
import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gavel.operators import joins, sweep

T0 = dt.datetime(2024, 1, 1)
rng = random.Random(8)


def rows_of(n, hot):
    out = []
    for i in range(n):
        chat = "hot" if rng.random() < hot else rng.choice(["a", "b", "c:1", None])
        at = None if rng.random() < 0.02 else T0 + dt.timedelta(seconds=rng.randrange(0, 3000), microseconds=rng.choice([0, 0, 1]))
        out.append((i, chat, rng.choice(["x", "y", None]), at))
    return out


@pytest.mark.parametrize("ranges", [None, 1, 13])
def test_siblings(spark, ranges):
    rows = rows_of(700, 0.4)
    df = spark.createDataFrame(rows, "id long, chat string, lang string, ts timestamp").repartition(5)
    anchors = df.filter("id % 3 = 0")
    got = sorted((r.anchor_id, r.sibling_id, r.chat, r.lang) for r in sweep.siblings(anchors, df, ["chat", "lang"], "ts", "id", 60, ranges).collect())
    minute = dt.timedelta(seconds=60)
    full = [r for r in rows if None not in r]
    assert got == sorted((a[0], b[0], a[1], a[2]) for a in full if a[0] % 3 == 0 for b in full if a[1:3] == b[1:3] and abs(a[3] - b[3]) <= minute)


@pytest.mark.parametrize("ranges", [None, 1, 11])
def test_nearest(spark, ranges):
    left, right = rows_of(400, 0.5), rows_of(500, 0.5)
    a = spark.createDataFrame([(r[0], r[1], r[3]) for r in left], "id long, chat string, ts timestamp")
    b = spark.createDataFrame([(r[1], r[3], r[0] % 7, r[2]) for r in right], "chat string, ts timestamp, v int, w string")
    got = {r.id: (r.near_ts, r.near_v, r.near_w) for r in sweep.nearest(a, b, "chat", "ts", 30, ["v", "w"], "id", ranges).collect()}
    want = {}
    for i, chat, _, ts in left:
        near = [(abs(x[3] - ts), x[3], x[0] % 7, x[2] or "", x[2]) for x in right if None not in (chat, ts, x[3]) and x[1] == chat and abs(x[3] - ts) <= dt.timedelta(seconds=30)]
        if near:
            best = min(near, key=lambda x: x[:4])
            want[i] = (best[1], best[2], best[4])
    assert got == want


def test_edges(spark):
    none = spark.createDataFrame([], "id long, chat string, ts timestamp, v int")
    one = spark.createDataFrame([(1, "a", T0, 3)], "id long, chat string, ts timestamp, v int")
    assert joins.sibling_window(none, none, ["chat"], "ts", "id").count() == 0
    assert [tuple(r) for r in joins.sibling_window(one, one.union(one), ["chat"], "ts", "id").collect()] == [(1, 1, "a")] * 2
    assert joins.nearest_asof_join(one, none, "chat", "ts", 9, ["v"], "id").count() == 0
    assert [tuple(r) for r in joins.nearest_asof_join(one, one, "chat", "ts", 9, ["v"], "id").collect()] == [(1, "a", T0, 3)]


def test_hot_chat_is_split_by_time(spark):
    moments = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("__k"), (F.col("id") * 1_000_000).alias("__t"), "id")

    def sizes(arrays, table):
        yield pa.table({"rows": [len(arrays["t"])], "own": [int(arrays["own"].sum())]})

    got = sweep.swept(moments, 5_000_000, sizes, sweep.T.StructType([sweep.T.StructField(c, sweep.T.LongType()) for c in ("rows", "own")]), 24).collect()
    assert sum(r.own for r in got) == 60_000 and len(got) >= 20
    assert max(r.rows for r in got) <= 2 * statistics.median(r.rows for r in got)
