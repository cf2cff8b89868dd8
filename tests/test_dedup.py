"""Merging and duplicate rules on small hand-made rows, against brute force."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from gavel.operators import dedup as dd
from gavel.sources import sinks
from tests.test_scale import _grams


def test_near_dup_merge_is_greedy(spark):
    rnd = random.Random(3)
    words = ["likes", "sea", "view", "two", "bedroom", "flat", "budget", "million", "marina"]
    rows = []
    for i in range(120):
        text = " ".join(rnd.sample(words, rnd.randint(2, 5)))
        rows.append((i, rnd.randint(0, 3), rnd.choice(["a", "b"]), text, round(rnd.random(), 2), rnd.randint(1, 5)))
    df = spark.createDataFrame(rows, "id bigint, user_id int, fact_type string, fact_text string, confidence double, reference_count int")
    kept, gone = dd.near_dup_merge(df, 0.6)
    into, alive = {}, {}
    for i, u, t, text, _, _ in rows:
        g = _grams(text)
        hit = next((k for k, kg in alive.setdefault((u, t), []) if len(g & kg) / len(g | kg) >= 0.6), None)
        if hit is None:
            alive[(u, t)].append((i, g))
        else:
            into[i] = hit
    assert {r.id: r.superseded_by for r in gone.collect()} == into
    assert sum(r.reference_count for r in kept.collect()) == sum(r[5] for r in rows)


def _missing(v):
    return v in (None, "", 0)


def _compatible(a, b):
    shared = False
    for f in ("price", "area", "building", "bedrooms"):
        x, y = a[f], b[f]
        if f == "bedrooms":
            if x is None or y is None:
                continue
        elif _missing(x) or _missing(y):
            continue
        shared = True
        if x != y:
            return False
    return shared or bool(a["text"]) or bool(b["text"])


def test_components_match_pairwise_definition(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        rows.append((i, f"g{rnd.randint(0, 60)}", rnd.choice([None, 0, 1, 2]), rnd.choice([None, "", "x", "y"]), rnd.choice([None, "t"]), rnd.choice([None, 0, 1]), rnd.choice(["", "text"])))
    cols = "id bigint, group_key string, price int, area string, building string, bedrooms int, text string"
    out = dd.compatible_components(spark.createDataFrame(rows, cols)).select("id", "component").collect()
    got = {}
    for r in out:
        got.setdefault(r.component, set()).add(r.id)
    recs = [dict(zip(["id", "g", "price", "area", "building", "bedrooms", "text"], r)) for r in rows]
    want = set()
    for g in {r["g"] for r in recs}:
        members = [r for r in recs if r["g"] == g]
        label = {r["id"]: r["id"] for r in members}
        changed = True
        while changed:
            changed = False
            for a, b in itertools.combinations(members, 2):
                if _compatible(a, b) and label[a["id"]] != label[b["id"]]:
                    low = min(label[a["id"]], label[b["id"]])
                    label[a["id"]] = label[b["id"]] = low
                    changed = True
        for root in set(label.values()):
            part = [r for r in members if label[r["id"]] == root]
            if len(part) > 1 and all(_compatible(a, b) for a, b in itertools.combinations(part, 2)):
                want.add(frozenset(r["id"] for r in part))
    assert {frozenset(v) for v in got.values()} == want


def test_flag_repeats_is_idempotent(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).alias("k"))
    once = dd.flag_repeats(df, ["k"], "id").filter(~F.col("is_dup")).select("id", "k")
    assert once.count() == 7 and dd.flag_repeats(once, ["k"], "id").filter("is_dup").count() == 0


def test_upsert_null_key_and_policies(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n"), (2, None)], "k int, v string")
    u = spark.createDataFrame([(None, "N"), (2, "b"), (1, None), (3, "c")], "k int, v string")
    read = lambda p: {(r.k, r.v) for r in sinks.upsert(t, u, ["k"], p).collect()}
    assert read("overwrite") == {(1, None), (None, "N"), (2, "b"), (3, "c")}
    assert read("keep_first") == {(1, "a"), (None, "n"), (2, None), (3, "c")}
    assert read("prefer_new") == {(1, "a"), (None, "N"), (2, "b"), (3, "c")}
    assert read("prefer_old") == {(1, "a"), (None, "n"), (2, "b"), (3, "c")}


def test_whole_texts_are_compared(spark):
    """Texts that share their first 500 characters are no copies, unless a prefix is asked for."""
    from gavel.operators import dedup as dd

    head = "same words again " * 40
    df = spark.createDataFrame([(head + "one",), (head + "two",)], "t string")
    assert df.select(dd.content_hash("t")).distinct().count() == 2 and df.select(dd.content_hash("t", 500)).distinct().count() == 1
    assert df.select(dd.text_signature("t")).distinct().count() == 2 and df.select(dd.text_signature("t", 250)).distinct().count() == 1


def test_offsets_beyond_ten_million(spark):
    from gavel.sources.tables import incremental_scan

    rows = spark.createDataFrame([("s", 20_000_000), ("s", 20_000_009)], "source string, id long")
    state = spark.createDataFrame([("s", 20_000_000, 20_000_005)], "source string, loaded_max long, stored_offset long")
    assert [r.id for r in incremental_scan(rows, state, "source", "id").collect()] == [20_000_009]


def test_vector_queries_in_blocks(spark):
    """More query vectors than one block holds."""
    from gavel.operators.search import vector_topk

    items = spark.range(200).selectExpr("id", "array(cos(id), sin(id)) AS vec")
    asked = spark.range(500).selectExpr("id AS qid", "array(cos(id / 3), sin(id / 3)) AS qvec")
    key = lambda df: sorted((r.qid, r.id, r.position) for r in df.collect())
    assert key(vector_topk(asked, items, 2, block=60)) == key(vector_topk(asked, items, 2)) and len(key(vector_topk(asked, items, 2))) == 1000


def test_message_merge_moves_texts_once(spark):
    """Texts stay out of the steps that find the sets; members get them back whole, and blank ones count as none."""
    schema = "id bigint, chat string, author string, message_id bigint, ts timestamp, text string, blocks_in_message int, price int, area string, building string, bedrooms int, size_sqft double, floor int, unit string, has_images boolean"
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in range(8)]
    long = "  " + "long text " * 9
    rows = [
        (1, "c", "a", 1, at[0], long, 1, None, "North", None, None, None, None, None, False), (2, "c", "a", 2, at[1], "5", 1, 900, None, None, None, None, None, None, True),
        (3, "c", "b", 3, at[0], long, 1, None, "North", None, None, None, None, None, False), (4, "c", "b", 4, at[1], "  ", 1, 900, "north", None, None, None, None, None, True),
        (5, "c", "z", 5, at[0], "alone", 1, 900, None, None, None, None, None, None, False)]
    merged, texts = dd.message_merge(spark.createDataFrame(rows, schema), ["price", "area"])
    assert [(r.primary_id, r.parts, r.price, r.area) for r in merged.orderBy("primary_id").collect()] == [(1, 2, 900, "North"), (3, 2, 900, "North")]
    assert [(r.primary_id, r.first_id, r.text) for r in texts.orderBy("first_id").collect()] == [(1, 1, long.strip(" ")), (1, 2, "5"), (3, 3, long.strip(" "))]
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
