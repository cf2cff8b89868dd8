"""Rules and listings: the newest matches of every rule, without all pairs."""

import random

import pytest

from gavel.operators import joins as jn

LISTING = "id bigint, deal_type string, area string, price double"
RULE = "uid int, deal_type string, area string, min_price double, max_price double, last_listing_id bigint"


def _tables(bounds):
    rng = random.Random(7)
    listings = [(i, rng.choice(["sale", "rent", None]), rng.choice("AB"), rng.choice([None, 0.0, 100.0, 250.0, 400.0, 1000.0])) for i in range(600)]
    rules = [(u, rng.choice(["sale", None]), rng.choice(["A", None]), rng.choice(bounds), rng.choice(bounds), rng.choice([None, 0, 590, 595])) for u in range(200)]
    return rules, listings


def _expected(rules, listings, top):
    out = set()
    for uid, deal, area, low, high, cur in rules:
        ok = [i for i, d, a, p in listings if deal in (None, d) and area in (None, a) and (not low or (p is not None and p >= low)) and (not high or (p and p <= high)) and i > (cur or 0)]
        out |= {(uid, i, n) for n, i in enumerate(sorted(ok, reverse=True)[:top], 1)}
    return out


@pytest.mark.parametrize("limits", [(200_000, 256), (64, 256), (64, 2)])  # (rows a task gathers, most bounds)
def test_newest_matches(spark, monkeypatch, limits):
    monkeypatch.setattr(jn, "NEWEST_ROWS", limits[0])
    monkeypatch.setattr(jn, "MOST_BOUNDS", limits[1])
    rules, listings = _tables([None, 0.0, 100.0, 250.0, 400.0])
    got = jn.rule_match(spark.createDataFrame(rules, RULE), spark.createDataFrame(listings, LISTING), "uid", ["deal_type", "area"], 3)
    assert {(r["uid"], r["id"], r["pick"]) for r in got.collect()} == _expected(rules, listings, 3)


def test_rules_do_not_meet_every_listing(spark):
    """A thousand equal rules on 3,000 listings: what reaches the rules is the newest matches, not three million pairs."""
    rules = spark.range(1000).selectExpr("CAST(id AS INT) AS uid", "'sale' AS deal_type", "CAST(NULL AS STRING) AS area", "0.0D AS min_price", "500.0D AS max_price", "CAST(0 AS BIGINT) AS last_listing_id")
    listings = spark.range(1, 3001).selectExpr("id", "'sale' AS deal_type", "'A' AS area", "CAST(id % 700 AS DOUBLE) AS price")
    pairs = spark.sparkContext.accumulator(0)
    made = jn.rule_match(rules, listings, "uid", ["deal_type", "area"], 3, ranked=False)

    def count(batches):
        for b in batches:
            pairs.add(b.num_rows)
            yield b

    assert made.mapInArrow(count, made.schema).count() == pairs.value == 3000
