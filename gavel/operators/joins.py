"""Join shapes used by the reports: alias lookups, fallbacks, as-of, rule matching."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.scale import best_per_key, null_safe_join, top_n
from gavel.functions.similarity import containment_pairs
from gavel.operators import sweep
from gavel.session import cut_lineage

#: Rows a task gathers before it keeps only the newest, and price bounds that listings are told apart by.
NEWEST_ROWS, MOST_BOUNDS = 200_000, 256


def anti_join_nullable(df: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not banned. Unlike NOT IN, a NULL among the banned keys bans nothing
    and rows with a NULL key stay."""
    return df.join(banned.select(key).distinct(), key, "left_anti")


def within_days_of_newest(df: DataFrame, date: str, days: int) -> DataFrame:
    """Window anchored on the newest row instead of the clock (scalar subquery, no join)."""
    return df.filter(F.col(date) >= F.date_sub(df.agg(F.max(date)).scalar(), days))


def alias_join(zones: DataFrame, stats: DataFrame, zone_key: str, zone_name: str, aliases: str, stats_name: str) -> DataFrame:
    """Zone ⋈ stats when the name equals the zone's name, its key, or any alias (case-blind).

    The OR becomes one equi-join on exploded spellings; a pair hit twice is kept once.
    """
    spellings = F.array_distinct(
        F.concat(F.array(F.lower(zone_name), F.lower(zone_key)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower))
    )
    lookup = zones.select(zone_key, F.explode(spellings).alias("__s")).filter(F.col("__s").isNotNull())
    return stats.withColumn("__s", F.lower(stats_name)).join(lookup, "__s").drop("__s")


def lookup_with_fallback(
    df: DataFrame, table: DataFrame, keys: Sequence[str], soft_key: str, values: Sequence[str], fallback: str | None
) -> DataFrame:
    """Look ``values`` up under the full key, else under the key with ``soft_key`` replaced by
    ``fallback`` (NULL or a catch-all label). The exact row wins as a whole."""
    hard = [k for k in keys if k != soft_key]
    packed = F.struct(*[F.col(v) for v in values])
    exact = table.filter(F.col(soft_key).isNotNull()).select(*keys, packed.alias("__exact"))
    general = table.filter(F.col(soft_key).eqNullSafe(F.lit(fallback))).select(*hard, packed.alias("__general"))
    exact_null = None if fallback is not None else general
    joined = df.join(exact, list(keys), "left")
    joined = joined.join(general if exact_null is None else exact_null, hard, "left")
    hit = F.coalesce("__exact", "__general")
    return joined.select(
        *df.columns, *[hit[v].alias(v) for v in values],
        F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__general").isNotNull(), "fallback").alias("match_kind"),
    )


def first_follow(events: DataFrame, user: str, ts: str, start: Column, follow: Column, within: str) -> DataFrame:
    """Per user: first ``start`` event and the first ``follow`` event in [t0, t0 + within)."""
    t0 = events.filter(start).groupBy(user).agg(F.min(ts).alias("t0"))
    hits = events.filter(follow).join(t0, user).filter((F.col(ts) >= F.col("t0")) & (F.col(ts) < F.col("t0") + F.expr(f"INTERVAL {within}")))
    return hits.groupBy(user, "t0").agg(F.min(ts).alias("t1"))


def newest_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` rows of every key with the largest ``order``, also of every batch of a stream: each task keeps ``n`` a key before
    and after the rows are dealt by key, so nothing is sorted and no more than that is shuffled."""
    gather = NEWEST_ROWS

    def newest(held: list[pa.Table]) -> pa.Table:
        frame = pd.DataFrame({"k": pa.concat_tables([t.select([key]) for t in held]).column(0).to_pandas(), "o": pa.concat_tables([t.select([order]) for t in held]).column(0).to_pandas()})
        frame = frame.sort_values("o", ascending=False, kind="stable")
        return pa.concat_tables(held).take(pa.array(np.sort(frame.index[frame.groupby("k").cumcount() < n].to_numpy())))

    def keep(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, gather
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= limit:
                held = [newest(held)]
                rows = held[0].num_rows
                if most and rows > most:
                    yield from held[0].to_batches()
                    held, rows = [], 0
                limit = max(gather, 2 * rows)
        if held:
            yield from newest(held).to_batches()

    before = df.mapInArrow(lambda batches: keep(batches, 4 * gather), df.schema)
    return before.repartition(key).mapInArrow(lambda batches: keep(batches, None), df.schema)


def _alike(listings: DataFrame, rules: DataFrame, fields: Sequence[str], price: Column) -> Column | None:
    """Key of listings that no rule tells apart: equal fields and the same place among all price bounds of the rules. None if the
    bounds are too many for that."""
    bounds = rules.select(F.explode(F.array(F.col("min_price").cast("double"), F.col("max_price").cast("double"))).alias("b")).filter("b <> 0").distinct().limit(MOST_BOUNDS + 1)
    known = sorted(r["b"] for r in bounds.collect())
    if len(known) > MOST_BOUNDS:
        return None
    p = price.cast("double")
    steps = F.array(*[F.lit(b) for b in known]).cast("array<double>")
    place = [F.size(F.filter(steps, lambda b: p >= b)), F.size(F.filter(steps, lambda b: p <= b)), p == 0]
    return F.to_json(F.struct(*[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)], *[c.alias(f"p{i}") for i, c in enumerate(place)]))


def rule_match(
    rules: DataFrame,
    listings: DataFrame,
    rule_id: str,
    fields: Sequence[str],
    top: int | None,
    price: str = "price",
    listing_id: str = "id",
    cursor: str | None = "last_listing_id",
    ranked: bool = True,
) -> DataFrame:
    """Stored rules × listings where a NULL rule field is a wildcard.

    Each rule names its filled fields (its mask). Listings are keyed once per mask that
    really occurs among the rules (at most 2^fields), so the wildcard match is an equi-join;
    price bounds and the cursor are checked on the joined rows. ``top`` keeps the newest
    matches per rule (of every batch, if listings are a stream, which takes ``ranked=False``: no ``pick``).

    With ``top``, rules never meet all their listings: of listings that no rule tells apart only the newest ``top`` stay, rules
    with equal fields and bounds are one class, and a class's newest matches go to its rules. A cursor takes ids off the old
    end, so it may come last.
    """
    sep = "\u001f"
    mask = F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields])
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("\u0000"))
    rule_key = F.concat_ws(sep, mask, *[F.when(F.col(f).isNull(), "*").otherwise(text(f)) for f in fields])
    masks = rules.select(mask.alias("m")).distinct().agg(F.collect_set("m")).scalar()
    bound = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit(""))
    keyed_rules = rules.select(
        F.col(rule_id), rule_key.alias("__k"), F.col("min_price").alias("__min"), F.col("max_price").alias("__max"),
        (F.col(cursor) if cursor else F.lit(None).cast("bigint")).alias("__cur"), F.concat_ws(sep, rule_key, bound("min_price"), bound("max_price")).alias("__class"),
    )
    parts = [
        F.when(F.substring("__m", i + 1, 1) == "1", text(f)).otherwise("*") for i, f in enumerate(fields)
    ]
    p = F.col(price)
    if top is not None:
        alike = _alike(listings, rules, fields, p)
        if alike is not None:
            listings = newest_per_key(listings.withColumn("__alike", alike), "__alike", listing_id, top).drop("__alike")
    keyed = listings.withColumn("__m", F.explode(masks)).withColumn("__k", F.concat_ws(sep, "__m", *parts)).drop("__m")
    has_min, has_max = F.coalesce(F.col("__min"), F.lit(0)) != 0, F.coalesce(F.col("__max"), F.lit(0)) != 0
    ok = (~has_min | F.coalesce(p >= F.col("__min"), F.lit(False))) & (~has_max | F.coalesce((p != 0) & (p <= F.col("__max")), F.lit(False)))
    above = F.col(listing_id) > F.coalesce("__cur", F.lit(0))
    if top is None:
        return keyed.join(keyed_rules, "__k").filter(ok & above).drop("__k", "__min", "__max", "__cur", "__class")
    classes = keyed_rules.groupBy("__class").agg(*[F.first(c).alias(c) for c in ("__k", "__min", "__max")])
    hits = newest_per_key(keyed.join(classes, "__k").filter(ok).drop("__k", "__min", "__max"), "__class", listing_id, top)
    own = hits.join(keyed_rules.select(rule_id, "__class", "__cur"), "__class").filter(above).drop("__class", "__cur")
    return top_n(own, [rule_id], [F.col(listing_id).desc()], top, "pick") if ranked else own


def nearest_asof(df: DataFrame, keys: Sequence[str], ts: str, target: Column, tolerance: str, values: Sequence[str]) -> DataFrame:
    """Per key the row nearest to ``target`` within ± ``tolerance``; the earlier row wins ties."""
    window = F.expr(f"INTERVAL {tolerance}")
    near = df.filter(F.col(ts).between(target - window, target + window))
    distance = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(target.cast("timestamp")))
    packed = F.struct(F.col(ts), *[F.col(v) for v in values])
    return near.groupBy(*keys).agg(F.min_by(packed, F.struct(distance, F.col(ts))).alias("__p")).select(*keys, "__p.*")


def nearest_asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, tolerance_s: int, values: Sequence[str], row_id: str) -> DataFrame:
    """Every left row with the right row of the same key nearest in time within a tolerance: a sorted sweep
    (:mod:`gavel.operators.sweep`), which splits a busy key by time."""
    return sweep.nearest(left, right, key, ts, tolerance_s, values, row_id)


def latest_asof(df: DataFrame, keys: Sequence[str], period: str, values: Sequence[str], as_of: Column | None = None) -> DataFrame:
    """Newest row per key, not after ``as_of``."""
    rows = df if as_of is None else df.filter(F.col(period) <= as_of)
    packed = F.struct(F.col(period), *[F.col(v) for v in values])
    return rows.groupBy(*keys).agg(F.max_by(packed, F.col(period)).alias("__p")).select(*keys, "__p.*")


def active_next_day(df: DataFrame, user: str, day: Column) -> DataFrame:
    """(user, day) pairs that are followed by activity on the next day."""
    days = df.select(user, day.alias("day")).distinct()
    back = days.select(user, F.date_sub("day", 1).alias("day"))
    return days.join(back, [user, "day"], "left_semi")


def next_quarter(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Average per quarter next to the average of the following calendar quarter."""
    q = df.groupBy(*keys, F.to_date(F.date_trunc("quarter", date)).alias("quarter")).agg(F.avg(value).alias("avg_now"))
    following = q.select(*keys, F.add_months("quarter", -3).alias("quarter"), F.col("avg_now").alias("avg_next"))
    return null_safe_join(q, following, [*keys, "quarter"])


def substring_lookup(df: DataFrame, names: DataFrame, col: str, name: str, min_len: int = 6) -> DataFrame:
    """Best dictionary name per distinct value of ``col``: exact, upper-cased, case-blind, then
    containment either way for values of at least ``min_len``; longest, then alphabetical.

    Works on distinct values; containment candidates come from rare n-grams, not a cross join.
    """
    # both are read by every stage: what they are made of is read once
    vals = cut_lineage(df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct(), "looked-up")
    dic = cut_lineage(names.select(F.col(name).alias("hit")).distinct(), "dictionary")
    exact = vals.join(dic, F.col("value") == F.col("hit")).select("value", "hit", F.lit(1).alias("stage"))
    upper = vals.join(dic, F.upper("value") == F.col("hit")).select("value", "hit", F.lit(2).alias("stage"))
    blind = vals.join(dic, F.lower("value") == F.lower("hit")).select("value", "hit", F.lit(3).alias("stage"))
    low_v = vals.filter(F.length("value") >= min_len).withColumn("v", F.lower("value"))
    low_d = dic.withColumn("n", F.lower("hit"))
    inside = containment_pairs(low_v, "v", low_d, "n").select(F.col("needle").alias("v"), F.col("text").alias("n"))
    around = containment_pairs(low_d, "n", low_v, "v").select(F.col("text").alias("v"), F.col("needle").alias("n"))
    part = inside.unionByName(around).distinct().join(low_v, "v").join(low_d, "n").select("value", "hit", F.lit(4).alias("stage"))
    found = reduce(DataFrame.unionByName, [exact, upper, blind, part])
    best = best_per_key(found, ["value"], [F.col("stage"), F.length("hit").desc(), F.col("hit")])
    return best


def sibling_window(anchors: DataFrame, rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, window_s: int = 120) -> DataFrame:
    """Rows of the same keys within ± ``window_s`` of each anchor, by a sorted sweep."""
    return sweep.siblings(anchors, rows, keys, ts, row_id, window_s)


def priority_union(sources: Mapping[int, DataFrame], key: str) -> DataFrame:
    """UNION ALL of several key → value maps, the first map that knows a key wins."""
    tagged = [df.withColumn("__src", F.lit(i)) for i, df in sources.items()]
    every = reduce(DataFrame.unionByName, tagged)
    return best_per_key(every, [key], [F.col("__src")]).drop("__src")
