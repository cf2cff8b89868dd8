"""Grouped reports over listings, transactions, interactions and metric logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.exprs import half_even
from gavel.functions.scale import best_per_key, group_percentiles, null_safe_join
from gavel.operators.hitters import largest_sums



def _n(cond: Column | None = None) -> Column:
    return F.count("*") if cond is None else F.count_if(cond)


def rate_pct(ok: Column, total: Column, digits: int = 1) -> Column:
    """100·ok/total rounded half-up; NULL when there is nothing to divide by."""
    return F.round(F.try_divide(ok * 100.0, total), digits)


def sync_summary(log: DataFrame, since: Column) -> DataFrame:
    """Per channel totals, cycles and last positions inside the window."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return log.filter(F.col("synced_at") >= since).groupBy("channel").agg(
        zero("messages_parsed").alias("parsed"),
        zero("new_listings"),
        zero("duplicates"),
        zero("errors"),
        _n().alias("cycles"),
        F.max("synced_at").alias("last_sync"),
        F.max("last_message_id").alias("last_id"),
    )


def filtered_counts(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column], distinct: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """COUNT(*) FILTER and COUNT(DISTINCT …) FILTER in one scan."""
    aggs = [_n(c).alias(name) for name, c in conditions.items()]
    aggs += [F.count_distinct(F.when(c, F.col(col))).alias(name) for name, (col, c) in distinct.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def kpi_rollup(
    df: DataFrame,
    as_of_local: str,
    sale_band: tuple[float, float] = (200_000, 50_000_000),
    rent_band: tuple[float, float] = (10_000, 1_500_000),
    psf_band: tuple[float, float] = (200, 15_000),
    utc_offset_hours: int = 4,
) -> DataFrame:
    """One-row headline record of active listings in a single aggregation.

    Averages only use prices inside their plausibility band. Day, week and month
    boundaries are those of the local zone (UTC+4 by default) at ``as_of_local``.
    """
    sale, rent = F.col("deal_type") == "sale", F.col("deal_type") == "rent"
    local = F.col("created_at") + F.expr(f"INTERVAL {utc_offset_hours} HOURS")
    day = F.lit(as_of_local).cast("date")
    midnight = lambda c: c.cast("timestamp_ntz")
    psf = F.try_divide(F.col("price"), F.col("size_sqft"))
    sale_ok = sale & F.col("price").between(*sale_band)
    rent_ok = rent & F.col("price").between(*rent_band)
    return df.agg(
        _n().alias("total"),
        _n(sale).alias("sale_total"),
        _n(rent).alias("rent_total"),
        _n(F.col("is_hot_deal")).alias("hot"),
        F.count_distinct("building").alias("buildings"),
        F.count_distinct("area").alias("areas"),
        F.round(F.avg(F.when(sale_ok, F.col("price")))).alias("avg_sale"),
        F.round(F.avg(F.when(rent_ok, F.col("price")))).alias("avg_rent"),
        F.round(F.avg(F.when(psf.between(*psf_band), psf))).alias("avg_sqft"),
        _n(sale & (F.col("price") > sale_band[1])).alias("corrupt_prices"),
        _n(sale_ok).alias("sale_clean"),
        _n(rent_ok).alias("rent_clean"),
        _n(local >= midnight(day)).alias("today"),
        _n((local >= midnight(F.date_sub(day, 1))) & (local < midnight(day))).alias("yesterday"),
        _n(local >= midnight(F.date_trunc("week", day))).alias("this_week"),
        _n(local >= midnight(F.date_trunc("month", day))).alias("this_month"),
    )


def group_top(df: DataFrame, key: str, limit: int, value: str | None = None, missing: str = "Unknown") -> DataFrame:
    """Most frequent values of ``key`` with count and, optionally, the average of ``value``."""
    aggs = [_n().alias("cnt")] + ([F.round(F.avg(value), 2).alias(f"avg_{value}")] if value else [])
    return (
        df.groupBy(F.coalesce(F.col(key), F.lit(missing)).alias(key)).agg(*aggs).orderBy(F.col("cnt").desc(), key).limit(limit)
    )


def daily_counts(df: DataFrame, ts: str, since: Column) -> DataFrame:
    return df.filter(F.col(ts) >= since).groupBy(F.to_date(ts).alias("day")).agg(_n().alias("cnt"))


def weighted_avg(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll monthly pre-aggregates up: prices weighted by deals, rates averaged, tops by maximum."""
    return df.groupBy(*keys).agg(
        F.sum("deals_count").alias("deals"),
        F.try_divide(F.sum(F.col("avg_price") * F.col("deals_count")), F.sum("deals_count")).alias("avg_price"),
        F.avg("median_price").alias("median_price"),
        F.max("top_price").alias("top_price"),
        F.avg("avg_psf").alias("avg_psf"),
        F.max("period_month").alias("last_month"),
    )


def mode_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(_n().alias("cnt"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("cnt"), F.col(value))).alias(value), F.sum("cnt").alias("deals")
    )


def busy_with_mode(df: DataFrame, key: str, value: str, date: str, window_days: int, min_deals: int, limit: int) -> DataFrame:
    """Keys with enough deals in the window that ends at the newest deal, and their modal value."""
    newest = df.agg(F.max(date)).scalar()
    recent = df.filter(F.trim(key) != "").filter(F.col(date) >= F.date_sub(newest, window_days))
    return mode_value(recent, [key], value).filter(F.col("deals") >= min_deals).orderBy(F.col("deals").desc(), key).limit(limit)


def share_of_total(df: DataFrame, group: str, part: str, min_total: int = 20) -> DataFrame:
    """Share of every part in its group, for groups with enough rows."""
    counts = df.filter(F.col(group).isNotNull() & F.col(part).isNotNull()).groupBy(group, part).agg(_n().alias("n"))
    return (
        counts.withColumn("total", F.sum("n").over(Window.partitionBy(group)))
        .filter(F.col("total") >= min_total)
        .withColumn("share_pct", half_even(F.col("n") / F.col("total") * 100.0, 2))
    )


def building_benchmark(tx: DataFrame, sale_floor: float = 50_000, rent_floor: float = 5_000, min_rows: int = 3) -> DataFrame:
    """Sale and rent price statistics per (building, area), joined side by side."""

    def side(deal: str, floor: float, p: str) -> DataFrame:
        rows = tx.filter((F.col("deal_type") == deal) & (F.col("price") > floor) & (F.trim("building") != ""))
        stats = rows.groupBy("building", "area").agg(
            F.round(F.avg("price")).alias(f"{p}_avg"), F.round(F.min("price")).alias(f"{p}_min"),
            F.round(F.max("price")).alias(f"{p}_max"), _n().alias(f"{p}_count"),
        ).filter(F.col(f"{p}_count") >= min_rows)
        med = group_percentiles(rows, ["building", "area"], "price", {"__m": 0.5}, "__n")
        return null_safe_join(stats, med, ["building", "area"]).withColumn(f"{p}_median", F.round("__m")).drop("__m", "__n")

    return side("sale", sale_floor, "sale").join(side("rent", rent_floor, "rent"), ["building", "area"], "full_outer")


def market_record(tx: DataFrame, area: str = "area") -> DataFrame:
    """One market snapshot row per area: prices per bedroom class, psf, median, liquidity, rents."""
    sale, rent = F.col("deal_type") == "sale", F.col("deal_type") == "rent"
    whole = lambda c: F.avg(c).cast("bigint")
    aggs = [
        F.count_if(sale).alias("transactions_count"),
        F.avg(F.when(sale & (F.col("size_sqft") > 0), F.col("price") / F.col("size_sqft"))).alias("avg_price_sqft"),
    ]
    for br in (1, 2, 3):
        aggs.append(whole(F.when(sale & (F.col("bedrooms") == br), F.col("price"))).alias(f"avg_price_{br}br"))
    aggs.append(whole(F.when(rent & (F.col("bedrooms") == 0), F.col("price"))).alias("avg_rent_studio"))
    for br in (1, 2, 3):
        aggs.append(whole(F.when(rent & (F.col("bedrooms") == br), F.col("price"))).alias(f"avg_rent_{br}br"))
    med = group_percentiles(tx.filter(sale), [area], "price", {"__m": 0.5}, "__n")
    return (
        null_safe_join(tx.groupBy(area).agg(*aggs), med, [area], "left")
        .withColumn("median_price", F.col("__m").cast("bigint"))
        .withColumn("liquidity_score", F.least(F.lit(10.0), half_even(F.col("transactions_count") / 10.0, 1)))
        .drop("__m", "__n")
    )


def two_bucket_pivot(df: DataFrame, keys: Sequence[str], bucket: str, values: Sequence[str], labels: Mapping[str, str]) -> DataFrame:
    """Put the rows of two buckets side by side (``labels``: bucket value → suffix)."""
    aggs = [F.max(F.when(F.col(bucket) == b, F.col(v))).alias(f"{v}_{s}") for b, s in labels.items() for v in values]
    return df.groupBy(*keys).agg(*aggs)


def group_members(df: DataFrame, keys: Sequence[str], member: str, min_size: int = 2) -> DataFrame:
    """Members of every group with at least ``min_size``, one row per member.

    The long form holds what an array per group would, without a row that grows with the
    group: a group of copies may own a third of the table.
    """
    sized = df.groupBy(*keys).agg(F.count_distinct(member).alias("group_size"), F.min(member).alias("first_member"))
    distinct = df.select(*keys, member).distinct()
    return null_safe_join(distinct, sized.filter(F.col("group_size") >= min_size), keys)


def small_set(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Sorted distinct values of a low-cardinality column (bot names, types) per key."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(col)), ",").alias(name))


def contact_sets(df: DataFrame, canonical: str, contacts: Mapping[str, Column]) -> DataFrame:
    """Distinct contacts of every canonical record, long form (canonical, kind, contact)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("contact")) for k, c in contacts.items()])
    return (
        df.select(F.col(canonical), F.explode(pairs).alias("c"))
        .select(canonical, "c.kind", "c.contact")
        .filter(F.trim("contact") != "")
        .distinct()
    )


def freshness(df: DataFrame, key: str, ts: str, expected: DataFrame, as_of: Column, lookback_days: int | None = None) -> DataFrame:
    """Age in hours of the newest row per expected key, with severity.

    ``expected`` holds (key, max_age_h). Missing → MEDIUM; older than 6× → HIGH, than 3× → MEDIUM.
    """
    seen = df if lookback_days is None else df.filter(F.col(ts) > as_of - F.expr(f"INTERVAL {lookback_days} DAYS"))
    newest = seen.groupBy(key).agg(F.max(ts).alias("last_ts"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 3.6e9
    return (
        expected.join(newest, key, "left")
        .withColumn("age_h", F.round(age, 2))
        .withColumn(
            "severity",
            F.when(F.col("last_ts").isNull(), "MEDIUM")
            .when(F.col("age_h") > F.col("max_age_h") * 6, "HIGH")
            .when(F.col("age_h") > F.col("max_age_h") * 3, "MEDIUM")
            .otherwise("OK"),
        )
    )


def stalled(df: DataFrame, ts: str, as_of: Column, max_hours: float = 48) -> DataFrame:
    """One row: newest timestamp, its age in hours and whether ingest has stalled."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.max(ts).cast("timestamp"))) / 3.6e9
    return df.agg(F.max(ts).alias("last_new"), F.round(age, 2).alias("hours_ago")).withColumn(
        "is_stalled", F.col("hours_ago") >= max_hours
    )


def transition_matrix(df: DataFrame, origin: str, target: str, user: str) -> DataFrame:
    return df.groupBy(origin, target).agg(_n().alias("jumps"), F.count_distinct(user).alias("users"))


def field_fill_rates(df: DataFrame, required: Mapping[str, Column], category: str, top: int = 5) -> DataFrame:
    """Share of fully parsed rows overall and for the most frequent categories."""
    full = reduce(lambda a, b: a & b, required.values())
    per = (
        df.filter(F.col(category).isNotNull()).groupBy(F.col(category).alias("scope"))
        .agg(_n().alias("total"), _n(full).alias("fully")).orderBy(F.col("total").desc(), "scope").limit(top)
    )
    whole = df.agg(F.lit("all").alias("scope"), _n().alias("total"), _n(full & F.col(category).isNotNull()).alias("fully"))
    return whole.unionByName(per).withColumn("pct", half_even(F.try_divide(F.col("fully") * 100.0, F.col("total")), 2))


def regression_flag(current: Column, previous: Column, drop: float = 2.0, slight: float = 0.5) -> Column:
    """Compare a rate with its earlier value."""
    delta = current - previous
    return F.when(delta < -drop, "regression").when(delta < -slight, "slight_drop").otherwise("stable")


def source_quality_score(df: DataFrame, source: str, since: Column) -> DataFrame:
    """Composite quality per source: .4 confidence + .25 building + .25 price − .3 review share."""
    total = F.count("*")
    out = df.filter(F.col("created_at") > since).groupBy(source).agg(
        total.alias("total"),
        F.avg("confidence_score").alias("avg_conf"),
        (_n(F.col("needs_review")) / total).alias("review"),
        (_n(F.col("building") != "") / total).alias("with_building"),
        (_n(F.col("price") > 0) / total).alias("with_price"),
    )
    return out.withColumn(
        "score",
        F.coalesce("avg_conf", F.lit(0.0)) * 0.4 + F.col("with_building") * 0.25 + F.col("with_price") * 0.25 - F.col("review") * 0.3,
    )


def heavy_hitters(df: DataFrame, key: str, cost: str, limit: int, min_mean: float) -> DataFrame:
    """Keys with the highest total cost, flagged when the mean is above the threshold. A summary of bounded size names the keys
    that can be among them; only their rows are counted. Where it cannot tell, all are."""
    some = largest_sums(df, key, cost, limit)
    return (
        (df if some is None else some).groupBy(key).agg(_n().alias("calls"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("mean_cost"))
        .orderBy(F.col("total_cost").desc(), key).limit(limit).withColumn("is_slow", F.col("mean_cost") >= min_mean)
    )


def price_stability(df: DataFrame, keys: Sequence[str], date: str, value: str, since: Column, min_quarters: int = 3) -> DataFrame:
    """100 − coefficient of variation of quarterly averages, clamped to 0..100."""
    quarters = (
        df.filter(F.col(date) >= since).groupBy(*keys, F.date_trunc("quarter", date).alias("q"))
        .agg(F.avg(value).alias("v")).filter(F.col("v") > 0)
    )
    return (
        quarters.groupBy(*keys).agg(_n().alias("quarters"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
        .filter((F.col("quarters") >= min_quarters) & (F.col("mu") > 0))
        .withColumn("stability_pct", half_even(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("sd") / F.col("mu") * 100.0)), 2))
        .withColumn("avg_value", half_even("mu", 2))
        .drop("mu", "sd")
    )


def reason_breakdown(df: DataFrame, reason: str) -> DataFrame:
    """Counts by the first ';'-token of a reason text."""
    return (
        df.filter(F.col(reason).isNotNull()).groupBy(F.split_part(F.col(reason), F.lit(";"), F.lit(1)).alias("reason")).agg(_n().alias("cnt"))
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return best_per_key(df, keys, order)


