"""Scores, area rankings and picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.exprs import half_even
from gavel.functions import lexicon as lx
from gavel.functions.scale import group_percentiles, salt_nulls, score_rank
from gavel.operators.aggregates import price_stability, two_bucket_pivot
from gavel.operators.benchmarks import bands
from gavel.operators.dedup import deal_gaps



def _month_back(as_of: str, months: int) -> Column:
    return F.add_months(F.lit(as_of).cast("date"), -months)


def _clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _share(value: Column, top: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)) / top * 100.0


def _with_maxima(df: DataFrame, floors: Mapping[str, float]) -> tuple[DataFrame, dict[str, Column]]:
    """Cohort maxima with floors as scalar subqueries over the (small) aggregated cohort."""
    tops = {c: df.agg(F.greatest(F.coalesce(F.max(c).cast("double"), F.lit(0.0)), F.lit(float(floor)))).scalar() for c, floor in floors.items()}
    return df, tops


def rank_areas_resale(tx: DataFrame, as_of: str, min_deals: int = 30) -> DataFrame:
    """Growth of price per unit (last 3 months vs the same months a year before), volume and
    liquidity, cohort-normalised .4/.3/.3. ``tx`` holds sales: area, deal_date, psf."""
    m3, m12, m15 = (_month_back(as_of, k) for k in (3, 12, 15))
    d = F.col("deal_date")
    raw = tx.groupBy("area").agg(
        F.avg(F.when(d >= m3, F.col("psf"))).alias("now"),
        F.avg(F.when((d >= m15) & (d < m12), F.col("psf"))).alias("then"),
        F.count_if(d >= m12).alias("deal_volume_12mo"),
        F.count_if(d >= m3).alias("__v3"),
    ).filter(F.col("deal_volume_12mo") >= min_deals)
    m = raw.select(
        "area", "deal_volume_12mo",
        F.when(F.col("then") > 0, half_even((F.col("now") - F.col("then")) / F.col("then") * 100.0, 2)).alias("price_growth_12mo_pct"),
        half_even("now", 2).alias("avg_psf"),
        half_even(F.col("__v3") / F.col("deal_volume_12mo") * 100.0, 2).alias("liquidity_score"),
    )
    m, top = _with_maxima(m, {"price_growth_12mo_pct": 10.0, "deal_volume_12mo": 1.0, "liquidity_score": 1.0})
    growth = _clamp(_share(F.col("price_growth_12mo_pct"), top["price_growth_12mo_pct"]), 0.0, 100.0)
    score = growth * 0.40 + _share(F.col("deal_volume_12mo"), top["deal_volume_12mo"]) * 0.30 + _share(F.col("liquidity_score"), top["liquidity_score"]) * 0.30
    return score_rank(m.withColumn("score", half_even(score, 2)), "score", [F.col("area")])


def rank_areas_rental(tx: DataFrame, as_of: str, min_contracts: int = 30) -> DataFrame:
    """Yield, turnover and rent growth .6/.2/.2. ``tx``: area, deal_type, deal_date, price."""
    m3, m12, m24 = (_month_back(as_of, k) for k in (3, 12, 24))
    d, p = F.col("deal_date"), F.col("price")
    rent = (F.col("deal_type") == "rent") & (p > 0)
    raw = tx.groupBy("area").agg(
        F.avg(F.when(rent & (d >= m12), p)).alias("now"),
        F.avg(F.when(rent & (d >= m24) & (d < m12), p)).alias("then"),
        F.count_if(rent & (d >= m12)).alias("deal_volume_12mo"),
        F.count_if(rent & (d >= m3)).alias("__v3"),
        F.avg(F.when((F.col("deal_type") == "sale") & (d >= m12), p)).alias("sale_price"),
    ).filter((F.col("deal_volume_12mo") >= min_contracts) & (F.col("sale_price") > 0))
    m = raw.select(
        "area", "deal_volume_12mo",
        half_even(F.col("now") / F.col("sale_price") * 100.0, 2).alias("rental_yield_pct"),
        half_even("now", 0).alias("avg_rent_annual"),
        half_even(F.col("__v3") / F.col("deal_volume_12mo") * 100.0, 2).alias("vacancy_score"),
        F.when(F.col("then") > 0, half_even((F.col("now") - F.col("then")) / F.col("then") * 100.0, 2)).alias("rent_growth_pct"),
    )
    m, top = _with_maxima(m, {"rental_yield_pct": 3.0, "vacancy_score": 1.0, "rent_growth_pct": 5.0})
    growth = _share(F.greatest(F.lit(0.0), F.coalesce("rent_growth_pct", F.lit(0.0))), top["rent_growth_pct"])
    score = _share(F.col("rental_yield_pct"), top["rental_yield_pct"]) * 0.60 + _share(F.col("vacancy_score"), top["vacancy_score"]) * 0.20 + growth * 0.20
    return score_rank(m.withColumn("score", half_even(score, 2)), "score", [F.col("area")])


LIVING_WEIGHTS = {"schools": 0.25, "safety": 0.20, "amenities": 0.15, "family": 0.20, "walk": 0.10}


def rank_areas_living(curated: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Curated 0–10 scores ×10 and price stability ×.10. ``curated``: area and the score columns."""
    stab = price_stability(tx, ["area"], "deal_date", "psf", _month_back(as_of, 24)).select("area", "stability_pct")
    blend = sum((F.coalesce(F.col(k), F.lit(0)) * 10 * w for k, w in LIVING_WEIGHTS.items()), F.lit(0.0)) + F.coalesce("stability_pct", F.lit(0.0)) * 0.10
    return score_rank(curated.join(stab, "area", "left").withColumn("score", half_even(blend, 2)), "score", [F.col("area")])


def area_topn(ranking: DataFrame, n: int) -> DataFrame:
    return ranking.filter(F.col("rank") <= n).orderBy("rank").limit(n)


def investment_metrics(df: DataFrame, premium_areas: Sequence[str] = ()) -> DataFrame:
    """Yield, growth, payback, five-year value and return, risk 1–10 and verdict.

    Columns: price, size_sqft, bedrooms, deal_type, area, building, property_type,
    bld_sale_psf, mkt_sqft, mkt_rent_1br, mkt_growth.
    """
    price, size = F.coalesce("price", F.lit(0.0)), F.coalesce("size_sqft", F.lit(0.0))
    br, mkt = F.col("bedrooms"), F.nullif(F.col("mkt_sqft"), F.lit(0.0))
    is_sale, is_rent = F.col("deal_type") == "sale", (F.col("deal_type") == "rent") & (price > 10000)
    listing_psf = F.when((price > 0) & (size > 100), price / size)
    vs_market = half_even((listing_psf - mkt) / mkt * 100.0, 1)
    rent1 = F.nullif(F.col("mkt_rent_1br"), F.lit(0.0))
    mult = F.when(br.isNull() | (br == 0), 0.7).when(br == 1, 1.0).when(br == 2, 1.6).when(br == 3, 2.3).when(br == 4, 3.0).when(br == 5, 4.0).otherwise(2.0)
    bld = F.nullif(F.col("bld_sale_psf"), F.lit(0.0))
    est_sale = F.when(size > 0, F.coalesce(bld, mkt, F.lit(1500.0)) * size).otherwise(price * 12)
    yearly = F.when(is_rent, price.cast("bigint")).when(is_sale, (F.coalesce(rent1, F.lit(80000.0)) * mult).cast("bigint")).otherwise((price * lx.DEFAULT_ROI / 100).cast("bigint"))
    raw_roi = F.when(is_rent, price / est_sale * 100.0).when(is_sale & (price > 0), yearly / price * 100.0).otherwise(F.lit(lx.DEFAULT_ROI))
    rounded = F.when(is_rent | is_sale, half_even(raw_roi, 1)).otherwise(F.lit(lx.DEFAULT_ROI))
    roi = _clamp(rounded, 0.0, 25.0)
    roi_default = F.when(is_rent, bld.isNull() & mkt.isNull()).when(is_sale, rent1.isNull() | (price == 0)).otherwise(F.lit(True))
    growth = _clamp(F.coalesce(F.col("mkt_growth").cast("double"), F.lit(lx.DEFAULT_GROWTH)), 1.0, 20.0)
    five = F.pow(1 + growth / 100, F.lit(5))
    priced_sale = is_sale & (price > 0)
    gain5 = F.when(priced_sale, half_even((five - 1) * 100.0, 1)).otherwise(0.0)
    total5 = half_even(gain5 + roi * 5, 1)
    bank = ((1 + lx.BANK_DEPOSIT_RATE / 100) ** 5 - 1) * 100
    defaults = roi_default | F.col("mkt_growth").isNull()
    premium = F.lit(False)
    for p in premium_areas:
        premium = premium | F.coalesce(F.lower("area").contains(p), F.lit(False))
    source = F.when(is_rent & bld.isNotNull(), "registry").when(mkt.isNotNull() & (listing_psf.isNotNull() | is_sale), "market").otherwise("estimated")
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    risk = (
        F.lit(5) - 2 * one(premium) + one(blank("area")) + one(blank("building") & ~F.coalesce("property_type", F.lit("apartment")).isin("plot", "whole_building"))
        + one(vs_market > 40) + one(mkt.isNull()) + 2 * one(price == 0) + one(size == 0) - one(source == "registry") + one(defaults)
    )
    risk = F.greatest(F.lit(1), F.least(F.lit(10), risk))
    verdict = (
        F.when(is_sale & (total5 >= 70) & (risk <= 4) & ~defaults, "STRONG_BUY").when(is_sale & (total5 >= 50) & (risk <= 6), "BUY")
        .when(is_sale & (total5 >= 30) & (risk <= 7), "HOLD").when(is_sale, "AVOID")
        .when((roi >= 8) & (risk <= 5) & ~defaults, "STRONG_BUY").when(roi >= 6, "BUY").when(roi >= 4, "HOLD").otherwise("AVOID")
    )
    return df.select(
        "*", roi.alias("roi"), half_even(growth, 1).alias("growth_pct"), yearly.alias("yearly_rent"),
        F.when(roi > 0, half_even(100.0 / roi, 1)).otherwise(99.0).alias("payback_years"),
        F.when(priced_sale, (price * five).cast("bigint")).otherwise(0).alias("value_in_5y"), gain5.alias("capital_gain_5y_pct"), total5.alias("total_return_5y_pct"),
        half_even(total5 - bank, 1).alias("vs_bank_pp"), risk.alias("risk_score"), verdict.alias("recommendation"), source.alias("data_source"), vs_market.alias("psf_vs_market_pct"),
    )


RATING_BANDS = {90: "A+", 80: "A", 70: "B+", 60: "B", 50: "C+", 40: "C"}


def investment_score(df: DataFrame) -> DataFrame:
    """0–100 score of four equal parts: discount to median, yearly growth, yield, risk.

    Columns: price, median, yoy, yield_pct, area_deals, building_deals, is_off_plan, status.
    """
    price_f = F.when((F.col("price") > 0) & (F.col("median") > 0), _clamp((1 - F.col("price") / F.col("median")) / 0.30)).otherwise(0.5)
    growth_f = F.coalesce(_clamp(F.col("yoy") / 15.0), F.lit(0.4))
    yield_f = F.coalesce(_clamp(F.col("yield_pct") / 10.0), F.lit(0.5))
    completion = F.when(F.coalesce("is_off_plan", F.lit(False)), 0.4).when(F.lower("status").isin("ready", "vacant", "rented", "tenanted", "occupied"), 1.0).otherwise(0.8)
    risk_f = _clamp(
        0.5 * completion + 0.3 * _clamp(F.coalesce("building_deals", F.lit(0)) / 200.0) + 0.2 * _clamp(F.coalesce("area_deals", F.lit(0)) / 100.0))
    total = 25.0 * price_f + 25.0 * growth_f + 25.0 * yield_f + 25.0 * risk_f
    return df.select(
        "*", half_even(25.0 * price_f, 1).alias("price_pts"), half_even(25.0 * growth_f, 1).alias("growth_pts"), half_even(25.0 * yield_f, 1).alias("yield_pts"),
        half_even(25.0 * risk_f, 1).alias("risk_pts"), half_even(total, 1).alias("score"), bands(total, RATING_BANDS, "D").alias("rating"))


def week_over_week_growth(
    tx: DataFrame, price_band: tuple[float, float] = (100_000, 100_000_000), days: int = 7, min_deals: int = 3, max_abs_growth: float = 200, limit: int = 30
) -> DataFrame:
    """Median of the last week against the week before, anchored on the newest deal."""
    newest = tx.agg(F.max("deal_date")).scalar()
    rows = tx.filter((F.col("deal_date") >= F.date_sub(newest, 2 * days)) & F.col("price").between(*price_band)).withColumn(
        "bucket", F.when(F.col("deal_date") > F.date_sub(newest, days), "cur").otherwise("prev"))
    med = group_percentiles(rows, ["area", "bucket"], "price", {"med": 0.5})
    wide = two_bucket_pivot(med, ["area"], "bucket", ["med", "n"], {"cur": "cur", "prev": "prev"}).filter((F.col("n_cur") >= min_deals) & (F.col("n_prev") >= min_deals))
    growth = (F.col("med_cur") - F.col("med_prev")) / F.col("med_prev") * 100.0
    return (
        wide.withColumn("volume", F.col("n_cur") + F.col("n_prev")).orderBy(F.col("volume").desc(), "area").limit(limit)
        .filter(F.col("med_prev") > 0).withColumn("growth_pct", growth).filter(F.abs("growth_pct") <= max_abs_growth)
        .withColumn("trend", F.when(F.col("growth_pct") > 5, "rising").when(F.col("growth_pct") < -5, "falling").otherwise("stable"))
    )


def top_deals(df: DataFrame, since: Column, ts: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.filter(F.col(ts) >= since).orderBy(*order).limit(n)


def tier_by_days(days: Column) -> Column:
    return F.when(days < 30, "A").when(days < 90, "B").when(days < 180, "C").otherwise("D")


def tier_by_rate(deals_per_month: Column) -> Column:
    return bands(deals_per_month, {1.0: "A", 0.5: "B", 0.2: "C"}, "D")


def supply_tier(supply: Column) -> Column:
    return F.when(supply >= 200, "A").when(supply >= 60, "B").when(supply >= 15, "C").otherwise("D")


def liquidity_tier(listings: DataFrame, deals: DataFrame, as_of: str, deals_12m: str | None = None) -> DataFrame:
    """A–D tier from mean days between deals over 24 months: building, else area, else the
    monthly deal rate, else C. An entity qualifies by the square of its deal count (see README)."""
    recent = deals.filter(F.col("deal_date") >= _month_back(as_of, 24))
    gaps = lambda key: deal_gaps(recent.withColumn("__k", F.lower(key)), ["__k"], "deal_date")
    b = gaps("building").filter(F.pow("deals", F.lit(2)) > 3).select(F.col("__k").alias("__b"), F.struct("deals", F.col("avg_days_between").alias("days")).alias("__bs"))
    a = gaps("area").filter(F.pow("deals", F.lit(2)) > 10).select(F.col("__k").alias("__a"), F.struct("deals", F.col("avg_days_between").alias("days")).alias("__as"))
    keys = {"__b": salt_nulls(F.lower("building"), *listings.columns), "__a": salt_nulls(F.lower("area"), *listings.columns)}
    j = listings.withColumns(keys).join(b, "__b", "left").join(a, "__a", "left")
    hit = F.coalesce("__bs", "__as")
    days = F.nullif(hit["days"], F.lit(0.0))
    rate = F.col(deals_12m) / 12.0 if deals_12m else F.lit(None).cast("double")
    tier = F.when(days.isNotNull(), tier_by_days(days)).when(rate > 0, tier_by_rate(rate)).otherwise("C")
    source = F.when(days.isNotNull(), F.when(F.col("__bs").isNotNull(), "building").otherwise("area")).when(rate > 0, "deal_rate").otherwise("unknown")
    return j.select(*listings.columns, tier.alias("tier"), source.alias("tier_source"), half_even(days, 1).alias("avg_days_between"))


def health_score(df: DataFrame, penalties: Mapping[str, int]) -> DataFrame:
    """100 minus weighted penalty counts, clamped to 0..100."""
    loss = sum((F.coalesce(F.col(c), F.lit(0)) * w for c, w in penalties.items()), F.lit(0))
    return df.withColumn("health_score", F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - loss)))
