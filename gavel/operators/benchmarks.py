"""Price benchmarks, outlier gates and rule checks on listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.exprs import half_even
from gavel.functions import lexicon as lx
from gavel.functions.coerce import SQFT_PER_SQM, rooms_label
from gavel.functions.scale import counted_percentiles, group_percentiles, null_safe_join, salt_nulls, value_counts
from gavel.operators.aggregates import mode_value, share_of_total
from gavel.operators.joins import lookup_with_fallback
from gavel.session import cut_lineage

BUCKET = ["area", "property_type", "bedrooms", "deal_type"]
MAD_TO_SIGMA = 1.4826


def area_price_benchmark(tx: DataFrame, min_sample: int = 5) -> DataFrame:
    """p10, median and p90 price per (area, type, bedrooms or NULL, deal type)."""
    priced = tx.filter((F.col("price") > 0) & F.col("area").isNotNull() & F.col("property_type").isNotNull())
    out = group_percentiles(priced, BUCKET, "price", {"p10": 0.10, "median": 0.50, "p90": 0.90}, "sample_size")
    return out.filter(F.col("sample_size") >= min_sample)


def area_property_profile(tx: DataFrame, as_of: str, months: int = 36, min_total: int = 20) -> DataFrame:
    """Share of each property type per area over the trailing window."""
    start = F.add_months(F.lit(as_of).cast("date"), -months)
    return share_of_total(tx.filter(F.col("deal_date") >= start), "area", "property_type", min_total)


def mad_outliers(
    df: DataFrame, keys: Sequence[str], price: str, min_bucket: int = 10, sigma: float = 3.0, hard_high: float = 5.0, hard_low: float = 0.2
) -> DataFrame:
    """Flag prices off the bucket median by more than 3 robust sigmas, 5×, or below 0.2×.

    Two exact medians per bucket (price, then deviation); smaller buckets are left alone.
    """
    rows = df.filter((F.col(price) > 0) & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    prices = cut_lineage(value_counts(rows, keys, price), "prices")
    med = counted_percentiles(prices, keys, {"median": 0.5}, "bucket_n").filter((F.col("bucket_n") >= min_bucket) & (F.col("median") > 0))
    med = cut_lineage(med, "medians")  # one row per bucket
    # deviations come from the counted prices, so the rows are read again only to be flagged
    moved = null_safe_join(prices, med, keys).groupBy(*keys, F.abs(F.col("__v") - F.col("median")).alias("__v")).agg(F.sum("__c").alias("__c"))
    mad = counted_percentiles(cut_lineage(moved, "deviations"), keys, {"mad": 0.5}, "__n").drop("__n")
    out = null_safe_join(rows, null_safe_join(med, mad, keys), keys).withColumn("deviation", F.abs(F.col(price) - F.col("median")))
    is_out = ((F.col("mad") > 0) & (F.col("deviation") > sigma * MAD_TO_SIGMA * F.col("mad"))) | (F.col(price) > hard_high * F.col("median")) | (F.col(price) < hard_low * F.col("median"))
    return out.withColumn("is_outlier", is_out).withColumn("ratio", F.col(price) / F.col("median"))


def _pct_text(c: Column) -> Column:
    return (c * 100).cast("bigint").cast("string")


def benchmark_gate(listings: DataFrame, bench: DataFrame, max_deviation: float = 0.40, types: Sequence[str] | None = None) -> DataFrame:
    """Reason text when a price is off its area benchmark, exact bedrooms first, then the NULL class."""
    usable = bench.filter((F.col("sample_size") >= 5) & (F.col("median") > 0)).select(*BUCKET, "median", "sample_size")
    looked = lookup_with_fallback(listings, usable, BUCKET, "bedrooms", ["median", "sample_size"], None)
    dev = F.abs(F.col("price") - F.col("median")) / F.col("median")
    allowed = F.lit(True) if types is None else F.col("property_type").isin(*types)
    hit = (F.col("price") > 0) & allowed & (dev > max_deviation)
    return looked.withColumn("bench_reason", F.when(hit, F.concat(F.lit("price_off_median_"), _pct_text(dev), F.lit("pct"))))


def tier_median_gate(listings: DataFrame, peers: DataFrame, max_deviation: float = 0.20, min_peers: int = 4) -> DataFrame:
    """Reason text when a price is off the median of its peer group."""
    rows = peers.filter((F.col("price") > 0) & F.col("bedrooms").isNotNull())
    med = group_percentiles(rows, BUCKET, "price", {"peer_median": 0.5}, "peers").filter((F.col("peers") >= min_peers) & (F.col("peer_median") > 0))
    joined = null_safe_join(listings, med, BUCKET, "left")
    dev = F.abs(F.col("price") - F.col("peer_median")) / F.col("peer_median")
    reason = F.concat(
        F.lit("tier_median_"), _pct_text(dev), F.lit("pct_"), F.when(F.col("price") > F.col("peer_median"), "above").otherwise("below"),
        F.lit("_median_"), (F.col("peer_median") / 1000).cast("bigint").cast("string"), F.lit("k_n"), F.col("peers").cast("string"))
    return joined.withColumn("tier_reason", F.when((F.col("price") > 0) & (dev > max_deviation), reason))


def profile_gate(listings: DataFrame, profile: DataFrame, gated: Sequence[str], min_share: float = 5.0, min_total: int = 20) -> DataFrame:
    """Reason text when a property type is rare, or never seen, in a well-known area."""
    totals = profile.groupBy("area").agg(F.max("total").alias("area_total"))
    shares = profile.select("area", "property_type", "share_pct")
    joined = listings.join(totals, "area", "left").join(shares, ["area", "property_type"], "left")
    known = F.col("property_type").isin(*gated) & (F.col("area_total") >= min_total)
    rare = F.when(F.col("share_pct").isNull(), "property_type_rare_for_area_0pct").when(
        F.col("share_pct") < min_share, F.concat(F.lit("property_type_rare_for_area_"), F.format_number("share_pct", 1), F.lit("pct")))
    return joined.withColumn("profile_reason", F.when(known, rare)).drop("area_total", "share_pct")


def listing_rules(df: DataFrame, premium_areas: Sequence[str] = ()) -> Column:
    """Array of violated rules, in rule order. Columns used: building, area, deal_type,
    property_type, bedrooms, size_sqft, price, text."""
    has_text = "text" in df.columns
    bld, br, price = F.col("building"), F.col("bedrooms"), F.col("price")
    pt = F.coalesce("property_type", F.lit("apartment"))
    deal = F.coalesce("deal_type", F.lit("sale"))
    sqft = F.coalesce("size_sqft", F.lit(0.0))
    text = F.lower(F.coalesce("text", F.lit(""))) if has_text else F.lit("")
    residential = pt.isin(*lx.RESIDENTIAL)
    priced = F.coalesce(price, F.lit(0)) > 0
    amount = price.cast("bigint").cast("string")
    floor = lambda table, default: F.coalesce(*[F.when(br == k, F.lit(v)) for k, v in table.items()], F.lit(default))
    psf = F.try_divide(price, sqft)
    tag = lambda name, value: F.concat(F.lit(name), value)
    rent, sale = deal == "rent", deal == "sale"
    premium = reduce(lambda a, b: a | b, [F.lower("area").contains(p) for p in premium_areas], F.lit(False))
    rules = [
        F.when(F.length(bld) > 60, "building_too_long"),
        F.when(bld.rlike(lx.BUILDING_DESCRIPTORS), "building_descriptor"),
        F.when(bld.rlike(r"\d{4,}"), "building_has_digits"),
        F.when((F.length(text) > 0) & (F.instr(F.substring(text, 1, 600), F.lower(bld)) == 0) & (F.instr(text, F.lower(bld)) > 0) & (bld != ""), "building_not_in_first_block"),
        F.when(priced & residential & rent & (price < 15000), tag("rent_absurd_low_", amount)),
        F.when(priced & residential & sale & (price < 350000), tag("sale_absurd_low_", amount)),
        F.when(priced & residential & rent & (br > 0) & (price < floor(lx.MIN_RENT_BY_BEDROOMS, 30000) * 0.5), tag("rent_too_low_", amount)),
        F.when(priced & residential & sale & (br > 0) & (price < floor(lx.MIN_SALE_BY_BEDROOMS, 350000) * 0.55), tag("sale_too_low_", amount)),
        F.when(priced & pt.isin("villa", "townhouse") & sale & premium & (price < 5_000_000), tag("sale_psf_absurd_premium_villa_", amount)),
        F.when(priced & residential & rent & (sqft > 200) & (psf < 8), tag("rent_psf_absurd_", psf.cast("bigint").cast("string"))),
        F.when(priced & residential & sale & (sqft > 200) & (psf < 150), tag("sale_psf_absurd_", psf.cast("bigint").cast("string"))),
        F.when((sqft > 0) & (br > 0) & (sqft < br * 200), tag("sqft_too_small_", sqft.cast("bigint").cast("string"))),
    ]
    if has_text:
        rules += [
            F.when((pt == "studio") & text.rlike(r"\b[1-9]\s*(?:br|bedroom|bhk)\b"), "studio_with_NBR"),
            F.when((pt == "villa") & (text != "") & (F.instr(F.substring(text, 1, 200), "villa") == 0) & (sqft > 0) & (sqft < 2000), "villa_no_word"),
            F.when((pt == "penthouse") & (text != "") & (F.instr(F.substring(text, 1, 300), "penthouse") == 0) & ~F.coalesce((br >= 3) & (sqft > 2000), F.lit(False)), "penthouse_no_word"),
        ]
    return F.array_compact(F.array(*rules))


def price_imputation(
    listings: DataFrame, deals: DataFrame, as_of: str, window_days: int = 180, min_deals: int = 5, discount: float = 0.95, size_range: tuple[float, float] = (100, 20000)
) -> DataFrame:
    """Fill missing price and size from recent deals of the same building and rooms label.

    ``deals``: building, rooms, price, price_per_sqm, deal_date. Present values stay.
    """
    sqft = F.col("price") / F.col("price_per_sqm") * SQFT_PER_SQM
    comps = (
        deals.filter((F.col("deal_date") > F.date_sub(F.lit(as_of).cast("date"), window_days)) & (F.col("price") > 0) & (F.col("price_per_sqm") > 0))
        .select(F.lower("building").alias("__b"), F.nullif(F.trim("rooms"), F.lit("")).alias("__r"), "price", sqft.alias("__sqft"))
        .filter(F.col("__sqft").between(*size_range))
    )
    by_price = group_percentiles(comps, ["__b", "__r"], "price", {"__pm": 0.5}, "comps").filter(F.col("comps") >= min_deals)
    by_size = group_percentiles(comps, ["__b", "__r"], "__sqft", {"__sm": 0.5}, "__n").drop("__n")
    bench = null_safe_join(by_price, by_size, ["__b", "__r"])
    keyed = listings.withColumn("__b", salt_nulls(F.lower(F.trim("building")), *listings.columns)).withColumn("__r", rooms_label("bedrooms"))
    joined = null_safe_join(keyed, bench, ["__b", "__r"], "left")
    wants = F.col("price").isNull() | F.col("size_sqft").isNull()
    return (
        joined.withColumn("was_filled", wants & F.col("comps").isNotNull())
        .withColumn("price", F.coalesce("price", half_even(F.col("__pm") * discount).cast("bigint")))
        .withColumn("size_sqft", F.coalesce("size_sqft", half_even("__sm", 1)))
        .drop("__b", "__r", "__pm", "__sm", "comps")
    )


def deal_type_by_benchmark(price: Column, sale_median: Column, sale_count: Column, rent_median: Column) -> Column:
    """struct(verdict, confidence): sale or rent by relative distance to both medians."""
    sale = F.when(F.coalesce(sale_count, F.lit(0)) >= 5, F.nullif(sale_median, F.lit(0)))
    rent = F.nullif(rent_median, F.lit(0))
    ds, dr = F.abs(price - sale) / sale, F.abs(price - rent) / rent
    out = lambda verdict, conf: F.struct(F.lit(verdict).alias("verdict"), F.lit(conf).alias("confidence"))
    both = F.when((dr < 0.6) & (ds > 0.7), out("rent", 0.85)).when((ds < 0.6) & (dr > 5), out("sale", 0.85))
    only_sale = (
        F.when(ds < 0.6, out("sale", 0.75)).when((price < sale * 0.05) & (price < 500_000), out("rent", 0.80))
        .when((price < sale * 0.15) & (price < 800_000), out("rent", 0.65))
    )
    only_rent = F.when(dr < 0.6, out("rent", 0.75)).when((price > rent * 10) & (price > 500_000), out("sale", 0.75))
    return F.when(F.coalesce(price, F.lit(0)) != 0, F.when(sale.isNotNull() & rent.isNotNull(), both).when(sale.isNotNull(), only_sale).when(rent.isNotNull(), only_rent))


def deal_quality(df: DataFrame) -> DataFrame:
    """Deal label, market comparison, yield, short-let range and 0–10 score.

    Columns: price, original_price, size_sqft, bedrooms, deal_type, sale_median, sale_count,
    rent_median, rent_count (building benchmark), mkt_sqft, mkt_rent_1br, mkt_growth (area).
    """
    d = lx.DEFAULT_MARKET
    price = F.nullif(F.col("price"), F.lit(0.0))
    mkt_sqft, rent1, growth = (F.coalesce(c, F.lit(d[k])) for c, k in (("mkt_sqft", "sqft"), ("mkt_rent_1br", "rent_1br"), ("mkt_growth", "growth")))
    disc = F.when(F.col("original_price") > price, half_even((F.col("original_price") - price) / F.col("original_price") * 100.0, 1))
    from_disc = F.when(disc >= 12, "very_good").when(disc >= 7, "good").when(disc >= 3, "interesting")
    vs_bld = F.when(
        (F.coalesce("deal_type", F.lit("sale")) == "sale") & (F.col("sale_median") > 0) & (F.col("sale_count") >= 5),
        half_even((price - F.col("sale_median")) / F.col("sale_median") * 100.0, 1))
    vs_bld = F.when(vs_bld.between(-90, 500), vs_bld)
    value = F.when(F.col("size_sqft") > 0, F.floor(F.col("size_sqft") * mkt_sqft))
    vs_area = F.when(vs_bld.isNull() & (value > 0), half_even((price - value) / value * 100.0, 1))
    vs = F.coalesce(vs_bld, vs_area)
    strong = F.coalesce((vs_bld <= -15) | (vs_area <= -12), F.lit(False)) | F.coalesce(vs_bld <= -15, F.lit(False)) | F.coalesce(vs_area <= -12, F.lit(False))
    mild = F.coalesce(vs_bld <= -8, F.lit(False)) | F.coalesce(vs_area <= -7, F.lit(False))
    hot = F.coalesce(disc >= 7, F.lit(False)) | strong
    quality = F.coalesce(from_disc, F.when(strong, "very_good").when(mild, "good"), F.lit("normal"))
    m = lx.RENT_MULTIPLIER
    br = F.coalesce(F.nullif(F.col("bedrooms"), F.lit(0)), F.lit(1))
    mult = F.when(br >= 4, m["4br+"]).when(br == 3, m["3br"]).when(br == 2, m["2br"]).otherwise(m["1br"])
    rent = F.when((F.col("rent_median") > 0) & (F.coalesce("rent_count", F.lit(0)) >= 3), F.col("rent_median").cast("bigint")).otherwise((rent1 * mult).cast("bigint"))
    roi = half_even(rent / price * 100.0, 1)
    score = (
        F.lit(5.0) + F.when(roi >= 8, 2).when(roi >= 6, 1).otherwise(0) + F.when(growth >= 7, 1.5).when(growth >= 5, 0.5).otherwise(0)
        + F.when(strong | mild, 1).otherwise(0) + F.when(hot, 0.5).otherwise(0)
    )
    known = price.isNotNull()
    return df.select(
        "*",
        F.when(known, disc).alias("discount_percent"),
        F.when(known, quality).otherwise("normal").alias("deal_quality"),
        (known & hot).alias("is_hot_deal"),
        (known & (strong | mild)).alias("is_below_market"),
        F.when(known, vs).alias("price_vs_market_percent"),
        F.when(known & vs_bld.isNotNull(), "building").when(known & vs_area.isNotNull(), "district").alias("benchmark_source"),
        F.when(known, roi).alias("roi_estimate"),
        F.when(known, (rent * 1.15).cast("bigint")).alias("short_let_low"),
        F.when(known, (rent * 1.35).cast("bigint")).alias("short_let_high"),
        F.when(known, F.least(half_even(score, 1), F.lit(10.0))).alias("quality_score"),
    )


def confidence(df: DataFrame) -> DataFrame:
    """Weighted field confidence with the review flag and the missing key fields."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    nz = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    conf = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    raw = (
        F.when(has("emirate"), conf("emirate_confidence") * 0.25).otherwise(0.0)
        + F.when(has("area"), conf("area_confidence") * 0.30).otherwise(0.0)
        + F.when(has("building"), conf("building_confidence") * 0.25).otherwise(0.05)
        + F.when(nz("price"), 0.10).otherwise(0.0)
        + F.when(F.col("bedrooms").isNotNull(), 0.05).otherwise(0.0)
        + F.when(nz("size_sqft"), 0.05).otherwise(0.0)
    )
    score = half_even(F.least(raw, F.lit(1.0)), 2)
    reasons = F.array_compact(F.array(
        F.when(~has("emirate"), "emirate not detected"), F.when(~has("area"), "area not detected"), F.when(~nz("price"), "price not found")))
    return df.select("*", score.alias("confidence"), ((score < 0.70) | (F.size(reasons) > 0)).alias("needs_review"),
                     F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).alias("review_reason"))


def deal_type_flip(
    deal_type: Column, price: Column, text: Column, bench: Column | None = None, min_sale: Column | float = 400_000, max_rent: Column | float = 3_000_000
) -> Column:
    """Deal type corrected by wording first, then building benchmark, then price limits.

    ``bench`` is the struct of :func:`deal_type_by_benchmark`; ``min_sale`` and ``max_rent``
    are the limits of the listing's bedroom class and area.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    buyer = t.rlike(lx.any_of(lx.BUYER_REQUEST)) & ~t.rlike("(?iuU)" + lx.RENT_CONTEXT) & ~t.rlike("(?iuU)" + lx.OFFER_WORDS)
    sale_kw, rent_kw = t.rlike(lx.any_of(lx.HARD_SALE)), t.rlike(lx.any_of(lx.HARD_RENT))
    worded = F.when(sale_kw, "sale").when(rent_kw, "rent").otherwise(deal_type)
    explicit = t.rlike("(?iuU)" + lx.EXPLICIT_SALE)
    priced = F.coalesce(price, F.lit(0)) > 0
    sale, rent = worded == "sale", worded == "rent"
    out = F.when(buyer, "sale").when(~priced, worded)
    if bench is not None:
        out = out.when(bench["confidence"] >= 0.75, bench["verdict"])
    low = min_sale if isinstance(min_sale, Column) else F.lit(min_sale)
    high = max_rent if isinstance(max_rent, Column) else F.lit(max_rent)
    return (
        out.when(sale & (price < 500_000) & (~explicit | (price < 200_000)), "rent")
        .when(rent & (price > 50_000_000), "sale")
        .when(rent & (price > 1_000_000) & t.rlike("(?iuU)" + lx.RENT_OVER_1M_SALE), "sale")
        .when(rent & (price > 1_500_000) & t.rlike("(?iuU)" + lx.MOTIVATED_SALE), "sale")
        .when(price < low * 0.5, "rent")
        .when(price > high * 2, "sale")
        .otherwise(worded)
    )


def majority_inference(listings: DataFrame, registry: DataFrame, min_votes: int = 5) -> DataFrame:
    """Missing area from the registry's modal area of the building, else from the own rows when
    the modal area has at least ``min_votes``."""
    key = F.lower(F.trim("building"))
    reg = mode_value(registry.withColumn("__k", key), ["__k"], "area").select("__k", F.col("area").alias("__reg"))
    own_rows = listings.withColumn("__k", key).filter(F.col("area").isNotNull())
    votes = own_rows.groupBy("__k", "area").agg(F.count(F.lit(1)).alias("__n"))
    own = votes.groupBy("__k").agg(F.min_by(F.struct("area", "__n"), F.struct(-F.col("__n"), F.col("area"))).alias("__o")).filter(F.col("__o.__n") >= min_votes)
    joined = listings.withColumn("__k", salt_nulls(key, *listings.columns)).join(reg, "__k", "left").join(own, "__k", "left")
    source = F.when(F.col("area").isNotNull(), "given").when(F.col("__reg").isNotNull(), "registry").when(F.col("__o").isNotNull(), "own_majority")
    return joined.withColumn("area_source", source).withColumn("area", F.coalesce("area", "__reg", F.col("__o.area"))).drop("__k", "__reg", "__o")


def canonicalise_entities(listings: DataFrame, buildings: DataFrame, areas: DataFrame) -> DataFrame:
    """Dictionary names for building and area; a building suffix ("tower A", " 2") or an area's
    trailing phase number is stripped for a second try; area filled from the building.

    ``buildings``: key, name, area; ``areas``: key, name.
    """
    bkey = F.regexp_replace(F.lower(F.trim("building")), r"\s+", " ")
    bstrip = F.trim(F.regexp_replace(bkey, r"\s+(tower\s+)?[abcivx\d]+$", ""))
    akey = F.lower(F.trim("area"))
    astrip = F.trim(F.regexp_replace(akey, r"\s*(phase\s*)?\d+\s*$", ""))
    b1 = buildings.select(F.col("key").alias("__b1"), F.struct("name", "area").alias("__h1"))
    b2 = buildings.select(F.col("key").alias("__b2"), F.struct("name", "area").alias("__h2"))
    a1 = areas.select(F.col("key").alias("__a1"), F.col("name").alias("__n1"))
    a2 = areas.select(F.col("key").alias("__a2"), F.col("name").alias("__n2"))
    j = (
        listings.withColumns({f"__{k}": salt_nulls(c, *listings.columns) for k, c in (("b1", bkey), ("b2", bstrip), ("a1", akey), ("a2", astrip))})
        .join(b1, "__b1", "left").join(b2, "__b2", "left").join(a1, "__a1", "left").join(a2, "__a2", "left")
    )
    hit = F.coalesce("__h1", "__h2")
    return (
        j.withColumn("canon_building", F.coalesce(hit["name"], F.trim("building")))
        .withColumn("canon_area", F.coalesce(hit["area"], "__n1", "__n2", F.trim("area")))
        .drop("__b1", "__b2", "__a1", "__a2", "__h1", "__h2", "__n1", "__n2")
    )


def bands(value: Column, table: Mapping[float, str], default: str) -> Column:
    """Label of the first lower bound (descending) that ``value`` reaches."""
    out = None
    for bound in sorted(table, reverse=True):
        out = F.when(value >= bound, table[bound]) if out is None else out.when(value >= bound, table[bound])
    return out.otherwise(default)
