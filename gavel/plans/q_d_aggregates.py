"""Aggregation reports."""

from pyspark.sql import functions as F

from gavel.functions.scale import group_percentiles
from gavel.operators import aggregates as ag
from gavel.plans.registry import query
from gavel.plans.roles import INTERACTIONS, LISTINGS, TX, interactions, listings, transactions
from gavel.sources.tables import load_table, ts


@query("filtered_counts", f"""WITH {LISTINGS}
SELECT count(*) FILTER (WHERE deal_type = 'sale') AS sale_total, count(*) FILTER (WHERE deal_type = 'rent') AS rent_total,
  count(*) FILTER (WHERE is_hot_deal) AS hot, count(DISTINCT building) FILTER (WHERE size_sqft IS NOT NULL) AS sized_buildings,
  count(DISTINCT area) FILTER (WHERE price > 400000) AS pricey_areas FROM listings""")
def q_filtered_counts(spark, d):
    return ag.filtered_counts(
        listings(spark, d), [],
        {"sale_total": F.col("deal_type") == "sale", "rent_total": F.col("deal_type") == "rent", "hot": F.col("is_hot_deal")},
        {"sized_buildings": ("building", F.col("size_sqft").isNotNull()), "pricey_areas": ("area", F.col("price") > 400000)},
    )


@query("kpi_rollup", f"""WITH {LISTINGS}
SELECT count(*) AS total, count(*) FILTER (WHERE deal_type = 'sale') AS sale_total, count(*) FILTER (WHERE deal_type = 'rent') AS rent_total,
  count(*) FILTER (WHERE is_hot_deal) AS hot, count(DISTINCT building) AS buildings, count(DISTINCT area) AS areas,
  round(avg(price) FILTER (WHERE deal_type = 'sale' AND price BETWEEN 200000 AND 400000)) AS avg_sale,
  round(avg(price) FILTER (WHERE deal_type = 'rent' AND price BETWEEN 10000 AND 300000)) AS avg_rent,
  round(avg(price / size_sqft) FILTER (WHERE price / size_sqft BETWEEN 150 AND 15000)) AS avg_sqft,
  count(*) FILTER (WHERE deal_type = 'sale' AND price > 400000) AS corrupt_prices,
  count(*) FILTER (WHERE deal_type = 'sale' AND price BETWEEN 200000 AND 400000) AS sale_clean,
  count(*) FILTER (WHERE deal_type = 'rent' AND price BETWEEN 10000 AND 300000) AS rent_clean,
  count(*) FILTER (WHERE created_at + INTERVAL 4 HOURS >= DATE '2001-07-20') AS today,
  count(*) FILTER (WHERE created_at + INTERVAL 4 HOURS >= DATE '2001-07-19' AND created_at + INTERVAL 4 HOURS < DATE '2001-07-20') AS yesterday,
  count(*) FILTER (WHERE created_at + INTERVAL 4 HOURS >= date_trunc('week', DATE '2001-07-20')) AS this_week,
  count(*) FILTER (WHERE created_at + INTERVAL 4 HOURS >= DATE '2001-07-01') AS this_month FROM listings""")
def q_kpi_rollup(spark, d):
    return ag.kpi_rollup(listings(spark, d), "2001-07-20", (200000, 400000), (10000, 300000), (150, 15000))


@query("group_top", f"""WITH {LISTINGS}
SELECT coalesce(deal_quality, 'Unknown') AS deal_quality, count(*) AS cnt, round(avg(price), 2) AS avg_price FROM listings GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 4""")
def q_group_top(spark, d):
    return ag.group_top(listings(spark, d), "deal_quality", 4, "price")


@query("daily_counts", f"""WITH {LISTINGS}
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, count(*) AS cnt FROM listings WHERE created_at >= TIMESTAMP '2001-07-02' GROUP BY 1""")
def q_daily_counts(spark, d):
    return ag.daily_counts(listings(spark, d), "created_at", ts("2001-07-02 00:00:00")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "cnt")


@query("percentile_cont", f"""WITH {TX}
SELECT area, deal_type, count(*) AS n, round(quantile_cont(price, 0.1), 4) AS p10, round(quantile_cont(price, 0.5), 4) AS median,
  round(quantile_cont(price, 0.9), 4) AS p90, round(quantile_cont(price, 0.99), 4) AS p99 FROM tx GROUP BY area, deal_type""")
def q_percentile_cont(spark, d):
    out = group_percentiles(transactions(spark, d), ["area", "deal_type"], "price", {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("area", "deal_type", "n", *[F.round(c, 4).alias(c) for c in ("p10", "median", "p90", "p99")])


@query("rate_pct", f"""WITH {INTERACTIONS}
SELECT bot_name, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE outcome = 'success') / nullif(count(*), 0), 1) AS success_pct,
  round(100.0::DOUBLE * count(*) FILTER (WHERE outcome = 'empty') / nullif(count(*) FILTER (WHERE outcome <> 'error'), 0), 1) AS empty_pct FROM interactions GROUP BY bot_name""")
def q_rate_pct(spark, d):
    i = interactions(spark, d)
    ok = F.count_if(F.col("outcome") == "success")
    return i.groupBy("bot_name").agg(
        F.count(F.lit(1)).alias("n"), ag.rate_pct(ok, F.count(F.lit(1))).alias("success_pct"),
        ag.rate_pct(F.count_if(F.col("outcome") == "empty"), F.count_if(F.col("outcome") != "error")).alias("empty_pct"))


_MONTHLY = """monthly AS (SELECT area, property_type, date_trunc('month', deal_date) AS period_month, count(*) AS deals_count, avg(price) AS avg_price,
  quantile_cont(price, 0.5) AS median_price, quantile_cont(price, 0.75) AS top_price, avg(price / size_sqft) AS avg_psf
  FROM tx WHERE deal_type = 'sale' GROUP BY ALL)"""


def monthly_stats(tx):
    """The read-model: monthly pre-aggregates per (area, property type) of sales."""
    sales = tx.filter(F.col("deal_type") == "sale").withColumn("period_month", F.to_date(F.date_trunc("month", "deal_date")))
    keys = ["area", "property_type", "period_month"]
    base = sales.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("deals_count"), F.avg("price").alias("avg_price"), F.avg(F.col("price") / F.col("size_sqft")).alias("avg_psf"))
    pct = group_percentiles(sales, keys, "price", {"median_price": 0.5, "top_price": 0.75}).drop("n")
    return base.join(pct, keys)


@query("weighted_avg", f"""WITH {TX}, {_MONTHLY}
SELECT area, property_type, CAST(sum(deals_count) AS BIGINT) AS deals, round(sum(avg_price * deals_count) / nullif(sum(deals_count), 0), 6) AS avg_price,
  CAST(trunc(avg(median_price)) AS BIGINT) AS median_price, round(max(top_price), 6) AS top_price, round(avg(avg_psf), 6) AS avg_psf,
  strftime(max(period_month), '%Y-%m-%d') AS last_month FROM monthly GROUP BY area, property_type""")
def q_weighted_avg(spark, d):
    out = ag.weighted_avg(monthly_stats(transactions(spark, d)), ["area", "property_type"])
    return out.select("area", "property_type", "deals", *[F.round(c, 6).alias(c) for c in ("avg_price", "top_price", "avg_psf")],
                      F.col("median_price").cast("bigint").alias("median_price"),
                      F.date_format("last_month", "yyyy-MM-dd").alias("last_month"))


@query("mode_value", f"""WITH {TX}, c AS (SELECT building, area, count(*) AS cnt FROM tx WHERE deal_date >= (SELECT max(deal_date) FROM tx) - INTERVAL 365 DAYS GROUP BY ALL),
r AS (SELECT building, area, row_number() OVER (PARTITION BY building ORDER BY cnt DESC, area) AS rn, sum(cnt) OVER (PARTITION BY building) AS deals FROM c)
SELECT building, area, CAST(deals AS BIGINT) AS deals FROM r WHERE rn = 1 AND deals >= 5 ORDER BY deals DESC, building LIMIT 40""")
def q_mode_value(spark, d):
    return ag.busy_with_mode(transactions(spark, d), "building", "area", "deal_date", 365, 5, 40)


@query("share_of_total", f"""WITH {TX}, c AS (SELECT area, property_type, count(*) AS n FROM tx GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY area) AS total FROM c)
SELECT area, property_type, n, CAST(total AS BIGINT) AS total, round_even(n / total * 100.0::DOUBLE, 2) AS share_pct FROM t WHERE total >= 20""")
def q_share_of_total(spark, d):
    return ag.share_of_total(transactions(spark, d), "area", "property_type")


@query("building_benchmark", f"""WITH {TX},
s AS (SELECT building, area, round(avg(price)) AS sale_avg, round(quantile_cont(price, 0.5)) AS sale_median, round(min(price)) AS sale_min, round(max(price)) AS sale_max,
  count(*) AS sale_count FROM tx WHERE deal_type = 'sale' AND price > 50000 GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT building, area, round(avg(price)) AS rent_avg, round(quantile_cont(price, 0.5)) AS rent_median, round(min(price)) AS rent_min, round(max(price)) AS rent_max,
  count(*) AS rent_count FROM tx WHERE deal_type = 'rent' AND price > 5000 GROUP BY ALL HAVING count(*) >= 3)
SELECT coalesce(s.building, r.building) AS building, coalesce(s.area, r.area) AS area, sale_avg, sale_median, sale_min, sale_max, sale_count,
  rent_avg, rent_median, rent_min, rent_max, rent_count FROM s FULL JOIN r ON s.building = r.building AND s.area = r.area""")
def q_building_benchmark(spark, d):
    return ag.building_benchmark(transactions(spark, d))


def _cls(deal: str, br: int) -> str:
    return f"CAST(trunc(avg(price) FILTER (WHERE deal_type = '{deal}' AND bedrooms = {br})) AS BIGINT)"


@query("market_record", f"""WITH {TX}
SELECT area, count(*) FILTER (WHERE deal_type = 'sale') AS transactions_count,
  round(avg(price / size_sqft) FILTER (WHERE deal_type = 'sale' AND size_sqft > 0), 3) AS avg_price_sqft,
  {_cls('sale', 1)} AS avg_price_1br, {_cls('sale', 2)} AS avg_price_2br, {_cls('sale', 3)} AS avg_price_3br,
  {_cls('rent', 0)} AS avg_rent_studio, {_cls('rent', 1)} AS avg_rent_1br, {_cls('rent', 2)} AS avg_rent_2br, {_cls('rent', 3)} AS avg_rent_3br,
  CAST(trunc(quantile_cont(price, 0.5) FILTER (WHERE deal_type = 'sale')) AS BIGINT) AS median_price,
  least(10.0::DOUBLE, round_even(count(*) FILTER (WHERE deal_type = 'sale') / 10.0::DOUBLE, 1)) AS liquidity_score FROM tx GROUP BY area""")
def q_market_record(spark, d):
    out = ag.market_record(transactions(spark, d))
    return out.withColumn("avg_price_sqft", F.round("avg_price_sqft", 3))


@query("pivot_two_bucket", f"""WITH {INTERACTIONS}, w AS (SELECT bot_name, CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN 'now' ELSE 'prev' END AS bucket, count(*) AS n, max(latency_ms) AS worst
  FROM interactions WHERE ts >= TIMESTAMP '2024-01-17' GROUP BY ALL)
SELECT bot_name, max(n) FILTER (WHERE bucket = 'now') AS n_this, max(worst) FILTER (WHERE bucket = 'now') AS worst_this,
  max(n) FILTER (WHERE bucket = 'prev') AS n_last, max(worst) FILTER (WHERE bucket = 'prev') AS worst_last FROM w GROUP BY bot_name""")
def q_pivot_two_bucket(spark, d):
    w = (
        interactions(spark, d).filter(F.col("ts") >= ts("2024-01-17 00:00:00"))
        .groupBy("bot_name", F.when(F.col("ts") >= ts("2024-01-24 00:00:00"), "now").otherwise("prev").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("worst"))
    )
    return ag.two_bucket_pivot(w, ["bot_name"], "bucket", ["n", "worst"], {"now": "this", "prev": "last"})


@query("array_agg_group", """
WITH g AS (SELECT md5(text) AS k, count(DISTINCT doc_id) AS group_size, min(doc_id) AS first_member FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)
SELECT d.doc_id, g.group_size, g.first_member FROM documents d JOIN g ON md5(d.text) = g.k""")
def q_array_agg_group(spark, d):
    docs = load_table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    return ag.group_members(docs, ["k"], "doc_id").select("doc_id", "group_size", "first_member")


@query("small_set", f"""WITH {INTERACTIONS} SELECT user_message, string_agg(DISTINCT bot_name, ',' ORDER BY bot_name) AS bots FROM interactions GROUP BY user_message""")
def q_small_set(spark, d):
    return ag.small_set(interactions(spark, d), ["user_message"], "bot_name", "bots")


@query("contact_sets", f"""WITH {LISTINGS}
SELECT DISTINCT building, 'name' AS kind, seller AS contact FROM listings
UNION ALL SELECT DISTINCT building, 'phone', right(regexp_replace(seller, '[^0-9]', '', 'g'), 9) FROM listings
UNION ALL SELECT DISTINCT building, 'channel', '@' || property_type FROM listings WHERE is_hot_deal""")
def q_contact_sets(spark, d):
    from gavel.functions.coerce import norm_phone

    return ag.contact_sets(
        listings(spark, d), "building",
        {"name": F.col("seller"), "phone": norm_phone("seller"), "channel": F.when(F.col("is_hot_deal"), F.concat(F.lit("@"), "property_type"))})


@query("window_freshness", """
WITH expected AS (SELECT DISTINCT source AS k, CASE WHEN right(source, 1) IN ('1', '3') THEN 0.05 WHEN right(source, 1) IN ('2', '5') THEN 0.2 ELSE 2.0 END AS max_age_h FROM documents),
newest AS (SELECT source AS k, max(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 45)) AS last_ts FROM documents WHERE source NOT LIKE '%7' GROUP BY 1),
top AS (SELECT max(last_ts) AS t FROM newest),
j AS (SELECT e.k, e.max_age_h, last_ts, round((epoch_us(t) - epoch_us(last_ts)) / 3.6e9::DOUBLE, 2) AS age_h FROM expected e LEFT JOIN newest n ON e.k = n.k, top)
SELECT k AS chat, age_h, CASE WHEN last_ts IS NULL THEN 'MEDIUM' WHEN age_h > max_age_h * 6 THEN 'HIGH' WHEN age_h > max_age_h * 3 THEN 'MEDIUM' ELSE 'OK' END AS severity FROM j""")
def q_window_freshness(spark, d):
    from gavel.plans.roles import messages

    m = messages(spark, d)
    last = F.right("chat", F.lit(1))
    expected = m.select("chat").distinct().withColumn(
        "max_age_h", F.when(last.isin("1", "3"), 0.05).when(last.isin("2", "5"), 0.2).otherwise(2.0))
    seen = m.filter(~F.col("chat").endswith("7"))
    return ag.freshness(seen, "chat", "ts", expected, seen.agg(F.max("ts")).scalar()).select("chat", "age_h", "severity")


@query("stalled_ingest", f"""WITH {LISTINGS}
SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_new, round((epoch_us(TIMESTAMP '2001-08-05') - epoch_us(max(created_at))) / 3.6e9::DOUBLE, 2) AS hours_ago,
  round((epoch_us(TIMESTAMP '2001-08-05') - epoch_us(max(created_at))) / 3.6e9::DOUBLE, 2) >= 48 AS is_stalled FROM listings""")
def q_stalled(spark, d):
    return ag.stalled(listings(spark, d), "created_at", ts("2001-08-05 00:00:00")).withColumn("last_new", F.date_format("last_new", "yyyy-MM-dd HH:mm:ss"))


@query("transition_matrix", f"""WITH {INTERACTIONS}, j AS (SELECT user_id, bot_name AS to_bot, ['resale', 'analytics', 'roi', 'hub'][k // 25 + 1] AS from_bot FROM interactions)
SELECT from_bot, to_bot, count(*) AS jumps, count(DISTINCT user_id) AS users FROM j GROUP BY from_bot, to_bot""")
def q_transition_matrix(spark, d):
    from gavel.plans.roles import BOTS

    i = interactions(spark, d)
    origin = F.element_at(F.array(*[F.lit(b) for b in BOTS]), F.floor(F.col("k") / 25).cast("int") + 1)
    return ag.transition_matrix(i.select("user_id", F.col("bot_name").alias("to_bot"), origin.alias("from_bot")), "from_bot", "to_bot", "user_id")


@query("field_fill_rates", f"""WITH {LISTINGS}, f AS (SELECT *, size_sqft IS NOT NULL AND deal_quality IS NOT NULL AND price > 0 AS fully FROM listings),
p AS (SELECT property_type AS scope, count(*) AS total, count(*) FILTER (WHERE fully) AS fully FROM f GROUP BY 1 ORDER BY total DESC, scope LIMIT 3),
u AS (SELECT 'all' AS scope, count(*) AS total, count(*) FILTER (WHERE fully) AS fully FROM f UNION ALL SELECT * FROM p)
SELECT scope, total, fully, round_even(fully * 100.0::DOUBLE / total, 2) AS pct FROM u""")
def q_field_fill_rates(spark, d):
    return ag.field_fill_rates(
        listings(spark, d),
        {"size": F.col("size_sqft").isNotNull(), "quality": F.col("deal_quality").isNotNull(), "price": F.coalesce(F.col("price") > 0, F.lit(False))},
        "property_type", 3)


@query("fill_rate_delta", f"""WITH {LISTINGS}, m AS (SELECT date_trunc('month', created_at) AS mth, 100.0::DOUBLE * count(deal_quality) / count(*) AS pct FROM listings GROUP BY 1),
l AS (SELECT mth, pct, lag(pct) OVER (ORDER BY mth) AS prev FROM m)
SELECT strftime(mth, '%Y-%m') AS month, round(pct, 4) AS pct, round(pct - prev, 4) AS delta,
  CASE WHEN pct - prev < -2 THEN 'regression' WHEN pct - prev < -0.5 THEN 'slight_drop' ELSE 'stable' END AS flag FROM l""")
def q_fill_rate_delta(spark, d):
    m = listings(spark, d).groupBy(F.date_trunc("month", "created_at").alias("mth")).agg((F.count("deal_quality") * 100.0 / F.count(F.lit(1))).alias("pct"))
    prev = m.select(F.add_months(F.to_date("mth"), 1).cast("timestamp").alias("mth"), F.col("pct").alias("prev"))
    return m.withColumn("mth", F.col("mth").cast("timestamp")).join(prev, "mth", "left").select(
        F.date_format("mth", "yyyy-MM").alias("month"), F.round("pct", 4).alias("pct"), F.round(F.col("pct") - F.col("prev"), 4).alias("delta"),
        ag.regression_flag(F.col("pct"), F.col("prev")).alias("flag"))


@query("source_quality_score", f"""WITH {LISTINGS}, a AS (SELECT area, count(*) AS total, avg(confidence_score) AS c, count(*) FILTER (WHERE deal_quality IS NULL) / count(*) AS r,
  count(*) FILTER (WHERE building <> '') / count(*) AS b, count(*) FILTER (WHERE price > 0) / count(*) AS p FROM listings WHERE created_at > TIMESTAMP '2001-01-01' GROUP BY area)
SELECT area, total, round(coalesce(c, 0) * 0.4::DOUBLE + b * 0.25::DOUBLE + p * 0.25::DOUBLE - r * 0.3::DOUBLE, 6) AS score FROM a""")
def q_source_quality(spark, d):
    l = listings(spark, d).withColumn("needs_review", F.col("deal_quality").isNull())
    return ag.source_quality_score(l, "area", ts("2001-01-01 00:00:00")).select("area", "total", F.round("score", 6).alias("score"))


@query("heavy_hitters", f"""WITH {INTERACTIONS}
SELECT user_message, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS total_cost, round(avg(latency_ms), 4) AS mean_cost, avg(latency_ms) >= 1000 AS is_slow
FROM interactions GROUP BY 1 ORDER BY total_cost DESC, user_message LIMIT 15""")
def q_heavy_hitters(spark, d):
    return ag.heavy_hitters(interactions(spark, d), "user_message", "latency_ms", 15, 1000).withColumn("mean_cost", F.round("mean_cost", 4))


@query("stddev_cv", f"""WITH {TX}, q AS (SELECT area, date_trunc('quarter', deal_date) AS q, avg(price / size_sqft) AS v FROM tx WHERE deal_type = 'sale' AND deal_date >= DATE '1999-08-01' GROUP BY ALL),
s AS (SELECT area, count(*) AS quarters, avg(v) AS mu, stddev_pop(v) AS sd FROM q WHERE v > 0 GROUP BY area HAVING count(*) >= 3)
SELECT area, quarters, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - sd / mu * 100.0::DOUBLE)), 2) AS stability_pct, round_even(mu, 2) AS avg_value FROM s""")
def q_stddev_cv(spark, d):
    tx = transactions(spark, d).filter(F.col("deal_type") == "sale").withColumn("psf", F.col("price") / F.col("size_sqft"))
    return ag.price_stability(tx, ["area"], "deal_date", "psf", F.lit("1999-08-01").cast("date"))


@query("reason_breakdown", f"""WITH {LISTINGS}, r AS (SELECT CASE WHEN size_sqft IS NULL THEN 'no size' || ';' || status WHEN deal_quality IS NULL THEN 'no quality' END AS reason FROM listings)
SELECT split_part(reason, ';', 1) AS reason, count(*) AS cnt FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def q_reason_breakdown(spark, d):
    reason = F.when(F.col("size_sqft").isNull(), F.concat(F.lit("no size;"), "status")).when(F.col("deal_quality").isNull(), "no quality")
    return ag.reason_breakdown(listings(spark, d).withColumn("reason", reason), "reason")
