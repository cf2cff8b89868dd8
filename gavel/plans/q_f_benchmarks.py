"""Benchmarks, gates and rule checks."""

from pyspark.sql import functions as F

from gavel.functions.scale import group_percentiles
from gavel.operators import benchmarks as bm
from gavel.plans.registry import query
from gavel.plans.roles import AS_OF, LISTINGS, TX, listings, transactions
from gavel.sources.tables import load_table

BENCH = """bench AS (SELECT area, property_type, bedrooms, deal_type, quantile_cont(price, 0.1) AS p10, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.9) AS p90,
  count(*) AS sample_size FROM tx WHERE price > 0 GROUP BY ALL HAVING count(*) >= 5)"""


@query("area_price_benchmark", f"""WITH {TX}, {BENCH}
SELECT area, property_type, bedrooms, deal_type, round(p10, 4) AS p10, round(median, 4) AS median, round(p90, 4) AS p90, sample_size FROM bench""")
def q_area_price_benchmark(spark, d):
    b = bm.area_price_benchmark(transactions(spark, d))
    return b.select(*bm.BUCKET, "sample_size", *[F.round(c, 4).alias(c) for c in ("p10", "median", "p90")])


@query("area_property_profile", f"""WITH {TX}, c AS (SELECT area, property_type, count(*) AS n FROM tx WHERE deal_date >= DATE '1998-08-01' GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY area) AS total FROM c)
SELECT area, property_type, n, CAST(total AS BIGINT) AS total, round_even(n / total * 100.0::DOUBLE, 2) AS share_pct FROM t WHERE total >= 20""")
def q_area_property_profile(spark, d):
    return bm.area_property_profile(transactions(spark, d), AS_OF)


@query("mad_outliers", f"""WITH {TX}, m AS (SELECT area, property_type, deal_type, count(*) AS n, quantile_cont(price, 0.5) AS med FROM tx GROUP BY ALL HAVING count(*) >= 10),
dv AS (SELECT t.*, n, med, abs(price - med) AS dev FROM tx t JOIN m USING (area, property_type, deal_type)),
k AS (SELECT area, property_type, deal_type, quantile_cont(dev, 0.5) AS mad FROM dv GROUP BY ALL)
SELECT order_id, line_no, price, round(med, 4) AS median, round(mad, 4) AS mad, (mad > 0 AND dev > 1.5::DOUBLE * 1.4826::DOUBLE * mad) OR price > 5 * med OR price < 0.2::DOUBLE * med AS is_outlier FROM dv JOIN k USING (area, property_type, deal_type)""")
def q_mad_outliers(spark, d):
    out = bm.mad_outliers(transactions(spark, d), ["area", "property_type", "deal_type"], "price", sigma=1.5)
    return out.select("order_id", "line_no", "price", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "is_outlier")


_ASK = """ask AS (SELECT order_id, line_no, area, property_type, CASE WHEN line_no > 5 THEN NULL ELSE bedrooms END AS bedrooms, deal_type, price FROM tx WHERE deal_date >= DATE '2001-01-01')"""


def _ask(spark, d):
    tx = transactions(spark, d).filter(F.col("deal_date") >= F.lit("2001-01-01").cast("date"))
    return tx.select("order_id", "line_no", "area", "property_type", F.when(F.col("line_no") <= 5, F.col("bedrooms")).alias("bedrooms"), "deal_type", "price")


@query("benchmark_gate", f"""WITH {TX}, {BENCH}, {_ASK}, g AS (SELECT area, property_type, CASE WHEN bedrooms < 3 THEN bedrooms END AS bedrooms, deal_type, quantile_cont(price, 0.5) AS median, count(*) AS n FROM tx GROUP BY ALL HAVING count(*) >= 5),
j AS (SELECT a.*, coalesce(e.median, x.median) AS m FROM ask a LEFT JOIN g e ON a.area = e.area AND a.property_type = e.property_type AND a.bedrooms = e.bedrooms AND a.deal_type = e.deal_type
  LEFT JOIN g x ON a.area = x.area AND a.property_type = x.property_type AND x.bedrooms IS NULL AND a.deal_type = x.deal_type)
SELECT order_id, line_no, price, CASE WHEN abs(price - m) / m > 0.4 THEN 'price_off_median_' || CAST(trunc(abs(price - m) / m * 100) AS BIGINT) || 'pct' END AS bench_reason FROM j""")
def q_benchmark_gate(spark, d):
    tx = transactions(spark, d).withColumn("bedrooms", F.when(F.col("bedrooms") < 3, F.col("bedrooms")))
    return bm.benchmark_gate(_ask(spark, d), bm.area_price_benchmark(tx)).select("order_id", "line_no", "price", "bench_reason")


@query("tier_median_gate", f"""WITH {LISTINGS}, m AS (SELECT area, property_type, bedrooms, deal_type, quantile_cont(price, 0.5) AS med, count(*) AS n FROM listings WHERE status <> 'P' GROUP BY ALL HAVING count(*) >= 4)
SELECT id, CASE WHEN abs(price - med) / med > 0.2 THEN 'tier_median_' || CAST(trunc(abs(price - med) / med * 100) AS BIGINT) || 'pct_' || CASE WHEN price > med THEN 'above' ELSE 'below' END
  || '_median_' || CAST(trunc(med / 1000) AS BIGINT) || 'k_n' || n END AS tier_reason FROM listings l LEFT JOIN m ON l.area = m.area AND l.property_type = m.property_type AND l.bedrooms = m.bedrooms AND l.deal_type = m.deal_type""")
def q_tier_median_gate(spark, d):
    l = listings(spark, d)
    return bm.tier_median_gate(l, l.filter(F.col("status") != "P")).select("id", "tier_reason")


@query("profile_gate", f"""WITH {TX}, p AS (SELECT area, property_type, count(*) AS n FROM tx WHERE deal_type = 'sale' GROUP BY ALL), t AS (SELECT area, sum(n) AS total FROM p GROUP BY 1),
s AS (SELECT p.area, property_type, round_even(n / total * 100.0::DOUBLE, 2) AS share, total FROM p JOIN t ON p.area = t.area WHERE total >= 20), {LISTINGS},
l AS (SELECT id, area, CASE WHEN bedrooms < 3 THEN 'small' ELSE property_type END AS property_type FROM listings), k AS (SELECT area, max(total) AS total FROM s GROUP BY 1)
SELECT id, CASE WHEN k.total >= 20 AND l.property_type IN ('small', 'machinery') THEN CASE WHEN share IS NULL THEN 'property_type_rare_for_area_0pct' WHEN share < 5
  THEN 'property_type_rare_for_area_' || printf('%.1f', share) || 'pct' END END AS profile_reason FROM l LEFT JOIN k ON l.area = k.area LEFT JOIN s ON s.area = l.area AND s.property_type = l.property_type""")
def q_profile_gate(spark, d):
    from gavel.operators.aggregates import share_of_total

    tx = transactions(spark, d).filter(F.col("deal_type") == "sale")
    l = listings(spark, d).select("id", "area", F.when(F.col("bedrooms") < 3, "small").otherwise(F.col("property_type")).alias("property_type"))
    return bm.profile_gate(l, share_of_total(tx, "area", "property_type"), ["small", "machinery"]).select("id", "profile_reason")


_PT = """CASE property_type WHEN 'building' THEN 'apartment' WHEN 'machinery' THEN 'villa' WHEN 'household' THEN 'studio' WHEN 'furniture' THEN 'penthouse' ELSE 'office' END"""


def advert_type(c="property_type"):
    c = F.col(c)
    return F.when(c == "building", "apartment").when(c == "machinery", "villa").when(c == "household", "studio").when(c == "furniture", "penthouse").otherwise("office")


@query("listing_rules", f"""WITH {LISTINGS}, l AS (SELECT id, CASE WHEN bedrooms = 5 THEN building || ' Sea View' WHEN bedrooms = 4 THEN building || ' 12345' ELSE building END AS building, area, deal_type, {_PT} AS property_type, bedrooms,
  size_sqft * 0.9::DOUBLE AS size_sqft, price * CASE WHEN deal_type = 'sale' THEN 4 ELSE 1 END AS price, lower('Great ' || CASE WHEN bedrooms = 1 THEN '2 br villa ' ELSE '' END || 'in ' || building) AS text FROM listings),
r AS (SELECT id, list_filter([
  CASE WHEN length(building) > 60 THEN 'building_too_long' END, CASE WHEN building LIKE '%View%' THEN 'building_descriptor' END, CASE WHEN building LIKE '%12345%' THEN 'building_has_digits' END,
  CASE WHEN property_type <> 'office' AND deal_type = 'rent' AND price < 15000 THEN 'rent_absurd_low_' || CAST(trunc(price) AS BIGINT) END,
  CASE WHEN property_type <> 'office' AND deal_type = 'sale' AND price < 350000 THEN 'sale_absurd_low_' || CAST(trunc(price) AS BIGINT) END,
  CASE WHEN property_type <> 'office' AND deal_type = 'rent' AND bedrooms > 0 AND price < 0.5::DOUBLE * CASE bedrooms WHEN 1 THEN 40000 WHEN 2 THEN 60000 WHEN 3 THEN 90000 WHEN 4 THEN 120000 ELSE 30000 END THEN 'rent_too_low_' || CAST(trunc(price) AS BIGINT) END,
  CASE WHEN property_type <> 'office' AND deal_type = 'sale' AND bedrooms > 0 AND price < 0.55::DOUBLE * CASE bedrooms WHEN 1 THEN 500000 WHEN 2 THEN 900000 WHEN 3 THEN 1500000 WHEN 4 THEN 2500000 ELSE 350000 END THEN 'sale_too_low_' || CAST(trunc(price) AS BIGINT) END,
  CASE WHEN property_type = 'villa' AND deal_type = 'sale' AND lower(area) LIKE '%nation\\_2%' ESCAPE '\\' AND price < 5000000 THEN 'sale_psf_absurd_premium_villa_' || CAST(trunc(price) AS BIGINT) END,
  CASE WHEN property_type <> 'office' AND deal_type = 'rent' AND size_sqft > 200 AND price / size_sqft < 8 THEN 'rent_psf_absurd_' || CAST(trunc(price / size_sqft) AS BIGINT) END,
  CASE WHEN property_type <> 'office' AND deal_type = 'sale' AND size_sqft > 200 AND price / size_sqft < 150 THEN 'sale_psf_absurd_' || CAST(trunc(price / size_sqft) AS BIGINT) END,
  CASE WHEN size_sqft > 0 AND bedrooms > 0 AND size_sqft < bedrooms * 200 THEN 'sqft_too_small_' || CAST(trunc(size_sqft) AS BIGINT) END,
  CASE WHEN property_type = 'studio' AND bedrooms = 1 THEN 'studio_with_NBR' END,
  CASE WHEN property_type = 'villa' AND bedrooms <> 1 AND size_sqft > 0 AND size_sqft < 2000 THEN 'villa_no_word' END,
  CASE WHEN property_type = 'penthouse' AND NOT coalesce(bedrooms >= 3 AND size_sqft > 2000, FALSE) THEN 'penthouse_no_word' END], lambda x: x IS NOT NULL) AS v FROM l)
SELECT id, array_to_string(v, ';') AS violations FROM r""")
def q_listing_rules(spark, d):
    l = listings(spark, d)
    b = F.col("building")
    rows = l.select(
        "id", F.when(F.col("bedrooms") == 5, F.concat(b, F.lit(" Sea View"))).when(F.col("bedrooms") == 4, F.concat(b, F.lit(" 12345"))).otherwise(b).alias("building"), "area", "deal_type",
        advert_type().alias("property_type"), "bedrooms", (F.col("size_sqft") * 0.9).alias("size_sqft"), (F.col("price") * F.when(F.col("deal_type") == "sale", 4).otherwise(1)).alias("price"),
        F.concat(F.lit("Great "), F.when(F.col("bedrooms") == 1, "2 br villa ").otherwise(""), F.lit("in "), b).alias("text"))
    return rows.select("id", F.array_join(bm.listing_rules(rows, ["nation_2"]), ";").alias("violations"))


@query("price_imputation", f"""WITH {TX}, {LISTINGS}, c AS (SELECT area AS b, CASE WHEN bedrooms = 0 THEN 'Studio' ELSE bedrooms || ' B/R' END AS r, price, price / (price / size_sqft) * 10.7639::DOUBLE AS sqft FROM tx WHERE deal_date > DATE '2001-08-01' - INTERVAL 400 DAYS),
m AS (SELECT lower(b) AS b, r, quantile_cont(price, 0.5) AS pm, quantile_cont(sqft, 0.5) AS sm, count(*) AS n FROM c WHERE sqft BETWEEN 100 AND 20000 GROUP BY ALL HAVING count(*) >= 5),
l AS (SELECT id, area AS building, bedrooms, CASE WHEN deal_quality IS NOT NULL THEN CAST(trunc(price) AS BIGINT) END AS price, size_sqft FROM listings)
SELECT id, coalesce(price, CAST(round_even(pm * 0.95::DOUBLE, 0) AS BIGINT)) AS price, coalesce(size_sqft, round_even(sm, 1)) AS size_sqft, (price IS NULL OR size_sqft IS NULL) AND n IS NOT NULL AS was_filled
FROM l LEFT JOIN m ON lower(building) = b AND CASE WHEN bedrooms = 0 THEN 'Studio' ELSE bedrooms || ' B/R' END = r""")
def q_price_imputation(spark, d):
    tx = transactions(spark, d).select(
        F.col("area").alias("building"), F.when(F.col("bedrooms") == 0, "Studio").otherwise(F.concat(F.col("bedrooms").cast("string"), F.lit(" B/R"))).alias("rooms"),
        "price", (F.col("price") / F.col("size_sqft")).alias("price_per_sqm"), "deal_date")
    l = listings(spark, d).select("id", F.col("area").alias("building"), "bedrooms", F.when(F.col("deal_quality").isNotNull(), F.col("price").cast("bigint")).alias("price"), "size_sqft")
    return bm.price_imputation(l, tx, AS_OF, 400).select("id", "price", "size_sqft", "was_filled")


_MEDIANS = """med AS (SELECT building, quantile_cont(price, 0.5) FILTER (WHERE deal_type = 'sale') * 20 AS sale_median, count(*) FILTER (WHERE deal_type = 'sale') AS sale_count,
  quantile_cont(price, 0.5) FILTER (WHERE deal_type = 'rent') AS rent_median, count(*) FILTER (WHERE deal_type = 'rent') AS rent_count FROM tx GROUP BY building)"""


def medians(spark, d):
    """Sale and rent medians per building, sale prices lifted to a sale-like scale."""
    tx = transactions(spark, d)
    med = group_percentiles(tx, ["building", "deal_type"], "price", {"m": 0.5})
    return med.groupBy("building").agg(
        F.max(F.when(F.col("deal_type") == "sale", F.col("m") * 20)).alias("sale_median"), F.coalesce(F.max(F.when(F.col("deal_type") == "sale", F.col("n"))), F.lit(0)).alias("sale_count"),
        F.max(F.when(F.col("deal_type") == "rent", F.col("m"))).alias("rent_median"), F.coalesce(F.max(F.when(F.col("deal_type") == "rent", F.col("n"))), F.lit(0)).alias("rent_count"))


_VERDICT = """v AS (SELECT t.*, CASE WHEN sale_count >= 5 THEN nullif(sale_median, 0) END AS sm, nullif(rent_median, 0) AS rm, sale_median, rent_median, sale_count, rent_count FROM (SELECT *, price * CASE WHEN bedrooms > 2 THEN 20 WHEN bedrooms = 2 THEN 7 ELSE 1 END AS ask FROM tx) t LEFT JOIN med USING (building)),
w AS (SELECT *, abs(ask - sm) / sm AS ds, abs(ask - rm) / rm AS dr FROM v),
x AS (SELECT *, CASE WHEN sm IS NOT NULL AND rm IS NOT NULL THEN CASE WHEN dr < 0.6 AND ds > 0.7 THEN 'rent' WHEN ds < 0.6 AND dr > 5 THEN 'sale' END
  WHEN sm IS NOT NULL THEN CASE WHEN ds < 0.6 THEN 'sale' WHEN ask < sm * 0.05::DOUBLE AND ask < 500000 THEN 'rent' WHEN ask < sm * 0.15::DOUBLE AND ask < 800000 THEN 'rent' END
  WHEN rm IS NOT NULL THEN CASE WHEN dr < 0.6 THEN 'rent' WHEN ask > rm * 10 AND ask > 500000 THEN 'sale' END END AS verdict FROM w)"""


@query("deal_type_by_benchmark", f"""WITH {TX}, {_MEDIANS}, {_VERDICT}
SELECT order_id, line_no, building, verdict, CASE WHEN verdict IS NULL THEN NULL WHEN sm IS NOT NULL AND rm IS NOT NULL THEN 0.85 WHEN sm IS NOT NULL THEN CASE WHEN ds < 0.6 THEN 0.75 WHEN ask < sm * 0.05::DOUBLE THEN 0.8 ELSE 0.65 END ELSE 0.75 END::DOUBLE AS confidence FROM x""")
def q_deal_type_by_benchmark(spark, d):
    ask = F.col("price") * F.when(F.col("bedrooms") > 2, 20).when(F.col("bedrooms") == 2, 7).otherwise(1)
    j = transactions(spark, d).join(medians(spark, d), "building", "left")
    v = bm.deal_type_by_benchmark(ask, F.col("sale_median"), F.col("sale_count"), F.col("rent_median"))
    return j.select("order_id", "line_no", "building", v["verdict"].alias("verdict"), v["confidence"].alias("confidence"))


@query("deal_quality", f"""WITH {TX}, {_MEDIANS}, i AS (SELECT order_id, line_no, price * 20 AS price, CASE WHEN line_no > 2 THEN price * (20 + bedrooms) END AS original_price, size_sqft * 12 AS size_sqft, bedrooms, deal_type,
  sale_median, sale_count, rent_median, rent_count, CASE WHEN bedrooms <> 3 THEN 1500 END AS mkt_sqft, CASE WHEN bedrooms <> 3 THEN 70000 END AS mkt_rent, CASE WHEN bedrooms <> 3 THEN 4 + bedrooms END AS mkt_growth
  FROM (SELECT * FROM tx WHERE deal_date >= DATE '2001-01-01') t LEFT JOIN med USING (building)),
a AS (SELECT *, CASE WHEN original_price > price THEN round_even((original_price - price) / original_price * 100.0::DOUBLE, 1) END AS disc,
  CASE WHEN deal_type = 'sale' AND sale_median > 0 AND sale_count >= 5 THEN round_even((price - sale_median) / sale_median * 100.0::DOUBLE, 1) END AS vb0, floor(size_sqft * coalesce(mkt_sqft, 1300)) AS val,
  CASE WHEN rent_median > 0 AND rent_count >= 3 THEN trunc(rent_median) ELSE trunc(coalesce(mkt_rent, 80000) * CASE WHEN bedrooms >= 4 THEN 3.0 WHEN bedrooms = 3 THEN 2.2 WHEN bedrooms = 2 THEN 1.6 ELSE 1.0 END::DOUBLE) END AS rent FROM i),
b AS (SELECT *, CASE WHEN vb0 BETWEEN -90 AND 500 THEN vb0 END AS vb FROM a),
c AS (SELECT *, CASE WHEN vb IS NULL AND val > 0 THEN round_even((price - val) / val * 100.0::DOUBLE, 1) END AS va, round_even(rent / price * 100.0::DOUBLE, 1) AS roi FROM b),
e AS (SELECT *, coalesce(vb <= -15, FALSE) OR coalesce(va <= -12, FALSE) AS strong, coalesce(vb <= -8, FALSE) OR coalesce(va <= -7, FALSE) AS mild FROM c)
SELECT order_id, line_no, disc AS discount_percent, CASE WHEN disc >= 12 THEN 'very_good' WHEN disc >= 7 THEN 'good' WHEN disc >= 3 THEN 'interesting' WHEN strong THEN 'very_good' WHEN mild THEN 'good' ELSE 'normal' END AS deal_quality,
  coalesce(disc >= 7, FALSE) OR strong AS is_hot_deal, strong OR mild AS is_below_market, coalesce(vb, va) AS price_vs_market_percent, CASE WHEN vb IS NOT NULL THEN 'building' WHEN va IS NOT NULL THEN 'district' END AS benchmark_source, roi AS roi_estimate,
  CAST(trunc(rent * 1.15::DOUBLE) AS BIGINT) AS short_let_low, CAST(trunc(rent * 1.35::DOUBLE) AS BIGINT) AS short_let_high,
  least(round_even(5.0::DOUBLE + CASE WHEN roi >= 8 THEN 2 WHEN roi >= 6 THEN 1 ELSE 0 END + CASE WHEN coalesce(mkt_growth, 4) >= 7 THEN 1.5 WHEN coalesce(mkt_growth, 4) >= 5 THEN 0.5 ELSE 0 END
    + CASE WHEN strong OR mild THEN 1 ELSE 0 END + CASE WHEN coalesce(disc >= 7, FALSE) OR strong THEN 0.5 ELSE 0 END, 1), 10.0::DOUBLE) AS quality_score FROM e""")
def q_deal_quality(spark, d):
    t = transactions(spark, d).filter(F.col("deal_date") >= F.lit("2001-01-01").cast("date"))
    br = F.col("bedrooms")
    i = t.join(medians(spark, d), "building", "left").select(
        "order_id", "line_no", (F.col("price") * 20).alias("price"), F.when(F.col("line_no") > 2, F.col("price") * (20 + br)).alias("original_price"), (F.col("size_sqft") * 12).alias("size_sqft"), "bedrooms", "deal_type",
        "sale_median", "sale_count", "rent_median", "rent_count", F.when(br != 3, 1500).alias("mkt_sqft"), F.when(br != 3, 70000).alias("mkt_rent_1br"), F.when(br != 3, 4 + br).alias("mkt_growth"))
    return bm.deal_quality(i).select(
        "order_id", "line_no", "discount_percent", "deal_quality", "is_hot_deal", "is_below_market", "price_vs_market_percent", "benchmark_source", "roi_estimate", "short_let_low", "short_let_high", "quality_score")


@query("confidence", f"""WITH {LISTINGS}, s AS (SELECT id, CASE WHEN status <> 'P' THEN 'E' END AS emirate, CASE WHEN bedrooms <> 1 THEN area END AS area, CASE WHEN deal_quality IS NOT NULL THEN building END AS building, CASE WHEN bedrooms < 5 THEN price END AS price, NULLIF(bedrooms, 4) AS bedrooms, size_sqft, confidence_score * 0.9137::DOUBLE AS c FROM listings),
r AS (SELECT id, emirate, area, price, round_even(least(CASE WHEN emirate IS NOT NULL THEN c * 0.25::DOUBLE ELSE 0 END + CASE WHEN area IS NOT NULL THEN c * 0.3::DOUBLE ELSE 0 END + CASE WHEN building IS NOT NULL THEN c * 0.25::DOUBLE ELSE 0.05::DOUBLE END
  + CASE WHEN price > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN bedrooms IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN size_sqft > 0 THEN 0.05::DOUBLE ELSE 0 END, 1.0::DOUBLE), 2) AS confidence FROM s)
SELECT id, confidence, confidence < 0.7 OR emirate IS NULL OR area IS NULL OR price IS NULL AS needs_review,
  nullif(concat_ws('; ', CASE WHEN emirate IS NULL THEN 'emirate not detected' END, CASE WHEN area IS NULL THEN 'area not detected' END, CASE WHEN price IS NULL THEN 'price not found' END), '') AS review_reason FROM r""")
def q_confidence(spark, d):
    l = listings(spark, d)
    c = F.col("confidence_score") * 0.9137
    rows = l.select(
        "id", F.when(F.col("status") != "P", "E").alias("emirate"), F.when(F.col("bedrooms") != 1, F.col("area")).alias("area"), F.when(F.col("deal_quality").isNotNull(), F.col("building")).alias("building"),
        F.when(F.col("bedrooms") < 5, F.col("price")).alias("price"), F.nullif("bedrooms", F.lit(4)).alias("bedrooms"), "size_sqft", c.alias("emirate_confidence"), c.alias("area_confidence"), c.alias("building_confidence"))
    return bm.confidence(rows).select("id", "confidence", "needs_review", "review_reason")


_FLIP_TEXT = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Nice home, for rent yearly' WHEN '2-HIGH' THEN 'Flat for sale | rented, payment plan' WHEN '3-MEDIUM' THEN 'Cash buyer, budget up to 2M' WHEN '5-LOW' THEN 'сдам квартиру' ELSE 'home' END"""


@query("deal_type_flip", f"""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'rent' ELSE 'sale' END AS dt, o_totalprice * CASE WHEN o_orderstatus = 'P' THEN 15 WHEN o_orderstatus = 'F' THEN 30 ELSE 1 END AS price, o_orderpriority AS p FROM orders),
w AS (SELECT *, CASE p WHEN '1-URGENT' THEN 'rent' WHEN '2-HIGH' THEN 'sale' WHEN '5-LOW' THEN 'rent' ELSE dt END AS worded FROM a)
SELECT id, CASE WHEN p = '3-MEDIUM' THEN 'sale' WHEN worded = 'sale' AND price < 500000 AND (p <> '2-HIGH' OR price < 200000) THEN 'rent' WHEN worded = 'rent' AND price > 50000000 THEN 'sale'
  WHEN price < 200000 THEN 'rent' WHEN price > 6000000 THEN 'sale' ELSE worded END AS deal_type FROM w""")
def q_deal_type_flip(spark, d):
    o = load_table(spark, d, "orders")
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", "Nice home, for rent yearly").when(p == "2-HIGH", "Flat for sale | rented, payment plan").when(p == "3-MEDIUM", "Cash buyer, budget up to 2M")
        .when(p == "5-LOW", "сдам квартиру").otherwise("home"))
    price = F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "P", 15).when(F.col("o_orderstatus") == "F", 30).otherwise(1)
    deal = F.when(F.col("o_orderstatus") == "F", "rent").otherwise("sale")
    return o.select(F.col("o_orderkey").alias("id"), bm.deal_type_flip(deal, price, text).alias("deal_type"))


@query("majority_inference", f"""WITH {TX}, {LISTINGS}, l AS (SELECT id, CASE WHEN deal_type = 'rent' THEN 'small ring' WHEN bedrooms = 5 THEN 'unknown ' || property_type ELSE building END AS building, CASE WHEN deal_quality IS NOT NULL AND deal_type = 'sale' THEN area END AS area FROM listings),
reg AS (SELECT b, area FROM (SELECT lower(building) AS b, area, row_number() OVER (PARTITION BY lower(building) ORDER BY count(*) DESC, area) AS rn FROM tx GROUP BY lower(building), area) WHERE rn = 1),
own AS (SELECT b, area FROM (SELECT lower(building) AS b, area, count(*) AS n, row_number() OVER (PARTITION BY lower(building) ORDER BY count(*) DESC, area) AS rn FROM l WHERE area IS NOT NULL GROUP BY lower(building), area) WHERE rn = 1 AND n >= 5)
SELECT id, coalesce(l.area, reg.area, own.area) AS area, CASE WHEN l.area IS NOT NULL THEN 'given' WHEN reg.area IS NOT NULL THEN 'registry' WHEN own.area IS NOT NULL THEN 'own_majority' END AS area_source
FROM l LEFT JOIN reg ON lower(l.building) = reg.b LEFT JOIN own ON lower(l.building) = own.b""")
def q_majority(spark, d):
    l = listings(spark, d).select(
        "id", F.when(F.col("deal_type") == "rent", "small ring").when(F.col("bedrooms") == 5, F.concat(F.lit("unknown "), "property_type")).otherwise(F.col("building")).alias("building"),
        F.when(F.col("deal_quality").isNotNull() & (F.col("deal_type") == "sale"), F.col("area")).alias("area"))
    return bm.majority_inference(l, transactions(spark, d)).select("id", "area", "area_source")


@query("canonicalise_entities", """WITH l AS (SELECT p_partkey AS id, CASE WHEN p_size < 15 THEN ' ' || upper(p_name) WHEN p_size < 30 THEN p_name || ' Tower A' WHEN p_size < 40 THEN 'Nowhere' END AS building,
  CASE WHEN p_type = 'SMALL' THEN lower(p_brand) WHEN p_type = 'PROMO' THEN 'AFRICA phase 2' WHEN p_type = 'LARGE' THEN ' Old town ' END AS area FROM part),
b AS (SELECT lower(p_name) AS k, initcap_name AS name, area FROM (SELECT p_name, upper(left(p_name, 1)) || substr(p_name, 2) AS initcap_name, CASE WHEN count(*) > 3 THEN min(p_brand) END AS area FROM part GROUP BY p_name)),
a AS (SELECT lower(p_brand) AS k, p_brand AS name FROM part GROUP BY p_brand UNION ALL SELECT lower(r_name), r_name FROM region),
j AS (SELECT l.*, lower(trim(building)) AS k1, trim(regexp_replace(lower(trim(building)), '\\s+(tower\\s+)?[abcivx\\d]+$', '')) AS k2, lower(trim(l.area)) AS a1, trim(regexp_replace(lower(trim(l.area)), '\\s*(phase\\s*)?\\d+\\s*$', '')) AS a2 FROM l)
SELECT id, CASE WHEN b1.k IS NOT NULL THEN b1.name WHEN b2.k IS NOT NULL THEN b2.name ELSE trim(building) END AS canon_building,
  coalesce(CASE WHEN b1.k IS NOT NULL THEN b1.area ELSE b2.area END, x1.name, x2.name, trim(j.area)) AS canon_area
FROM j LEFT JOIN b b1 ON k1 = b1.k LEFT JOIN b b2 ON k2 = b2.k LEFT JOIN a x1 ON a1 = x1.k LEFT JOIN a x2 ON a2 = x2.k""")
def q_canonicalise(spark, d):
    p = load_table(spark, d, "part")
    l = p.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") < 15, F.concat(F.lit(" "), F.upper("p_name"))).when(F.col("p_size") < 30, F.concat("p_name", F.lit(" Tower A"))).when(F.col("p_size") < 40, "Nowhere").alias("building"),
        F.when(F.col("p_type") == "SMALL", F.lower("p_brand")).when(F.col("p_type") == "PROMO", "AFRICA phase 2").when(F.col("p_type") == "LARGE", " Old town ").alias("area"))
    b = p.groupBy("p_name").agg(F.when(F.count(F.lit(1)) > 3, F.min("p_brand")).alias("area")).select(
        F.lower("p_name").alias("key"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100)).alias("name"), "area")
    a = p.select("p_brand").distinct().select(F.lower("p_brand").alias("key"), F.col("p_brand").alias("name")).unionByName(
        load_table(spark, d, "region").select(F.lower("r_name").alias("key"), F.col("r_name").alias("name")))
    return bm.canonicalise_entities(l, b, a).select("id", "canon_building", "canon_area")
