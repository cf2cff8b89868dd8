"""Scores, rankings, picks and the flagship query."""

from pyspark.sql import functions as F

from gavel.operators import aggregates as ag
from gavel.operators import benchmarks as bm
from gavel.operators import filters as fl
from gavel.operators import scores as sc
from gavel.operators.joins import latest_asof
from gavel.plans.q_d_aggregates import _MONTHLY, monthly_stats
from gavel.plans.q_f_benchmarks import BENCH
from gavel.plans.registry import query
from gavel.plans.roles import AS_OF, INTERACTIONS, LISTINGS, TX, interactions, listings, transactions
from gavel.sources.tables import load_table, ts


def _sales(spark, d):
    return transactions(spark, d).filter(F.col("deal_type") == "sale").withColumn("psf", F.col("price") / F.col("size_sqft"))


_RESALE = """m AS (SELECT area, avg(price / size_sqft) FILTER (WHERE deal_date >= DATE '2001-05-01') AS now, avg(price / size_sqft) FILTER (WHERE deal_date >= DATE '2000-05-01' AND deal_date < DATE '2000-08-01') AS old,
  count(*) FILTER (WHERE deal_date >= DATE '2000-08-01') AS v12, count(*) FILTER (WHERE deal_date >= DATE '2001-05-01') AS v3 FROM tx WHERE deal_type = 'sale' GROUP BY area HAVING count(*) FILTER (WHERE deal_date >= DATE '2000-08-01') >= 30),
s AS (SELECT area, v12, round_even((now - old) / old * 100.0::DOUBLE, 2) AS g, round_even(now, 2) AS psf, round_even(v3 / v12 * 100.0::DOUBLE, 2) AS liq FROM m),
x AS (SELECT greatest(max(g), 10.0) AS mg, greatest(max(v12), 1) AS mv, greatest(max(liq), 1.0) AS ml FROM s),
r AS (SELECT area, v12 AS deal_volume_12mo, g AS price_growth_12mo_pct, psf AS avg_psf, liq AS liquidity_score,
  round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce(g, 0) / mg * 100.0::DOUBLE)) * 0.4::DOUBLE + v12 / mv * 100.0::DOUBLE * 0.3::DOUBLE + coalesce(liq, 0) / ml * 100.0::DOUBLE * 0.3::DOUBLE, 2) AS score FROM s, x)"""


@query("rank_areas_resale", f"""WITH {TX}, {_RESALE} SELECT *, CAST(row_number() OVER (ORDER BY score DESC, area) AS INT) AS rank FROM r""")
def q_rank_resale(spark, d):
    return sc.rank_areas_resale(_sales(spark, d), AS_OF)


@query("rank_areas_rental", f"""WITH {TX}, m AS (SELECT area, avg(price) FILTER (WHERE deal_type = 'rent' AND deal_date >= DATE '2000-08-01') AS now, avg(price) FILTER (WHERE deal_type = 'rent' AND deal_date >= DATE '1999-08-01' AND deal_date < DATE '2000-08-01') AS old,
  count(*) FILTER (WHERE deal_type = 'rent' AND deal_date >= DATE '2000-08-01') AS v12, count(*) FILTER (WHERE deal_type = 'rent' AND deal_date >= DATE '2001-05-01') AS v3, avg(price) FILTER (WHERE deal_type = 'sale' AND deal_date >= DATE '2000-08-01') AS sp FROM tx GROUP BY area),
s AS (SELECT area, v12, round_even(now / sp * 100.0::DOUBLE, 2) AS y, round_even(now, 0) AS rent, round_even(v3 / v12 * 100.0::DOUBLE, 2) AS vac, CASE WHEN old > 0 THEN round_even((now - old) / old * 100.0::DOUBLE, 2) END AS g FROM m WHERE v12 >= 30 AND sp > 0),
x AS (SELECT greatest(max(y), 3.0) AS my, greatest(max(vac), 1.0) AS mv, greatest(max(g), 5.0) AS mg FROM s),
r AS (SELECT area, v12 AS deal_volume_12mo, y AS rental_yield_pct, rent AS avg_rent_annual, vac AS vacancy_score, g AS rent_growth_pct,
  round_even(y / my * 100.0::DOUBLE * 0.6::DOUBLE + vac / mv * 100.0::DOUBLE * 0.2::DOUBLE + greatest(0, coalesce(g, 0)) / mg * 100.0::DOUBLE * 0.2::DOUBLE, 2) AS score FROM s, x)
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, area) AS INT) AS rank FROM r""")
def q_rank_rental(spark, d):
    return sc.rank_areas_rental(transactions(spark, d), AS_OF)


_LIVING = """cur AS (SELECT n_name AS area, count(*) % 11 AS schools, CAST(max(c_acctbal) AS BIGINT) % 11 AS safety, CAST(min(c_acctbal) + 1000 AS BIGINT) % 11 AS amenities, CAST(sum(c_custkey) AS BIGINT) % 11 AS family, CAST(max(c_custkey) AS BIGINT) % 11 AS walk
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)"""


def curated(spark, d):
    """Customer statistics per nation stand in for the curated 0–10 lifestyle scores."""
    c, n = load_table(spark, d, "customer"), load_table(spark, d, "nation")
    m = lambda e: F.pmod(e.cast("bigint"), F.lit(11))
    whole = lambda c: F.rint(c).cast("bigint")  # noqa: E731  (SQL casts to the even neighbour)
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("area")).agg(
        m(F.count(F.lit(1))).alias("schools"), m(whole(F.max("c_acctbal"))).alias("safety"), m(whole(F.min("c_acctbal") + 1000)).alias("amenities"), m(F.sum("c_custkey")).alias("family"), m(F.max("c_custkey")).alias("walk"))


@query("rank_areas_living", f"""WITH {TX}, {_LIVING}, q AS (SELECT area, date_trunc('quarter', deal_date) AS q, avg(price / size_sqft) AS v FROM tx WHERE deal_type = 'sale' AND deal_date >= DATE '1999-08-01' GROUP BY ALL),
st AS (SELECT area, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - stddev_pop(v) / avg(v) * 100.0::DOUBLE)), 2) AS st FROM q WHERE v > 0 GROUP BY area HAVING count(*) >= 3),
r AS (SELECT cur.area, round_even(schools * 10 * 0.25::DOUBLE + safety * 10 * 0.2::DOUBLE + amenities * 10 * 0.15::DOUBLE + family * 10 * 0.2::DOUBLE + walk * 10 * 0.1::DOUBLE + coalesce(st, 0) * 0.1::DOUBLE, 2) AS score FROM cur LEFT JOIN st ON cur.area = st.area)
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, area) AS INT) AS rank FROM r""")
def q_rank_living(spark, d):
    return sc.rank_areas_living(curated(spark, d), _sales(spark, d), AS_OF).select("area", "score", "rank")


@query("area_topn", f"""WITH {TX}, {_RESALE} SELECT area, score, CAST(row_number() OVER (ORDER BY score DESC, area) AS INT) AS rank FROM r ORDER BY rank LIMIT 3""")
def q_area_topn(spark, d):
    return sc.area_topn(sc.rank_areas_resale(_sales(spark, d), AS_OF), 3).select("area", "score", "rank")


@query("investment_metrics", f"""WITH {LISTINGS}, a AS (SELECT area, avg(price / size_sqft) AS mkt_sqft FROM listings WHERE deal_type = 'sale' GROUP BY area),
i AS (SELECT id, CASE WHEN bedrooms = 4 AND deal_type = 'sale' THEN 0 ELSE price END AS price, coalesce(size_sqft, 0) AS size_sqft, bedrooms, deal_type, l.area, CASE WHEN deal_quality IS NOT NULL THEN building END AS building, CASE WHEN deal_quality <> 'good' THEN a.mkt_sqft END AS mkt_sqft,
  CASE WHEN bedrooms <> 2 THEN 15000.0::DOUBLE END AS rent1, CASE WHEN bedrooms <> 3 THEN bedrooms * 4.0::DOUBLE END AS growth, CASE WHEN is_hot_deal THEN 180.0::DOUBLE END AS bld FROM listings l LEFT JOIN a ON l.area = a.area),
j AS (SELECT *, deal_type = 'sale' AS is_sale, deal_type = 'rent' AND price > 10000 AS is_rent, CASE WHEN price > 0 AND size_sqft > 100 THEN price / size_sqft END AS psf, greatest(1.0, least(20.0, coalesce(growth, 6.0)))::DOUBLE AS g FROM i),
k AS (SELECT *, round_even((psf - mkt_sqft) / mkt_sqft * 100.0::DOUBLE, 1) AS vs, CASE WHEN size_sqft > 0 THEN coalesce(bld, mkt_sqft, 1500.0::DOUBLE) * size_sqft ELSE price * 12 END AS est,
  CASE WHEN is_rent THEN trunc(price) WHEN is_sale THEN trunc(coalesce(rent1, 80000.0::DOUBLE) * CASE bedrooms WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 WHEN 2 THEN 1.6 WHEN 3 THEN 2.3 WHEN 4 THEN 3.0 WHEN 5 THEN 4.0 ELSE 2.0 END::DOUBLE) ELSE trunc(price * 7.0::DOUBLE / 100) END AS yearly FROM j),
l2 AS (SELECT *, greatest(0.0::DOUBLE, least(25.0::DOUBLE, CASE WHEN is_rent OR is_sale THEN round_even(CASE WHEN is_rent THEN price / est * 100.0::DOUBLE WHEN price > 0 THEN yearly / price * 100.0::DOUBLE ELSE 7.0 END, 1) ELSE 7.0 END)) AS roi,
  CASE WHEN is_rent THEN bld IS NULL AND mkt_sqft IS NULL WHEN is_sale THEN rent1 IS NULL OR price = 0 ELSE TRUE END OR growth IS NULL AS defaults, pow(1 + g / 100, 5) AS five,
  CASE WHEN is_rent AND bld IS NOT NULL THEN 'registry' WHEN mkt_sqft IS NOT NULL AND (psf IS NOT NULL OR is_sale) THEN 'market' ELSE 'estimated' END AS src FROM k),
m AS (SELECT *, CASE WHEN is_sale AND price > 0 THEN round_even((five - 1) * 100.0::DOUBLE, 1) ELSE 0 END AS gain5,
  greatest(1, least(10, 5 - CASE WHEN lower(area) LIKE '%nation\\_1%' ESCAPE '\\' THEN 2 ELSE 0 END + CASE WHEN building IS NULL THEN 1 ELSE 0 END + CASE WHEN vs > 40 THEN 1 ELSE 0 END + CASE WHEN mkt_sqft IS NULL THEN 1 ELSE 0 END + CASE WHEN price = 0 THEN 2 ELSE 0 END
   + CASE WHEN size_sqft = 0 THEN 1 ELSE 0 END - CASE WHEN src = 'registry' THEN 1 ELSE 0 END + CASE WHEN defaults THEN 1 ELSE 0 END)) AS risk FROM l2), n AS (SELECT *, round_even(gain5 + roi * 5, 1) AS total5 FROM m)
SELECT id, roi, CAST(yearly AS BIGINT) AS yearly_rent, CASE WHEN roi > 0 THEN round_even(100.0::DOUBLE / roi, 1) ELSE 99.0 END AS payback_years, CASE WHEN is_sale AND price > 0 THEN CAST(trunc(price * five) AS BIGINT) ELSE 0 END AS value_in_5y, total5 AS total_return_5y_pct, risk AS risk_score, src AS data_source, vs AS psf_vs_market_pct,
  CASE WHEN is_sale AND total5 >= 70 AND risk <= 4 AND NOT defaults THEN 'STRONG_BUY' WHEN is_sale AND total5 >= 50 AND risk <= 6 THEN 'BUY' WHEN is_sale AND total5 >= 30 AND risk <= 7 THEN 'HOLD' WHEN is_sale THEN 'AVOID'
    WHEN roi >= 8 AND risk <= 5 AND NOT defaults THEN 'STRONG_BUY' WHEN roi >= 6 THEN 'BUY' WHEN roi >= 4 THEN 'HOLD' ELSE 'AVOID' END AS recommendation FROM n""")
def q_investment_metrics(spark, d):
    l = listings(spark, d)
    a = l.filter(F.col("deal_type") == "sale").groupBy("area").agg(F.avg(F.col("price") / F.col("size_sqft")).alias("m"))
    i = l.join(a, "area", "left").select(
        "id", F.when((F.col("bedrooms") == 4) & (F.col("deal_type") == "sale"), 0.0).otherwise(F.col("price")).alias("price"), "size_sqft", "bedrooms", "deal_type", "area",
        F.when(F.col("deal_quality").isNotNull(), F.col("building")).alias("building"), F.lit("apartment").alias("property_type"), F.when(F.col("is_hot_deal"), 180.0).alias("bld_sale_psf"),
        F.when(F.col("deal_quality") != "good", F.col("m")).alias("mkt_sqft"), F.when(F.col("bedrooms") != 2, 15000.0).alias("mkt_rent_1br"), F.when(F.col("bedrooms") != 3, F.col("bedrooms") * 4.0).alias("mkt_growth"))
    return sc.investment_metrics(i, ["nation_1"]).select(
        "id", "roi", "yearly_rent", "payback_years", "value_in_5y", "total_return_5y_pct", "risk_score", "data_source", "psf_vs_market_pct", "recommendation")


_STATS = _MONTHLY + """, latest AS (SELECT area, property_type, arg_max(median_price, period_month) AS median, arg_max(deals_count, period_month) AS area_deals FROM monthly GROUP BY ALL),
yoy AS (SELECT n.area, n.property_type, (n.m - o.m) / o.m * 100.0::DOUBLE AS yoy FROM (SELECT area, property_type, avg(price) AS m FROM tx WHERE deal_type = 'sale' AND deal_date >= DATE '2000-08-01' GROUP BY ALL) n
  JOIN (SELECT area, property_type, avg(price) AS m FROM tx WHERE deal_type = 'sale' AND deal_date >= DATE '1999-08-01' AND deal_date < DATE '2000-08-01' GROUP BY ALL) o ON n.area = o.area AND n.property_type = o.property_type),
yld AS (SELECT area, avg(price) FILTER (WHERE deal_type = 'rent') / avg(price) FILTER (WHERE deal_type = 'sale') * 6.0::DOUBLE AS yield_pct FROM tx GROUP BY area),
bd AS (SELECT building, count(*) AS building_deals FROM tx GROUP BY building)"""

_SCORED = """sc0 AS (SELECT t.order_id, t.line_no, t.area, t.property_type, t.bedrooms, t.deal_type, t.price, greatest(0.0, least(1.0, (1 - price / median) / 0.3::DOUBLE)) AS pf, median, coalesce(greatest(0.0, least(1.0, yoy / 15.0::DOUBLE)), 0.4::DOUBLE) AS gf,
  coalesce(greatest(0.0, least(1.0, yield_pct / 10.0::DOUBLE)), 0.5::DOUBLE) AS yf, greatest(0.0, least(1.0, 0.5::DOUBLE * CASE WHEN t.line_no = 1 THEN 0.4 WHEN t.line_no < 4 THEN 1.0 ELSE 0.8 END::DOUBLE + 0.3::DOUBLE * least(1.0, coalesce(building_deals, 0) / 200.0::DOUBLE) + 0.2::DOUBLE * least(1.0, coalesce(area_deals, 0) / 100.0::DOUBLE))) AS rf
  FROM (SELECT * FROM tx WHERE deal_date >= DATE '2001-01-01' AND deal_type = 'sale') t LEFT JOIN latest USING (area, property_type) LEFT JOIN yoy USING (area, property_type) LEFT JOIN yld USING (area) LEFT JOIN bd USING (building)),
sc1 AS (SELECT *, 25.0::DOUBLE * CASE WHEN median > 0 THEN pf ELSE 0.5 END + 25.0::DOUBLE * gf + 25.0::DOUBLE * yf + 25.0::DOUBLE * rf AS total FROM sc0)"""


def scored(spark, d):
    """Sales of the current year with all inputs of the 0–100 score."""
    tx = transactions(spark, d)
    stats = latest_asof(monthly_stats(tx), ["area", "property_type"], "period_month", ["median_price", "deals_count"]).select(
        "area", "property_type", F.col("median_price").alias("median"), F.col("deals_count").alias("area_deals"))
    day = lambda s: F.lit(s).cast("date")
    sale, dt = F.col("deal_type") == "sale", F.col("deal_date")
    yoy = tx.filter(sale).groupBy("area", "property_type").agg(
        F.avg(F.when(dt >= day("2000-08-01"), F.col("price"))).alias("now"), F.avg(F.when((dt >= day("1999-08-01")) & (dt < day("2000-08-01")), F.col("price"))).alias("old")
    ).select("area", "property_type", ((F.col("now") - F.col("old")) / F.col("old") * 100.0).alias("yoy"))
    yld = tx.groupBy("area").agg((F.avg(F.when(~sale, F.col("price"))) / F.avg(F.when(sale, F.col("price"))) * 6.0).alias("yield_pct"))
    bd = tx.groupBy("building").agg(F.count(F.lit(1)).alias("building_deals"))
    rows = tx.filter((dt >= day("2001-01-01")) & sale)
    line = F.col("line_no")
    joined = (
        rows.join(stats, ["area", "property_type"], "left").join(yoy, ["area", "property_type"], "left").join(yld, "area", "left").join(bd, "building", "left")
        .withColumn("is_off_plan", line == 1).withColumn("status", F.when(line < 4, "ready").otherwise("listed"))
    )
    return sc.investment_score(joined)


@query("investment_score", f"""WITH {TX}, {_STATS}, {_SCORED}
SELECT order_id, line_no, area, property_type, round_even(total, 1) AS score, CASE WHEN total >= 90 THEN 'A+' WHEN total >= 80 THEN 'A' WHEN total >= 70 THEN 'B+' WHEN total >= 60 THEN 'B' WHEN total >= 50 THEN 'C+' WHEN total >= 40 THEN 'C' ELSE 'D' END AS rating FROM sc1""")
def q_investment_score(spark, d):
    return scored(spark, d).select("order_id", "line_no", "area", "property_type", "score", "rating")


@query("flagship_deal_scores", f"""WITH {TX}, {_STATS}, {_SCORED}, {BENCH},
j AS (SELECT s.*, b.median AS bm FROM sc1 s LEFT JOIN bench b ON b.area = s.area AND b.property_type = s.property_type AND b.bedrooms = s.bedrooms AND b.deal_type = s.deal_type)
SELECT order_id, line_no, area, property_type, price, round(bm, 2) AS bench_median, round_even(total, 1) AS score FROM j WHERE NOT coalesce(abs(price - bm) / bm > 0.9, FALSE)
ORDER BY round_even(total, 1) DESC, price, order_id, line_no LIMIT 25""")
def q_flagship(spark, d):
    bench = bm.area_price_benchmark(transactions(spark, d))
    gated = bm.benchmark_gate(scored(spark, d).withColumnRenamed("median", "stats_median"), bench, 0.9)
    ok = gated.filter(F.col("bench_reason").isNull())
    return ok.orderBy(F.col("score").desc(), "price", "order_id", "line_no").limit(25).select(
        "order_id", "line_no", "area", "property_type", "price", F.round("median", 2).alias("bench_median"), "score")


@query("week_over_week_growth", f"""WITH {TX}, b AS (SELECT max(deal_date) AS mx FROM tx), f AS (SELECT area, price, CASE WHEN deal_date > mx - INTERVAL 60 DAYS THEN 'cur' ELSE 'prev' END AS bucket FROM tx, b WHERE deal_date >= mx - INTERVAL 120 DAYS AND price BETWEEN 2000 AND 100000),
g AS (SELECT area, bucket, count(*) AS n, quantile_cont(price, 0.5) AS med FROM f GROUP BY ALL), w AS (SELECT area, max(med) FILTER (WHERE bucket = 'cur') AS med_cur, max(n) FILTER (WHERE bucket = 'cur') AS n_cur, max(med) FILTER (WHERE bucket = 'prev') AS med_prev, max(n) FILTER (WHERE bucket = 'prev') AS n_prev FROM g GROUP BY area),
t AS (SELECT *, n_cur + n_prev AS volume, (med_cur - med_prev) / med_prev * 100.0::DOUBLE AS gr FROM w WHERE n_cur >= 3 AND n_prev >= 3 ORDER BY volume DESC, area LIMIT 30)
SELECT area, round(med_cur, 4) AS med_cur, round(med_prev, 4) AS med_prev, volume, round(gr, 4) AS growth_pct, CASE WHEN gr > 5 THEN 'rising' WHEN gr < -5 THEN 'falling' ELSE 'stable' END AS trend FROM t WHERE abs(gr) <= 200""")
def q_wow(spark, d):
    out = sc.week_over_week_growth(transactions(spark, d), (2000, 100000), 60)
    return out.select("area", F.round("med_cur", 4).alias("med_cur"), F.round("med_prev", 4).alias("med_prev"), "volume", F.round("growth_pct", 4).alias("growth_pct"), "trend")


@query("listing_search", f"""WITH {LISTINGS}, h AS (SELECT * FROM listings WHERE deal_type = 'sale' AND price BETWEEN 100000 AND 400000)
SELECT id, deal_quality, price, (SELECT count(*) FROM h) AS total FROM h ORDER BY deal_quality DESC NULLS LAST, price, id LIMIT 10 OFFSET 20""")
def q_listing_search(spark, d):
    page, total = fl.listing_search(listings(spark, d), {"deal_type": "sale", "min_price": 100000, "max_price": 400000}, "best_deals", 10, 20)
    return page.select("id", "deal_quality", "price", total.scalar().alias("total"))


@query("sort_modes", f"""WITH {LISTINGS}, s AS (SELECT id, row_number() OVER (ORDER BY price DESC NULLS FIRST, id) AS a, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS b, row_number() OVER (ORDER BY price, id) AS c FROM listings)
SELECT 'price_desc' AS mode, id FROM s WHERE a <= 5 UNION ALL SELECT 'newest', id FROM s WHERE b <= 5 UNION ALL SELECT 'price_asc', id FROM s WHERE c <= 5""")
def q_sort_modes(spark, d):
    l = listings(spark, d)
    parts = [fl.listing_search(l, {}, m, 5)[0].select(F.lit(m).alias("mode"), "id") for m in ("price_desc", "newest", "price_asc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_deals", f"""WITH {LISTINGS} SELECT id, round(price / size_sqft, 4) AS psf FROM listings WHERE created_at >= TIMESTAMP '2001-06-01' AND size_sqft > 0 ORDER BY price / size_sqft, id LIMIT 10""")
def q_top_deals(spark, d):
    l = listings(spark, d).filter(F.col("size_sqft") > 0).withColumn("psf", F.col("price") / F.col("size_sqft"))
    return sc.top_deals(l, ts("2001-06-01 00:00:00"), "created_at", [F.col("psf"), F.col("id")], 10).select("id", F.round("psf", 4).alias("psf"))


@query("top_entities_latest", f"""WITH {TX}, {_MONTHLY}, l AS (SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY area, property_type ORDER BY period_month DESC) = 1)
SELECT area, property_type, deals_count, strftime(period_month, '%Y-%m') AS period FROM l ORDER BY deals_count DESC, area, property_type LIMIT 12""")
def q_top_entities(spark, d):
    latest = ag.latest_per_key(monthly_stats(transactions(spark, d)), ["area", "property_type"], [F.col("period_month").desc()])
    return latest.orderBy(F.col("deals_count").desc(), "area", "property_type").limit(12).select("area", "property_type", "deals_count", F.date_format("period_month", "yyyy-MM").alias("period"))


@query("liquidity_tier", f"""WITH {TX}, {LISTINGS}, r AS (SELECT * FROM tx WHERE deal_date >= DATE '1999-08-01'), bb AS (SELECT building || '/' || developer AS b, deal_date FROM r),
b AS (SELECT b, count(*) AS n, avg(gap) AS days FROM (SELECT b, deal_date - lag(deal_date) OVER (PARTITION BY b ORDER BY deal_date) AS gap FROM bb) GROUP BY b HAVING pow(count(*), 2) > 3),
a AS (SELECT area, count(*) AS n, avg(gap) AS days FROM (SELECT area, deal_date - lag(deal_date) OVER (PARTITION BY area ORDER BY deal_date) AS gap FROM r) GROUP BY area HAVING pow(count(*), 2) > 10),
k AS (SELECT DISTINCT building || '/' || developer AS building, CASE WHEN property_type <> 'large' THEN area END AS area, CASE WHEN bedrooms > 2 THEN bedrooms END AS deals_12m FROM tx WHERE deal_date < DATE '1996-01-01'),
j AS (SELECT k.*, nullif(CASE WHEN b.b IS NOT NULL THEN b.days ELSE a.days END, 0) AS days, b.b IS NOT NULL AS hb FROM k LEFT JOIN b ON k.building = b.b LEFT JOIN a ON k.area = a.area)
SELECT building, area, deals_12m, CASE WHEN days IS NOT NULL THEN CASE WHEN days < 30 THEN 'A' WHEN days < 90 THEN 'B' WHEN days < 180 THEN 'C' ELSE 'D' END WHEN deals_12m > 0 THEN CASE WHEN deals_12m / 12.0::DOUBLE >= 1.0 THEN 'A' WHEN deals_12m / 12.0::DOUBLE >= 0.5 THEN 'B' WHEN deals_12m / 12.0::DOUBLE >= 0.2 THEN 'C' ELSE 'D' END ELSE 'C' END AS tier,
  CASE WHEN days IS NOT NULL THEN CASE WHEN hb THEN 'building' ELSE 'area' END WHEN deals_12m > 0 THEN 'deal_rate' ELSE 'unknown' END AS tier_source FROM j""")
def q_liquidity_tier(spark, d):
    tx = transactions(spark, d).withColumn("building", F.concat_ws("/", "building", "developer"))
    k = tx.filter(F.col("deal_date") < F.lit("1996-01-01").cast("date")).select(
        "building", F.when(F.col("property_type") != "large", F.col("area")).alias("area"), F.when(F.col("bedrooms") > 2, F.col("bedrooms")).alias("deals_12m")).distinct()
    return sc.liquidity_tier(k, tx, AS_OF, "deals_12m").drop("avg_days_between")


@query("health_score", f"""WITH {INTERACTIONS}, p AS (SELECT bot_name, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE outcome = 'error') AS e, count(*) FILTER (WHERE outcome = 'empty') AS m FROM interactions GROUP BY ALL)
SELECT bot_name, day, CAST(greatest(0, least(100, 100 - 8 * e - 5 * m)) AS BIGINT) AS health_score FROM p""")
def q_health_score(spark, d):
    p = interactions(spark, d).groupBy("bot_name", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "empty").alias("empties"))
    return sc.health_score(p, {"errors": 8, "empties": 5}).select("bot_name", "day", "health_score")
