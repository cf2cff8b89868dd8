"""Series, forecasts, anomalies and effects."""

from pyspark.sql import functions as F

from gavel.operators import series as se
from gavel.plans.registry import query
from gavel.plans.roles import INTERACTIONS, TX, interactions, transactions
from gavel.sources.tables import load_table

_LINES = """lines AS (SELECT area, building, developer, deal_date, CAST(deal_date AS DATE) - line_no * 9 AS created, price / size_sqft AS psf FROM tx)"""


def lines(spark, d):
    return transactions(spark, d).select(
        "area", "building", "developer", "deal_date", F.date_sub("deal_date", F.col("line_no") * 9).alias("created"), (F.col("price") / F.col("size_sqft")).alias("psf"))


@query("weekly_series", f"""WITH {TX}, {_LINES}
SELECT area, strftime(date_trunc('week', deal_date), '%Y-%m-%d') AS week, round(quantile_cont(psf, 0.5), 8) AS median_psf, count(*) AS supply, count(*) FILTER (WHERE created >= deal_date - 30) AS demand
FROM lines WHERE psf BETWEEN 100 AND 20000 GROUP BY area, date_trunc('week', deal_date)""")
def q_weekly_series(spark, d):
    w = se.weekly_series(lines(spark, d), ["area"], "deal_date", "psf", "created")
    return w.select("area", F.date_format("week", "yyyy-MM-dd").alias("week"), F.round("median_psf", 8).alias("median_psf"), "supply", "demand")


_GRAPH = """wk AS (SELECT area, date_trunc('week', deal_date) AS w, count(*) AS supply FROM lines WHERE psf BETWEEN 100 AND 20000 GROUP BY ALL),
tier AS (SELECT area, list(supply ORDER BY supply)[len(list(supply)) // 2 + 1] AS s FROM wk GROUP BY area),
ar AS (SELECT area, count(*) AS n, avg(psf) FILTER (WHERE psf > 0) AS p FROM lines GROUP BY area ORDER BY n DESC, area LIMIT 6),
bl AS (SELECT building, area, count(*) AS n, avg(psf) FILTER (WHERE psf > 0) AS p FROM lines GROUP BY ALL ORDER BY n DESC, building, area LIMIT 40), dv AS (SELECT DISTINCT building, developer FROM lines)"""


def _graph(spark, d):
    l = lines(spark, d)
    supply = l.filter(F.col("psf").between(100, 20000)).groupBy("area", F.date_trunc("week", "deal_date").alias("w")).agg(F.count(F.lit(1)).alias("supply"))
    return se.entity_graph(l, l, supply, 6, 40)


@query("entity_graph_nodes", f"""WITH {TX}, {_LINES}, {_GRAPH}
SELECT 'area:' || ar.area AS node_id, 'area' AS node_type, ar.area AS name, NULL AS parent_id, n AS listings_total, round(p, 4) AS avg_psf, CASE WHEN s >= 200 THEN 'A' WHEN s >= 60 THEN 'B' WHEN s >= 15 THEN 'C' ELSE 'D' END AS tier FROM ar LEFT JOIN tier ON ar.area = tier.area
UNION ALL SELECT DISTINCT 'area:' || area, 'area', area, NULL, NULL, NULL, NULL FROM bl WHERE area NOT IN (SELECT area FROM ar)
UNION ALL SELECT 'building:' || building || '@' || area, 'building', building, 'area:' || area, n, round(p, 4), NULL FROM bl UNION ALL SELECT DISTINCT 'developer:' || developer, 'developer', developer, NULL, NULL, NULL, NULL FROM dv""")
def q_graph_nodes(spark, d):
    return _graph(spark, d)[0].withColumn("avg_psf", F.round("avg_psf", 4))


@query("entity_graph_edges", f"""WITH {TX}, {_LINES}, {_GRAPH}
SELECT 'area:' || area AS src, 'building:' || building || '@' || area AS dst, 'area_contains_building' AS kind FROM bl
UNION ALL SELECT 'building:' || bl.building || '@' || area, 'developer:' || developer, 'building_by_developer' FROM bl JOIN dv ON bl.building = dv.building""")
def q_graph_edges(spark, d):
    return _graph(spark, d)[1]


_MONTHS = """ms AS (SELECT area, CAST(date_trunc('month', deal_date) AS DATE) AS day, avg(price / size_sqft) AS v FROM tx WHERE deal_type = 'sale' GROUP BY ALL)"""
_TREND = """b AS (SELECT area, min(day) AS d0, max(day) AS d1, count(*) AS n, arg_max(v, day) AS lastv FROM ms GROUP BY area HAVING count(*) >= 6),
xy AS (SELECT ms.area, day, v, d0, d1, n, lastv, CAST(day - d0 AS DOUBLE) AS x FROM ms JOIN b ON ms.area = b.area),
fit AS (SELECT area, (avg(x * v) - avg(x) * avg(v)) / (avg(x * x) - avg(x) * avg(x)) AS slope, avg(v) - (avg(x * v) - avg(x) * avg(v)) / (avg(x * x) - avg(x) * avg(x)) * avg(x) AS icpt FROM xy GROUP BY area),
tr AS (SELECT xy.area, any_value(slope) AS slope, any_value(icpt) AS intercept, any_value(d0) AS d0, any_value(d1) AS d1, any_value(lastv) AS last_value, any_value(n) AS points, sqrt(avg(pow(v - icpt - slope * x, 2))) AS rmse, stddev_pop(v - icpt - slope * x) AS resid_std
  FROM xy JOIN fit ON xy.area = fit.area GROUP BY xy.area)"""


def months(spark, d):
    return transactions(spark, d).filter(F.col("deal_type") == "sale").groupBy("area", F.to_date(F.date_trunc("month", "deal_date")).alias("day")).agg(F.avg(F.col("price") / F.col("size_sqft")).alias("v"))


def _trend(spark, d):
    return se.ols_trend(months(spark, d), ["area"], "day", "v")


@query("ols_trend", f"""WITH {TX}, {_MONTHS}, {_TREND}
SELECT area, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(rmse, 4) AS rmse, round(resid_std, 4) AS resid_std, points FROM tr""")
def q_ols_trend(spark, d):
    return _trend(spark, d).select("area", F.round("slope", 6).alias("slope"), *[F.round(c, 4).alias(c) for c in ("intercept", "rmse", "resid_std")], "points")


_FC = """fc AS (SELECT area, last_value, step, d1 + CAST(step AS INT) * 30 AS ds, intercept + slope * (d1 + CAST(step AS INT) * 30 - d0) AS yhat, resid_std AS sd FROM tr, range(1, 7) r(step))"""


@query("ols_forecast", f"""WITH {TX}, {_MONTHS}, {_TREND}, {_FC}
SELECT area, CAST(step AS INT) AS step, strftime(ds, '%Y-%m-%d') AS ds, round(yhat, 4) AS yhat, round(yhat - 1.28::DOUBLE * sd, 4) AS yhat_lower, round(yhat + 1.28::DOUBLE * sd, 4) AS yhat_upper FROM fc""")
def q_ols_forecast(spark, d):
    f = se.ols_forecast(_trend(spark, d), 6)
    return f.select("area", "step", F.date_format("ds", "yyyy-MM-dd").alias("ds"), *[F.round(c, 4).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])


@query("naive_forecast", f"""WITH {TX}, {_MONTHS}, r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY day DESC) AS back FROM ms QUALIFY back <= 12),
f AS (SELECT area, count(*) AS n, max(day) AS d1, regr_slope(v, 12 - back) AS s, regr_intercept(v, 12 - back) AS c FROM r GROUP BY area HAVING count(*) >= 2)
SELECT area, CAST(step AS INT) AS step, strftime(d1 + CAST(step AS INT) * 30, '%Y-%m-%d') AS ds, round(c + s * (11 + step), 4) AS yhat, round((c + s * (11 + step)) * 0.9::DOUBLE, 4) AS yhat_lower, round((c + s * (11 + step)) * 1.1::DOUBLE, 4) AS yhat_upper FROM f, range(1, 5) t(step)""")
def q_naive_forecast(spark, d):
    f = se.naive_forecast(months(spark, d), ["area"], "day", "v", 4)
    return f.select("area", "step", F.date_format("ds", "yyyy-MM-dd").alias("ds"), *[F.round(c, 4).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])


@query("forecast_backtest", f"""WITH {TX}, {_MONTHS}, p AS (SELECT area, v, row_number() OVER (PARTITION BY area ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY area) AS n FROM ms),
f AS (SELECT area, any_value(n) AS n, regr_slope(v, i) AS s, regr_intercept(v, i) AS c, avg(v) AS m, min(v) AS lo, regr_slope(v, i) FILTER (WHERE i < greatest(3, floor(n * 0.6::DOUBLE))) AS ts, regr_intercept(v, i) FILTER (WHERE i < greatest(3, floor(n * 0.6::DOUBLE))) AS ti FROM p GROUP BY area),
e AS (SELECT p.area, sqrt(avg(pow(ts * i + ti - v, 2))) / any_value(m) * 100.0::DOUBLE AS rp FROM p JOIN f ON p.area = f.area WHERE i >= greatest(3, floor(p.n * 0.6::DOUBLE)) GROUP BY p.area)
SELECT f.area, CAST(step AS INT) AS step, round(greatest(s * (n + step - 1) + c, lo * 0.5::DOUBLE), 4) AS point, round(greatest(s * (n + step - 1) + c, lo * 0.5::DOUBLE) * (1 - (0.15::DOUBLE + 0.1::DOUBLE * (step - 1) / 11)), 4) AS lower,
  round(greatest(s * (n + step - 1) + c, lo * 0.5::DOUBLE) * (1 + (0.15::DOUBLE + 0.1::DOUBLE * (step - 1) / 11)), 4) AS upper, round_even(rp, 1) AS rmse_pct, CASE WHEN rp > 30 THEN 'low' WHEN rp > 15 THEN 'medium' ELSE 'high' END AS confidence FROM f JOIN e ON f.area = e.area, range(1, 13) t(step)""")
def q_forecast_backtest(spark, d):
    f = se.price_forecast(months(spark, d), ["area"], "day", "v", 12)
    return f.select("area", "step", *[F.round(c, 4).alias(c) for c in ("point", "lower", "upper")], "rmse_pct", "confidence")


_HOURS = """hr AS (SELECT bot_name, date_trunc('hour', ts) AS h, avg(latency_ms) AS v FROM interactions GROUP BY ALL)"""


def hours(spark, d):
    return interactions(spark, d).groupBy("bot_name", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("latency_ms").alias("v"))


@query("mape_backtest", f"""WITH {INTERACTIONS}, {_HOURS}, p AS (SELECT bot_name, h, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY bot_name) AS n, epoch(h) - epoch(min(h) OVER (PARTITION BY bot_name)) AS x FROM hr WINDOW w AS (PARTITION BY bot_name ORDER BY h)),
f AS (SELECT bot_name, regr_slope(v, x) AS s, regr_intercept(v, x) AS c FROM p WHERE i < floor(n * 0.7::DOUBLE) GROUP BY 1)
SELECT p.bot_name, round(avg(abs((v - (s * x + c)) / v)) * 100.0::DOUBLE, 4) AS mape_pct, max(n) AS samples, CASE WHEN avg(abs((v - (s * x + c)) / v)) * 100 < 10 THEN 'high' WHEN avg(abs((v - (s * x + c)) / v)) * 100 < 25 THEN 'medium' ELSE 'low' END AS confidence
FROM p JOIN f ON p.bot_name = f.bot_name WHERE i >= floor(n * 0.7::DOUBLE) AND abs(v) > 1e-9 AND n >= 40 GROUP BY p.bot_name""")
def q_mape(spark, d):
    return se.mape_backtest(hours(spark, d), ["bot_name"], "h", "v").withColumn("mape_pct", F.round("mape_pct", 4))


@query("what_if", f"""WITH {TX}, {_MONTHS}, {_TREND}, {_FC}, sc AS (SELECT n_name AS area, CASE n_regionkey WHEN 0 THEN 'supply +30%' WHEN 1 THEN 'Demand -10%' WHEN 2 THEN 'rates +1%' WHEN 3 THEN 'nothing' ELSE 'rate -0.5%' END AS scenario,
  CASE n_regionkey WHEN 0 THEN -9.0 WHEN 1 THEN -4.0 WHEN 2 THEN -0.8 WHEN 3 THEN 0.0 ELSE 0.4 END::DOUBLE AS sh FROM nation)
SELECT fc.area, scenario, sh AS shift_pct, CAST(step AS INT) AS step, round_even(yhat * (1.0 + sh / 100.0::DOUBLE), 2) AS yhat FROM fc JOIN sc ON fc.area = sc.area""")
def q_what_if(spark, d):
    r = F.col("n_regionkey")
    sc = load_table(spark, d, "nation").select(
        F.col("n_name").alias("area"), F.when(r == 0, "supply +30%").when(r == 1, "Demand -10%").when(r == 2, "rates +1%").when(r == 3, "nothing").otherwise("rate -0.5%").alias("scenario"))
    return se.what_if(se.ols_forecast(_trend(spark, d), 6), sc, "area").select("area", "scenario", "shift_pct", "step", "yhat")


@query("compare_entities", f"""WITH {TX}, {_MONTHS}, {_TREND}, {_FC}, ch AS (SELECT area, (arg_max(yhat, step) - max(last_value)) / max(last_value) * 100.0::DOUBLE AS pct FROM fc GROUP BY area),
pr AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 5)
SELECT a, b, round(x.pct, 4) AS a_pct, round(y.pct, 4) AS b_pct, CASE WHEN x.pct > y.pct THEN a ELSE b END AS winner FROM pr JOIN ch x ON x.area = a JOIN ch y ON y.area = b""")
def q_compare(spark, d):
    n = load_table(spark, d, "nation")
    pairs = n.select(F.col("n_name").alias("a"), "n_regionkey", (F.col("n_nationkey") + 5).alias("n_nationkey")).join(n.select(F.col("n_name").alias("b"), "n_regionkey", "n_nationkey"), ["n_regionkey", "n_nationkey"]).select("a", "b")
    ch = se.forecast_change(se.ols_forecast(_trend(spark, d), 6), ["area"])
    return se.compare_entities(ch, pairs, "area").select("a", "b", F.round("a_pct", 4).alias("a_pct"), F.round("b_pct", 4).alias("b_pct"), "winner")


@query("zscore_anomaly", f"""WITH {INTERACTIONS}, {_HOURS}, s AS (SELECT bot_name, avg(v) AS m, stddev_pop(v) AS sd FROM hr WHERE h < TIMESTAMP '2024-01-25' GROUP BY 1 HAVING count(*) >= 10)
SELECT hr.bot_name, strftime(h, '%Y-%m-%d %H') AS hour, round((v - m) / sd, 5) AS z_score, abs((v - m) / sd) > 2 AS is_anomaly, CASE WHEN v > m THEN 'high' ELSE 'low' END AS direction FROM hr JOIN s ON hr.bot_name = s.bot_name WHERE h >= TIMESTAMP '2024-01-25'""")
def q_zscore(spark, d):
    h = hours(spark, d)
    cut = F.lit("2024-01-25 00:00:00").cast("timestamp")
    out = se.zscore_anomaly(h.filter(F.col("h") < cut), h.filter(F.col("h") >= cut), ["bot_name"], "v", limit=2.0)
    return out.select("bot_name", F.date_format("h", "yyyy-MM-dd HH").alias("hour"), F.round("z_score", 5).alias("z_score"), "is_anomaly", "direction")


@query("empty_rate_anomaly", f"""WITH {INTERACTIONS}, dl AS (SELECT bot_name, CAST(ts AS DATE) AS d, count(*) FILTER (WHERE outcome = 'empty') / count(*) AS er FROM interactions WHERE ts > TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-22' GROUP BY ALL),
s AS (SELECT bot_name, avg(er) AS mu, stddev_pop(er) AS sd FROM dl WHERE d < DATE '2024-01-21' GROUP BY 1)
SELECT dl.bot_name, round(er * 100.0::DOUBLE, 1) AS today_pct, round(mu * 100.0::DOUBLE, 1) AS mean_pct, round(sd * 100.0::DOUBLE, 1) AS sd_pct FROM dl JOIN s ON dl.bot_name = s.bot_name WHERE d = DATE '2024-01-21' AND sd > 0 AND er > mu + 0.2::DOUBLE * sd""")
def q_empty_rate(spark, d):
    return se.empty_rate_anomaly(interactions(spark, d), "2024-01-21", 14, 0.2)



@query("forecast_alerts", f"""WITH {TX}, {_MONTHS.replace('ms AS', 'ms0 AS')}, ms1 AS (SELECT * FROM ms0), ms AS (SELECT 'disk.size_mb.' || area AS area, day, v FROM ms1 UNION ALL SELECT 'leads.intake_' || area, day, v FROM ms1 UNION ALL SELECT 'latency.' || area, day, v FROM ms1 UNION ALL SELECT 'accuracy.' || area, day, v FROM ms1),
{_TREND}, {_FC}, a AS (SELECT area, max(last_value) AS cur, min(yhat - 1.28::DOUBLE * sd) AS lo, max(yhat + 1.28::DOUBLE * sd) AS hi, arg_min(ds, (yhat - 1.28::DOUBLE * sd, ds)) AS low_at, min(ds) FILTER (WHERE yhat + 1.28::DOUBLE * sd > 6500) AS over_at FROM fc GROUP BY area)
SELECT area AS metric, 'accuracy_drop' AS type, 'HIGH' AS severity, strftime(low_at, '%Y-%m-%d') AS "when" FROM a WHERE area LIKE 'accuracy%' AND lo < cur - 2.0
UNION ALL SELECT area, 'disk_full', 'CRITICAL', strftime(over_at, '%Y-%m-%d') FROM a WHERE area LIKE 'disk%' AND over_at IS NOT NULL
UNION ALL SELECT area, 'leads_drop', 'MEDIUM', NULL FROM a WHERE area LIKE 'leads%' AND cur >= 5 AND lo < cur * 0.5::DOUBLE UNION ALL SELECT area, 'latency_rise', 'MEDIUM', NULL FROM a WHERE area LIKE 'latency%' AND cur > 0 AND hi > cur * 1.5::DOUBLE""")
def q_forecast_alerts(spark, d):
    m = months(spark, d)
    names = ["disk.size_mb.", "leads.intake_", "latency.", "accuracy."]
    metric = m.withColumn("p", F.explode(F.array(*[F.lit(x) for x in names]))).select(F.concat("p", "area").alias("metric"), "day", "v")
    f = se.ols_forecast(se.ols_trend(metric, ["metric"], "day", "v"), 6)
    return se.forecast_alerts(f, "metric", 6500).select("metric", "type", "severity", F.date_format("when", "yyyy-MM-dd").alias("when"))


_UNITS = """u AS (SELECT CASE WHEN property_type IN ('large', 'promo') THEN 1.0 ELSE 0.0 END::DOUBLE AS t, price AS y, size_sqft AS c FROM tx WHERE deal_type = 'sale'),
q AS (SELECT count(*) AS n, avg(t) AS mt, avg(y) AS my, avg(c) AS mc, covar_pop(t, t) AS tt, covar_pop(c, c) AS cc, covar_pop(t, c) AS tc, covar_pop(t, y) AS ty, covar_pop(c, y) AS cy, stddev_samp(c) AS sc FROM u),
ate AS (SELECT *, (ty * cc - cy * tc) / (tt * cc - tc * tc) AS ate FROM q)"""


def units(spark, d):
    return transactions(spark, d).filter(F.col("deal_type") == "sale").select(
        F.xxhash64("order_id", "line_no", "price").alias("id"), F.when(F.col("property_type").isin("large", "promo"), 1.0).otherwise(0.0).alias("t"), F.col("price").alias("y"), F.col("size_sqft").alias("c"),
        F.col("bedrooms").cast("double").alias("b"))


@query("ate_linear", f"""WITH {TX}, {_UNITS} SELECT n, round(ate, 3) AS ate FROM ate""")
def q_ate(spark, d):
    return se.ate_linear(units(spark, d), "t", "y", ["c"], "id", replicates=0).select("n", F.round("ate", 3).alias("ate"))


_WEIGHT = " + ".join(f"CASE WHEN u > {step!r}::DOUBLE THEN 1.0::DOUBLE ELSE 0 END" for step in se.POISSON_STEPS)
_DET = lambda a: f"({a[0]} * ({a[4]} * {a[8]} - {a[5]} * {a[7]}) - {a[1]} * ({a[3]} * {a[8]} - {a[5]} * {a[6]}) + {a[2]} * ({a[3]} * {a[7]} - {a[4]} * {a[6]}))"
_ATE3 = _DET(["ty", "tc", "tb", "cy", "cc", "cb", "yb", "cb", "bb"]) + " / " + _DET(["tt", "tc", "tb", "tc", "cc", "cb", "tb", "cb", "bb"])
_COVARIANCES = ", ".join(f"sum(w * {p[0]} * {p[1]}) / sum(w) - sum(w * {p[0]}) / sum(w) * (sum(w * {p[1]}) / sum(w)) AS {p}" for p in ("tt", "tc", "tb", "ty", "cc", "cb", "cy", "bb", "yb"))


# 200 replicates; the weights come from MD5 digits, so SQL draws the same samples.
@query("ate_bootstrap", f"""WITH {TX}, m AS (SELECT avg(size_sqft) AS mc, avg(bedrooms) AS mb, avg(price) AS my FROM tx WHERE deal_type = 'sale'),
u AS (SELECT order_id || '-' || line_no AS id, CASE WHEN property_type IN ('large', 'promo') THEN 1.0 ELSE 0.0 END::DOUBLE AS t, price::DOUBLE - my AS y, size_sqft::DOUBLE - mc AS c, bedrooms::DOUBLE - mb AS b FROM tx, m WHERE deal_type = 'sale' AND price IS NOT NULL AND size_sqft IS NOT NULL AND bedrooms IS NOT NULL),
d AS (SELECT t, y, c, b, block, md5(id || ':' || block || ':42') AS h FROM (SELECT *, unnest(range(0, 50)) AS block FROM u)),
g AS (SELECT block * 4 + s AS rep, t, y, c, b, ('0x' || substr(h, CAST(8 * s + 1 AS BIGINT), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT *, unnest(range(0, 4)) AS s FROM d)),
w AS (SELECT rep, t, y, c, b, {_WEIGHT} AS w FROM g), v AS (SELECT rep, {_COVARIANCES} FROM w GROUP BY rep), r AS (SELECT {_ATE3} AS ate FROM v),
o AS (SELECT count(*) AS n, {_COVARIANCES} FROM (SELECT *, 1.0::DOUBLE AS w FROM u))
SELECT n, round({_ATE3}, 2) AS ate, (SELECT round(quantile_cont(ate, 0.025), 2) FROM r) AS ate_lower, (SELECT round(quantile_cont(ate, 0.975), 2) FROM r) AS ate_upper FROM o""")
def q_ate_bootstrap(spark, d):
    tx = transactions(spark, d).filter(F.col("deal_type") == "sale")
    rows = tx.select(
        F.concat_ws("-", "order_id", "line_no").alias("id"), F.when(F.col("property_type").isin("large", "promo"), 1.0).otherwise(0.0).alias("t"), F.col("price").alias("y"),
        F.col("size_sqft").alias("c"), F.col("bedrooms").cast("double").alias("b"))
    return se.ate_linear(rows, "t", "y", ["c", "b"], "id").select("n", *[F.round(x, 2).alias(x) for x in ("ate", "ate_lower", "ate_upper")])


@query("counterfactual", f"""WITH {TX}, {_UNITS}, s AS (SELECT area, avg(size_sqft) AS c, count(*) FILTER (WHERE property_type IN ('large', 'promo')) / count(*) AS t FROM tx GROUP BY area)
SELECT area, round(my + ate * (s.t - mt) + 0.1::DOUBLE * abs(ate) * (s.c - mc) / sc, 3) AS predicted FROM s, ate""")
def q_counterfactual(spark, d):
    study = se.ate_linear(units(spark, d), "t", "y", ["c"], "id", replicates=0)
    big = F.col("property_type").isin("large", "promo")
    sc = transactions(spark, d).groupBy("area").agg(F.avg("size_sqft").alias("size"), (F.count_if(big) / F.count(F.lit(1))).alias("treatment"))
    return se.counterfactual(study, sc, "t", "y", {"c": "size"}).select("area", F.round("predicted", 3).alias("predicted"))


@query("claim_backtest", f"""WITH {TX}, q AS (SELECT area, CAST(date_trunc('quarter', deal_date) AS DATE) AS q, avg(price) AS p, count(*) FILTER (WHERE property_type = 'large') AS n FROM tx GROUP BY ALL),
w AS (SELECT a.p AS now, b.p AS nxt FROM q a JOIN q b ON a.area = b.area AND b.q = a.q + INTERVAL 3 MONTHS WHERE a.n > 2),
y AS (SELECT year(deal_date) AS y, count(*) FILTER (WHERE month(deal_date) BETWEEN 6 AND 8) AS su, count(*) FILTER (WHERE month(deal_date) BETWEEN 3 AND 5) AS sp FROM tx GROUP BY 1),
h AS (SELECT 'wave' AS claim, avg(CASE WHEN nxt < now * 0.97::DOUBLE THEN 1.0 ELSE 0.0 END) AS hit_rate, count(*) AS n_obs FROM w UNION ALL SELECT 'season', avg(CASE WHEN su < sp * 0.85::DOUBLE THEN 1.0 ELSE 0.0 END), count(*) FROM y WHERE su > 0 AND sp > 0)
SELECT claim, round(hit_rate, 6) AS hit_rate, n_obs, round(greatest(0.05, least(0.99, 0.75::DOUBLE * 0.6::DOUBLE + 0.25::DOUBLE * hit_rate)), 6) AS confidence FROM h""")
def q_claims(spark, d):
    tx = transactions(spark, d)
    both = se.wave_hit_rate(tx, F.col("property_type") == "large", 2).withColumn("claim", F.lit("wave")).unionByName(se.season_hit_rate(tx, "deal_date").withColumn("claim", F.lit("season")))
    return both.select("claim", F.round("hit_rate", 6).alias("hit_rate"), "n_obs", F.round(se.ema_confidence(F.lit(0.6), F.col("hit_rate")), 6).alias("confidence"))
