"""Join shapes."""

from pyspark.sql import functions as F

from gavel.functions.scale import counted_percentiles, value_counts
from gavel.operators import joins as jn
from gavel.plans.registry import query
from gavel.plans.roles import INTERACTIONS, LISTINGS, MESSAGES, TX, interactions, listings, messages, transactions
from gavel.session import cut_lineage
from gavel.sources.tables import load_table, ts


@query("inner_equi", """
SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def q_inner_equi(spark, d):
    o, c = load_table(spark, d, "orders"), load_table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("o_orderpriority", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("left_equi", """
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS urgent FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def q_left_equi(spark, d):
    s = load_table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return load_table(spark, d, "customer").select("c_custkey").join(s, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("urgent"))


@query("semi_join", """
SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 48)""")
def q_semi_join(spark, d):
    li = load_table(spark, d, "lineitem").filter(F.col("l_quantity") >= 48).select(F.col("l_partkey").alias("p_partkey"))
    return load_table(spark, d, "part").select("p_partkey", "p_name").join(li, "p_partkey", "left_semi")


@query("anti_join", """
WITH banned AS (SELECT DISTINCT CASE WHEN o_totalprice > 470000 THEN o_custkey END AS k FROM orders)
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM banned WHERE k = c_custkey)""")
def q_anti_join(spark, d):
    banned = load_table(spark, d, "orders").select(F.when(F.col("o_totalprice") > 470000, F.col("o_custkey")).alias("c_custkey"))
    return jn.anti_join_nullable(load_table(spark, d, "customer").select("c_custkey"), banned, "c_custkey")


@query("broadcast_scalar", f"""WITH {TX}
SELECT area, count(*) AS deals, round(avg(price), 4) AS avg_price FROM tx WHERE deal_date >= (SELECT max(deal_date) FROM tx) - INTERVAL 90 DAYS GROUP BY area""")
def q_broadcast_scalar(spark, d):
    return jn.within_days_of_newest(transactions(spark, d), "deal_date", 90).groupBy("area").agg(F.count(F.lit(1)).alias("deals"), F.round(F.avg("price"), 4).alias("avg_price"))


@query("alias_or_join", """
WITH z AS (SELECT r_name AS zone_key, 'ZONE ' || r_name AS zone_name, list(n_name ORDER BY n_name) AS aliases FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2),
s AS (SELECT lower(n_name) AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
      UNION ALL SELECT lower(r_name), 1 FROM region UNION ALL SELECT 'zone ' || lower(r_name), 2 FROM region)
SELECT DISTINCT zone_key, name, n FROM z JOIN s ON lower(zone_name) = name OR lower(zone_key) = name OR list_contains(list_transform(aliases, lambda x: lower(x)), name)""")
def q_alias_or_join(spark, d):
    r, n, c = (load_table(spark, d, t) for t in ("region", "nation", "customer"))
    zones = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("zone_key")).agg(F.collect_set("n_name").alias("aliases")).withColumn("zone_name", F.concat(F.lit("ZONE "), "zone_key"))
    stats = (
        c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.lower("n_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(r.select(F.lower("r_name").alias("name"), F.lit(1).cast("bigint").alias("n")))
        .unionByName(r.select(F.concat(F.lit("zone "), F.lower("r_name")).alias("name"), F.lit(2).cast("bigint").alias("n")))
    )
    return jn.alias_join(zones, stats, "zone_key", "zone_name", "aliases", "name").select("zone_key", "name", "n")


_BENCH = """bench AS (SELECT area, property_type, bedrooms, deal_type, quantile_cont(price, 0.5) AS median, count(*) AS n FROM tx GROUP BY ALL HAVING count(*) >= 5
  UNION ALL SELECT area, property_type, NULL, deal_type, quantile_cont(price, 0.5), count(*) FROM tx GROUP BY area, property_type, deal_type HAVING count(*) >= 5)"""


def nullable_bench(tx):
    """Benchmarks per bedroom class plus the NULL class over all bedrooms."""
    keys = ["area", "property_type", "bedrooms", "deal_type"]
    whole = [k for k in keys if k != "bedrooms"]
    prices = cut_lineage(value_counts(tx, keys, "price"), "prices")
    merged = cut_lineage(prices.groupBy(*whole, "__v").agg(F.sum("__c").alias("__c")), "prices")  # the NULL class from the same counts
    exact = counted_percentiles(prices, keys, {"median": 0.5})
    every = counted_percentiles(merged, whole, {"median": 0.5}).withColumn("bedrooms", F.lit(None).cast("int"))
    return exact.unionByName(every).filter(F.col("n") >= 5)


@query("null_safe_lookup_with_fallback", f"""WITH {TX}, {_BENCH},
q AS (SELECT n_name AS area, lower(p_type) AS property_type, b.b AS bedrooms, 'sale' AS deal_type FROM nation, (SELECT DISTINCT p_type FROM part),
  (SELECT DISTINCT CAST(floor(p_size / 5) AS INT) AS b FROM part) b)
SELECT q.area, q.property_type, q.bedrooms, round(coalesce(e.median, g.median), 4) AS median, CASE WHEN e.n IS NOT NULL THEN e.n ELSE g.n END AS n,
  CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN g.n IS NOT NULL THEN 'fallback' END AS match_kind
FROM q LEFT JOIN bench e ON e.area = q.area AND e.property_type = q.property_type AND e.bedrooms = q.bedrooms AND e.deal_type = q.deal_type
LEFT JOIN bench g ON g.area = q.area AND g.property_type = q.property_type AND g.bedrooms IS NULL AND g.deal_type = q.deal_type""")
def q_lookup_fallback(spark, d):
    part = load_table(spark, d, "part")
    types = part.select(F.lower("p_type").alias("property_type")).distinct().agg(F.collect_set("property_type")).scalar()
    rooms = part.select(F.floor(F.col("p_size") / 5).cast("int").alias("b")).distinct().agg(F.collect_set("b")).scalar()
    q = load_table(spark, d, "nation").select(F.col("n_name").alias("area"), F.explode(types).alias("property_type")).select("*", F.explode(rooms).alias("bedrooms"), F.lit("sale").alias("deal_type"))
    out = jn.lookup_with_fallback(q, nullable_bench(transactions(spark, d)), ["area", "property_type", "bedrooms", "deal_type"], "bedrooms", ["median", "n"], None)
    return out.select("area", "property_type", "bedrooms", F.round("median", 4).alias("median"), "n", "match_kind")


@query("bounded_follow_join", """
WITH t AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT t.user_id, strftime(t0, '%Y-%m-%d %H:%M:%S') AS t0, strftime(min(e.ts), '%Y-%m-%d %H:%M:%S') AS t1 FROM t JOIN events e ON e.user_id = t.user_id
WHERE e.event_type = 'click' AND e.ts >= t0 AND e.ts < t0 + INTERVAL 24 HOURS GROUP BY 1, 2""")
def q_bounded_follow(spark, d):
    e = load_table(spark, d, "events")
    out = jn.first_follow(e, "user_id", "ts", F.col("event_type") == "view", F.col("event_type") == "click", "24 HOURS")
    return out.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("t0", "t1")])


_RULES = """rules AS (SELECT c_custkey AS uid, CASE WHEN c_acctbal < 6000 THEN 'sale' END AS deal_type, CASE WHEN c_acctbal > 2000 THEN lower(c_mktsegment) END AS property_type,
  n_name AS area, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(floor(c_acctbal / 2000) AS INT) END AS bedrooms,
  CASE WHEN c_acctbal > 5000 THEN 100000 ELSE 0 END AS min_price, CASE WHEN c_acctbal < 7000 THEN 400000 END AS max_price, 100 AS last_listing_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def stored_rules(spark, d):
    c, n = load_table(spark, d, "customer"), load_table(spark, d, "nation")
    bal = F.col("c_acctbal")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("uid"), F.when(bal < 6000, "sale").alias("deal_type"), F.when(bal > 2000, F.lower("c_mktsegment")).alias("property_type"),
        F.col("n_name").alias("area"), F.when(F.col("c_mktsegment") != "BUILDING", F.floor(bal / 2000).cast("int")).alias("bedrooms"),
        F.when(bal > 5000, 100000).otherwise(0).alias("min_price"), F.when(bal < 7000, 400000).alias("max_price"), F.lit(100).alias("last_listing_id"))


RULE_FIELDS = ["deal_type", "property_type", "area", "bedrooms"]


@query("rule_match_join", f"""WITH {LISTINGS}, {_RULES}, m AS (
  SELECT uid, l.id, row_number() OVER (PARTITION BY uid ORDER BY l.id DESC) AS pick FROM rules r JOIN listings l ON
    (r.deal_type IS NULL OR r.deal_type = l.deal_type) AND (r.property_type IS NULL OR r.property_type = l.property_type) AND (r.area IS NULL OR r.area = l.area)
    AND (r.bedrooms IS NULL OR r.bedrooms = l.bedrooms) AND (coalesce(r.min_price, 0) = 0 OR l.price >= r.min_price) AND (coalesce(r.max_price, 0) = 0 OR l.price <= r.max_price)
    AND l.id > r.last_listing_id)
SELECT uid, id, CAST(pick AS INT) AS pick FROM m WHERE pick <= 3""")
def q_rule_match(spark, d):
    return jn.rule_match(stored_rules(spark, d), listings(spark, d), "uid", RULE_FIELDS, 3).select("uid", "id", "pick")


@query("nearest_asof", f"""WITH {INTERACTIONS}, c AS (SELECT bot_name, id, ts, latency_ms, row_number() OVER (PARTITION BY bot_name ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-23')), ts) AS rn
  FROM interactions WHERE ts BETWEEN TIMESTAMP '2024-01-22 12:00:00' AND TIMESTAMP '2024-01-23 12:00:00')
SELECT bot_name, id, latency_ms FROM c WHERE rn = 1""")
def q_nearest_asof(spark, d):
    return jn.nearest_asof(interactions(spark, d), ["bot_name"], "ts", ts("2024-01-23 00:00:00"), "12 HOURS", ["id", "latency_ms"]).select("bot_name", "id", "latency_ms")


@query("nearest_asof_join", """
WITH v AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'click'),
j AS (SELECT v.event_id, v.user_id, c.event_id AS near_event_id, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(c.ts)), c.ts, c.event_id) AS rn
  FROM v JOIN c ON v.user_id = c.user_id AND abs(epoch_us(v.ts) - epoch_us(c.ts)) <= 43200000000)
SELECT event_id, user_id, near_event_id FROM j WHERE rn = 1""")
def q_nearest_asof_join(spark, d):
    e = load_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = jn.nearest_asof_join(e.filter(F.col("event_type") == "purchase"), e.filter(F.col("event_type") == "click"), "user_id", "ts", 43200, ["event_id"], "event_id")
    return out.select("event_id", "user_id", "near_event_id")


@query("latest_asof", f"""WITH {TX}, m AS (SELECT area, date_trunc('month', deal_date) AS p, count(*) AS deals, sum(size_sqft) AS sqft FROM tx WHERE deal_type = 'sale' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY p DESC) AS rn FROM m WHERE p <= DATE '2000-06-15')
SELECT area, strftime(p, '%Y-%m') AS period, deals, sqft FROM r WHERE rn = 1""")
def q_latest_asof(spark, d):
    m = transactions(spark, d).filter(F.col("deal_type") == "sale").groupBy("area", F.date_trunc("month", "deal_date").alias("p")).agg(F.count(F.lit(1)).alias("deals"), F.sum("size_sqft").alias("sqft"))
    return jn.latest_asof(m, ["area"], "p", ["deals", "sqft"], F.lit("2000-06-15").cast("timestamp")).select("area", F.date_format("p", "yyyy-MM").alias("period"), "deals", "sqft")


@query("consecutive_day_self_join", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
SELECT a.user_id, strftime(a.day, '%Y-%m-%d') AS day FROM d a JOIN d b ON a.user_id = b.user_id AND b.day = a.day + 1""")
def q_consecutive_day(spark, d):
    return jn.active_next_day(load_table(spark, d, "events"), "user_id", F.to_date("ts")).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("next_period_self_join", f"""WITH {TX}, q AS (SELECT area, CAST(date_trunc('quarter', deal_date) AS DATE) AS q, avg(price) AS a FROM tx WHERE deal_type = 'sale' GROUP BY ALL)
SELECT x.area, strftime(x.q, '%Y-%m-%d') AS quarter, round(x.a, 8) AS avg_now, round(y.a, 8) AS avg_next FROM q x JOIN q y ON x.area = y.area AND y.q = x.q + INTERVAL 3 MONTHS""")
def q_next_period(spark, d):
    out = jn.next_quarter(transactions(spark, d).filter(F.col("deal_type") == "sale"), ["area"], "deal_date", "price")
    return out.select("area", F.date_format("quarter", "yyyy-MM-dd").alias("quarter"), F.round("avg_now", 8).alias("avg_now"), F.round("avg_next", 8).alias("avg_next"))


@query("substring_lookup", """
WITH v AS (SELECT DISTINCT CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN lower(p_brand) WHEN p_size < 30 THEN 'the ' || p_name || ' tower' WHEN p_size < 40 THEN split_part(p_name, ' ', 2)
    ELSE upper(p_name) END AS value FROM part),
n AS (SELECT DISTINCT p_name AS hit FROM part UNION SELECT DISTINCT p_brand FROM part),
c AS (SELECT value, hit, CASE WHEN value = hit THEN 1 WHEN upper(value) = hit THEN 2 WHEN lower(value) = lower(hit) THEN 3
   WHEN length(value) >= 6 AND (contains(lower(hit), lower(value)) OR contains(lower(value), lower(hit))) THEN 4 END AS stage FROM v, n),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY stage, length(hit) DESC, hit) AS rn FROM c WHERE stage IS NOT NULL)
SELECT value, hit, stage FROM r WHERE rn = 1""")
def q_substring_lookup(spark, d):
    p, size = load_table(spark, d, "part"), F.col("p_size")
    vals = p.select(
        F.when(size < 10, F.col("p_name")).when(size < 20, F.lower("p_brand")).when(size < 30, F.concat(F.lit("the "), "p_name", F.lit(" tower")))
        .when(size < 40, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.upper("p_name")).alias("v"))
    names = p.select(F.col("p_name").alias("n")).unionByName(p.select(F.col("p_brand").alias("n")))
    return jn.substring_lookup(vals, names, "v", "n")


@query("sibling_window_join", f"""WITH {MESSAGES}
SELECT a.id AS anchor_id, b.id AS sibling_id FROM messages a JOIN messages b ON a.chat = b.chat AND a.lang = b.lang AND abs(epoch(a.ts) - epoch(b.ts)) <= 120""")
def q_sibling_window(spark, d):
    m = messages(spark, d)
    return jn.sibling_window(m, m, ["chat", "lang"], "ts", "id").select("anchor_id", "sibling_id")


@query("priority_union", """
WITH u AS (SELECT n_name AS k, 'nation' AS v, 0 AS p FROM nation WHERE n_regionkey < 3 UNION ALL SELECT DISTINCT n_name, 'supplier', 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT n_name, 'customer', 2 FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS rn FROM u)
SELECT k, v FROM r WHERE rn = 1""")
def q_priority_union(spark, d):
    n, s, c = (load_table(spark, d, t) for t in ("nation", "supplier", "customer"))
    maps = {
        0: n.filter(F.col("n_regionkey") < 3).select(F.col("n_name").alias("k"), F.lit("nation").alias("v")),
        1: s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("k"), F.lit("supplier").alias("v")).distinct(),
        2: c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("k"), F.lit("customer").alias("v")).distinct(),
    }
    return jn.priority_union(maps, "k")
