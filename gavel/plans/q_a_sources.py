"""Sources, sinks and write policies."""

from pyspark.sql import functions as F

from gavel.operators import aggregates
from gavel.plans.registry import query
from gavel.plans.roles import INTERACTIONS, interactions
from gavel.sources import sinks
from gavel.sources.tables import incremental_scan, load_table, ts


@query("load_table", """
SELECT t, n FROM (
  SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation
  UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
  UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events
  UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings
  UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark
  UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(*) FROM conversations)""")
def q_load_table(spark, d):
    from gavel.sources.tables import TABLES

    out = None
    for name in TABLES:
        one = load_table(spark, d, name).agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("incremental_scan", """
WITH state AS (
  SELECT source, max(doc_id) FILTER (WHERE lang = 'en') AS loaded_max,
         CASE WHEN source LIKE '%1' THEN 20000000 WHEN source LIKE '%2' THEN max(doc_id) + 600000 ELSE avg(doc_id) // 1 END AS stored
  FROM documents WHERE source NOT LIKE '%9' GROUP BY source),
floor AS (
  SELECT source, greatest(coalesce(loaded_max, 0),
    CASE WHEN (coalesce(loaded_max, 0) > 0 AND stored > coalesce(loaded_max, 0) + 500000) OR stored > 10000000
         THEN coalesce(loaded_max, 0) ELSE stored END) AS min_id FROM state)
SELECT d.doc_id, d.source FROM documents d LEFT JOIN floor f ON d.source = f.source WHERE d.doc_id > coalesce(f.min_id, 0)""")
def q_incremental_scan(spark, d):
    docs = load_table(spark, d, "documents").select("doc_id", "source", "lang")
    state = (
        docs.filter(~F.col("source").endswith("9"))
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("lang") == "en", F.col("doc_id"))).alias("loaded_max"),
            F.max("doc_id").alias("m"),
            F.floor(F.avg("doc_id")).alias("a"),
        )
        .select(
            "source",
            "loaded_max",
            F.when(F.col("source").endswith("1"), F.lit(20_000_000))
            .when(F.col("source").endswith("2"), F.col("m") + 600_000)
            .otherwise(F.col("a"))
            .alias("stored_offset"),
        )
    )
    return incremental_scan(docs, state, "source", "doc_id", max_offset=10_000_000).select("doc_id", "source")


_UPSERT_BASE = """
base AS (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer
         WHERE c_mktsegment <> 'BUILDING'),
upd AS (SELECT o_custkey AS k, CASE WHEN max(o_totalprice) > 300000 THEN 'VIP' END AS seg, max(o_totalprice) AS bal
        FROM orders GROUP BY o_custkey)"""

UPSERT_POLICIES = {
    "overwrite": ("CASE WHEN u.k IS NOT NULL THEN u.seg ELSE b.seg END", "CASE WHEN u.k IS NOT NULL THEN u.bal ELSE b.bal END"),
    "keep_first": ("CASE WHEN b.k IS NOT NULL THEN b.seg ELSE u.seg END", "CASE WHEN b.k IS NOT NULL THEN b.bal ELSE u.bal END"),
    "prefer_new": ("coalesce(u.seg, b.seg)", "coalesce(u.bal, b.bal)"),
    "prefer_old": ("coalesce(b.seg, u.seg)", "coalesce(b.bal, u.bal)"),
}


def _upsert_inputs(spark, d):
    base = (
        load_table(spark, d, "customer")
        .filter(F.col("c_mktsegment") != "BUILDING")
        .select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))
    )
    upd = (
        load_table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("k"))
        .agg(F.max("o_totalprice").alias("bal"))
        .select("k", F.when(F.col("bal") > 300000, "VIP").alias("seg"), "bal")
    )
    return base, upd


def _register_upsert(policy: str, seg: str, bal: str) -> None:
    @query(f"upsert_{policy}", f"""WITH {_UPSERT_BASE}
SELECT coalesce(b.k, u.k) AS k, {seg} AS seg, {bal} AS bal FROM base b FULL JOIN upd u ON b.k = u.k""")
    def plan(spark, d):
        base, upd = _upsert_inputs(spark, d)
        return sinks.upsert(base, upd, ["k"], policy)


for _policy, (_seg, _bal) in UPSERT_POLICIES.items():
    _register_upsert(_policy, _seg, _bal)


@query("upsert_merge_map", """
WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_type <> 'error' GROUP BY ALL),
b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type <> 'view' GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS name, coalesce(b.n, a.n) AS n
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def q_upsert_merge_map(spark, d):
    e = load_table(spark, d, "events")

    def counters(df):
        per = df.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("context"))

    old = counters(e.filter((F.col("ts") < ts("2024-01-20 00:00:00")) & (F.col("event_type") != "error")))
    new = counters(e.filter((F.col("ts") >= ts("2024-01-20 00:00:00")) & (F.col("event_type") != "view")))
    merged = sinks.upsert(old, new, ["user_id"], sinks.MERGE_MAP)
    return merged.select("user_id", F.explode("context").alias("name", "n"))


@query("replace_keys", """
WITH target AS (SELECT n_name AS area, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS seg, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
fresh AS (SELECT n_name AS area, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS seg, count(*) + 1000 AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 5000 GROUP BY ALL)
SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.area IS NOT DISTINCT FROM t.area AND f.seg IS NOT DISTINCT FROM t.seg)
UNION ALL SELECT * FROM fresh""")
def q_replace_keys(spark, d):
    c = load_table(spark, d, "customer")
    j = c.join(load_table(spark, d, "nation"), c.c_nationkey == F.col("n_nationkey"))
    seg = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg")
    target = j.groupBy(F.col("n_name").alias("area"), seg).agg(F.count(F.lit(1)).alias("n"))
    fresh = (
        j.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 5000))
        .groupBy(F.col("n_name").alias("area"), seg)
        .agg((F.count(F.lit(1)) + 1000).alias("n"))
    )
    return sinks.replace_keys(target, fresh, ["area", "seg"])


@query("merge_override", """
WITH base AS (SELECT n_name AS area, 'baseline' AS origin, sum(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
live AS (SELECT n_name AS area, 'live' AS origin, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey
         GROUP BY n_name HAVING avg(c_acctbal) > 4500)
SELECT area, origin, round(v, 2) AS v FROM base WHERE area NOT IN (SELECT area FROM live) UNION ALL SELECT area, origin, round(v, 2) FROM live""")
def q_merge_override(spark, d):
    n = load_table(spark, d, "nation")
    s, c = load_table(spark, d, "supplier"), load_table(spark, d, "customer")
    base = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("area")).agg(
        F.lit("baseline").alias("origin"), F.round(F.sum("s_acctbal"), 2).alias("v"))
    live = (
        c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("area"))
        .agg(F.lit("live").alias("origin"), F.round(F.sum("c_acctbal"), 2).alias("v"), F.avg("c_acctbal").alias("m"))
        .filter(F.col("m") > 4500).drop("m")
    )
    return sinks.merge_override(base, live, "area")


@query("retention", """
WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_orderkey, rn > CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 12 WHEN '3-MEDIUM' THEN 6 ELSE 0 END AS is_victim FROM r""")
def q_retention(spark, d):
    o = load_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return sinks.retention(
        o, "o_orderpriority", "o_orderstatus", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], "o_orderkey",
        {"1-URGENT": 30, "2-HIGH": 12, "3-MEDIUM": 6},
    ).select("o_orderkey", "is_victim")


@query("sync_summary", f"""WITH {INTERACTIONS}
SELECT bot_name AS channel, CAST(sum(latency_ms) AS BIGINT) AS parsed, count(*) FILTER (WHERE outcome = 'success') AS new_listings,
  count(*) FILTER (WHERE outcome = 'empty') AS duplicates, count(*) FILTER (WHERE outcome = 'error') AS errors,
  count(*) AS cycles, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_sync, max(id) AS last_id
FROM interactions WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY bot_name""")
def q_sync_summary(spark, d):
    log = interactions(spark, d).select(
        F.col("bot_name").alias("channel"), F.col("ts").alias("synced_at"), F.col("latency_ms").alias("messages_parsed"),
        (F.col("outcome") == "success").cast("int").alias("new_listings"),
        (F.col("outcome") == "empty").cast("int").alias("duplicates"),
        (F.col("outcome") == "error").cast("int").alias("errors"), F.col("id").alias("last_message_id"),
    )
    out = aggregates.sync_summary(log, ts("2024-01-15 00:00:00"))
    return out.withColumn("last_sync", F.date_format("last_sync", "yyyy-MM-dd HH:mm:ss"))
