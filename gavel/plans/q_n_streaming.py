"""Streams run to completion over the given tables and compared with their batch meaning."""

from pyspark.sql import functions as F

from gavel.operators.dedup import content_hash
from gavel.plans.q_c_joins import _RULES, RULE_FIELDS, stored_rules
from gavel.plans.registry import query
from gavel.plans.roles import BOTS, INTERACTIONS, LISTINGS, interactions, listings
from gavel.sources.tables import ts
from gavel.streaming import jobs
from gavel.streaming.sources import drain_append, drain_complete, read_stream


def event_stream(spark, d):
    e = read_stream(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"), F.element_at(F.array(*[F.lit(b) for b in BOTS]), F.pmod(k, F.lit(4)) + 1).alias("bot_name"), "user_id", "ts", "event_type", k.alias("k"),
        (F.col("value") * 100).cast("int").alias("latency_ms"), F.when(F.col("event_type") == "error", "error").when(k < 10, "empty").otherwise("success").alias("outcome"))


@query("stream_events", f"""WITH {INTERACTIONS} SELECT id, event_type, user_id FROM interactions WHERE event_type IN ('view', 'purchase')""")
def q_stream_events(spark, d):
    twice = event_stream(spark, d).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return drain_append(jobs.event_bus(twice, ["view", "purchase"]).select("id", "event_type", "user_id"), "events")


@query("stream_health", f"""WITH {INTERACTIONS} SELECT bot_name, strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE outcome = 'success') AS successes, count(*) FILTER (WHERE outcome = 'empty') AS empties,
  count(*) FILTER (WHERE outcome = 'error') AS errors, round(100.0::DOUBLE * count(*) FILTER (WHERE outcome = 'success') / count(*), 1) AS success_rate_pct FROM interactions GROUP BY 1, 2""")
def q_stream_health(spark, d):
    out = drain_complete(jobs.health_windows(event_stream(spark, d)), "health")
    return out.select("bot_name", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "total", "successes", "empties", "errors", "success_rate_pct")


@query("stream_dedup", """WITH k AS (SELECT trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM documents) SELECT DISTINCT sha256(s) AS content_hash FROM k WHERE length(s) >= 30""")
def q_stream_dedup(spark, d):
    docs = read_stream(spark, d, "documents").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 45))
    return drain_append(jobs.dedup_stream(docs, content_hash("text"), "content_hash").select("content_hash"), "dedup")


@query("stream_sessions", """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS rows FROM s GROUP BY user_id, n""")
def q_stream_sessions(spark, d):
    out = drain_complete(jobs.sessions(event_stream(spark, d), ["user_id"], gap="2 hours"), "sessions")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "rows")


@query("stream_quota", f"""WITH {INTERACTIONS}, w AS (SELECT bot_name, latency_ms, outcome, unnest(range(0, 12)) AS i, ts FROM interactions), x AS (SELECT *, time_bucket(INTERVAL 5 MINUTES, ts) - i * INTERVAL 5 MINUTES AS s FROM w)
SELECT bot_name AS provider, strftime(s, '%Y-%m-%d %H:%M') AS window_start, count(*) AS requests, CAST(sum(latency_ms) AS BIGINT) AS tokens, round(100.0::DOUBLE * count(*) FILTER (WHERE outcome = 'success') / count(*), 1) AS success_pct FROM x WHERE ts < s + INTERVAL 60 MINUTES GROUP BY 1, 2""")
def q_stream_quota(spark, d):
    calls = event_stream(spark, d).select(F.col("bot_name").alias("provider"), "ts", F.col("latency_ms").alias("tokens"), (F.col("outcome") == "success").alias("success"))
    out = drain_complete(jobs.quota_windows(calls), "quota")
    return out.select("provider", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "requests", "tokens", "success_pct")


@query("stream_alert_match", f"""WITH {LISTINGS}, {_RULES}, m AS (
  SELECT uid, l.id, row_number() OVER (PARTITION BY uid ORDER BY l.id DESC) AS pick FROM rules r JOIN listings l ON
    (r.deal_type IS NULL OR r.deal_type = l.deal_type) AND (r.property_type IS NULL OR r.property_type = l.property_type) AND (r.area IS NULL OR r.area = l.area)
    AND (r.bedrooms IS NULL OR r.bedrooms = l.bedrooms) AND (coalesce(r.min_price, 0) = 0 OR l.price >= r.min_price) AND (coalesce(r.max_price, 0) = 0 OR l.price <= r.max_price) AND l.id > r.last_listing_id)
SELECT uid, id FROM m WHERE pick <= 3""")
def q_stream_alerts(spark, d):
    known = listings(spark, d).select("id", "deal_type", "property_type", "area", "bedrooms", "price")
    arrived = read_stream(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return drain_append(jobs.alert_matches(stored_rules(spark, d), arrived.join(known, "id"), "uid", RULE_FIELDS), "alerts").select("uid", "id")


_WATCH = """w0 AS (SELECT o_custkey AS user_id, o_custkey % 10 AS listing_id, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS tick, max(o_totalprice) AS price FROM orders GROUP BY ALL),
w1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, listing_id ORDER BY tick) AS rn FROM w0)"""


@query("stream_price_drop", f"""WITH RECURSIVE {_WATCH}, s AS (SELECT user_id, listing_id, 0::BIGINT AS rn, 400000.0::DOUBLE AS base, 0.0::DOUBLE AS old, NULL::DOUBLE AS price, FALSE AS hit FROM w1 WHERE rn = 1
  UNION ALL SELECT w.user_id, w.listing_id, w.rn, CASE WHEN w.price < s.base AND (s.base - w.price) / s.base * 100 >= 10 THEN w.price ELSE s.base END, s.base, w.price, w.price < s.base AND (s.base - w.price) / s.base * 100 >= 10 FROM s JOIN w1 w ON w.user_id = s.user_id AND w.listing_id = s.listing_id AND w.rn = s.rn + 1)
SELECT user_id, listing_id, old AS old_price, price AS new_price, round((old - price) / old * 100, 8) AS drop_pct FROM s WHERE hit""")
def q_stream_drop(spark, d):
    o = read_stream(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 10).alias("listing_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"),
        F.lit(400000.0).alias("baseline_price"), F.lit(10.0).alias("target_drop_percent"))
    out = drain_append(jobs.price_drops(o, tick_seconds=86400), "drops")
    return out.select("user_id", "listing_id", "old_price", "new_price", F.round("drop_pct", 8).alias("drop_pct"))


@query("stream_cooldown", """WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type AS trigger, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS t FROM events),
f AS (SELECT user_id, trigger, min(t) AS t FROM e GROUP BY ALL UNION ALL SELECT f.user_id, f.trigger, n.t FROM f JOIN LATERAL (SELECT min(e.t) AS t FROM e WHERE e.user_id = f.user_id AND e.trigger = f.trigger AND e.t >= f.t + 86400) n ON TRUE WHERE n.t IS NOT NULL)
SELECT user_id, trigger, strftime(to_timestamp(t)::TIMESTAMP, '%Y-%m-%d %H:%M') AS fired_at FROM f""")
def q_stream_cooldown(spark, d):
    e = event_stream(spark, d).select("user_id", F.col("event_type").alias("trigger"), "ts")
    out = drain_append(jobs.cooldown(e, 24), "cooldown")
    return out.select("user_id", "trigger", F.date_format("fired_at", "yyyy-MM-dd HH:mm").alias("fired_at"))


@query("stream_freshness", """WITH l AS (SELECT event_type, user_id % 5 AS g, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx, user_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_seen FROM l WHERE CAST(floor(epoch(nx)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) >= 172800
UNION ALL SELECT CAST(user_id AS VARCHAR), strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events GROUP BY user_id HAVING CAST(floor(epoch(max(ts))) AS BIGINT) + 172800 <= (SELECT epoch(max(ts)) FROM events) - 3600""")
def q_stream_freshness(spark, d):
    out = drain_append(jobs.silence_alerts(event_stream(spark, d), "user_id", 48), "silence")
    return out.select("key", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("stream_user_profile", f"""WITH {INTERACTIONS}, c AS (SELECT user_id, event_type AS k, arg_max(bot_name, (ts, id)) AS v FROM interactions GROUP BY ALL)
SELECT i.user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) FILTER (WHERE event_type <> 'click') AS total_messages, count(*) FILTER (WHERE event_type = 'click') AS total_callbacks,
  arg_max(event_type, (ts, id)) FILTER (WHERE event_type <> 'error') AS last_intent, (SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM c WHERE c.user_id = i.user_id) AS context FROM interactions i GROUP BY i.user_id""")
def q_stream_profile(spark, d):
    e = event_stream(spark, d)
    rows = e.select(
        "id", "user_id", "ts", F.when(F.col("event_type") == "click", "callback").otherwise("message").alias("action"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("intent"),
        F.col("event_type").alias("context_key"), F.col("bot_name").alias("context_value"))
    profiles = jobs.profiles(drain_append(jobs.profile_changes(rows), "profiles"))
    entries = F.transform(F.sort_array(F.map_entries("context")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return profiles.select(
        "user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")], "total_messages", "total_callbacks", "last_intent", F.array_join(entries, ",").alias("context"))


@query("stream_idempotency", f"""WITH {INTERACTIONS} SELECT DISTINCT left(sha1(bot_name || '|' || user_id || '|' || event_type || '|' || CAST(floor(epoch(ts) / 3600) AS BIGINT) || '|'), 24) AS key FROM interactions""")
def q_stream_idempotency(spark, d):
    e = event_stream(spark, d)
    key = jobs.idempotency_key(F.col("bot_name"), F.col("user_id"), F.col("event_type"), F.col("ts"), bucket_seconds=3600)
    return drain_append(jobs.dedup_stream(e, key, "key").select("key"), "idempotency")


@query("stream_reengagement", f"""WITH {INTERACTIONS} SELECT user_id, bot_name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, CAST(floor((epoch_us(TIMESTAMP '2024-02-10') - epoch_us(max(ts))) / 8.64e10) AS INT) AS inactive_days FROM interactions
GROUP BY 1, 2 HAVING (epoch_us(TIMESTAMP '2024-02-10') - epoch_us(max(ts))) / 8.64e10 >= 14""")
def q_reengagement(spark, d):
    out = jobs.inactive_users(interactions(spark, d), ts("2024-02-10 00:00:00"), 14)
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("stream_totals", """SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def q_stream_totals(spark, d):
    """The stream source loses and repeats nothing."""
    return drain_complete(read_stream(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "totals")
