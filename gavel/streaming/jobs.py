"""Streaming forms of deduplication, health windows, alert matching and user state.

Every function maps a stream to a stream unless it says otherwise. Keys of the stateful
handlers (:mod:`gavel.streaming.state`) are fine-grained (user and listing, user and trigger) and dealt to ``slots``
by hash. A batch rewrites the entries of every slot it touches: take more slots where keys are millions and batches
small. Their number is part of a checkpoint; a query that is started again must keep it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.aggregates import rate_pct
from gavel.operators.joins import rule_match
from gavel.streaming.state import Cooldown, NewestMatches, PriceDrops, ProfileChanges, Silence

SLOTS = 512


def _in_slots(rows: DataFrame, keys: Sequence[str], processor, schema: str, time_mode: str, slots: int) -> DataFrame:
    """``processor`` over slots of keys; its ``schema`` follows the keys in the result."""
    whole = F.to_json(F.struct(*keys))  # one text per key, nulls included
    dealt = rows.withColumn("key_text", whole).withColumn("key_slot", F.pmod(F.xxhash64("key_text"), F.lit(slots)).cast("int")).drop(*keys)
    out = dealt.groupBy("key_slot").transformWithStateInPandas(processor, f"key_text string, {schema}", "Append", time_mode)
    key = F.from_json("key_text", rows.select(*keys).schema)
    return out.withColumn("key_text", key).select("key_text.*", *[c for c in out.columns if c != "key_text"])


def event_bus(events: DataFrame, event_types: Sequence[str], event_id: str = "id", ts: str = "ts", horizon: str = "24 hours") -> DataFrame:
    """Subscribed events once each within the horizon, although delivery is at least once."""
    wanted = events.filter(F.col("event_type").isin(*event_types))
    return wanted.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([event_id])


def health_windows(interactions: DataFrame, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Health counts per bot and tumbling window. Users and percentiles are mergeable sketches of
    bounded size; the exact ones are the batch report."""
    n, ok = F.count("*"), F.count_if(F.col("outcome") == "success")
    return (
        interactions.withWatermark("ts", lateness).groupBy("bot_name", F.window("ts", window).alias("w"))
        .agg(
            n.alias("total"), ok.alias("successes"), F.count_if(F.col("outcome") == "empty").alias("empties"), F.count_if(F.col("outcome") == "error").alias("errors"), rate_pct(ok, n).alias("success_rate_pct"),
            F.approx_count_distinct("user_id").alias("users_approx"), F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 1000).alias("latency_approx"))
        .select("bot_name", F.col("w.start").alias("window_start"), "total", "successes", "empties", "errors", "success_rate_pct", "users_approx", "latency_approx")
    )


def dedup_stream(rows: DataFrame, key: Column, name: str, ts: str = "ts", horizon: str = "7 days") -> DataFrame:
    """First row of every key within the horizon; rows without a key are dropped."""
    keyed = rows.withColumn(name, key).filter(F.col(name).isNotNull())
    return keyed.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([name])


def sessions(rows: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "2 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Activity sessions closed by a gap."""
    return (
        rows.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("s"))
        .agg(F.count("*").alias("rows")).select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "rows"))


def quota_windows(calls: DataFrame, ts: str = "ts", length: str = "1 hour", slide: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    """Requests and tokens per provider in sliding windows."""
    return (
        calls.withWatermark(ts, lateness).groupBy("provider", F.window(ts, length, slide).alias("w"))
        .agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.count_if("success").alias("ok"))
        .select("provider", F.col("w.start").alias("window_start"), "requests", "tokens", rate_pct(F.col("ok"), F.col("requests")).alias("success_pct")))


def idempotency_key(bot: Column, user: Column, action: Column, ts: Column, extra: Column | None = None, bucket_seconds: int = 60) -> Column:
    """First 24 hex digits of SHA-1('bot|user|action|time bucket|extra')."""
    bucket = F.floor(F.unix_seconds(ts.cast("timestamp")) / bucket_seconds).cast("string")
    tail = F.coalesce(extra, F.lit("")) if extra is not None else F.lit("")
    return F.substring(F.sha1(F.concat_ws("|", bot, user.cast("string"), action, bucket, tail)), 1, 24)


def alert_matches(rules: DataFrame, listings: DataFrame, rule_id: str, fields: Sequence[str], top: int = 3, slots: int = SLOTS) -> DataFrame:
    """Stored rules met by new listings: of every batch the newest ``top`` per rule above the rule's cursor, as ``rule_id``,
    ``id``, ``pick``. The cursor starts at the rule's ``last_listing_id`` and is kept per rule in the query's state, so a
    restarted query reports no listing twice and misses none."""
    start = F.coalesce("last_listing_id", F.lit(0)).cast("bigint")
    hits = rule_match(rules, listings, rule_id, fields, top, ranked=False).select(rule_id, F.col("id").cast("bigint").alias("id"))
    cursors = rules.select(rule_id, start.alias("last_listing_id"))
    return _in_slots(hits.join(cursors, rule_id), [rule_id], NewestMatches(top), "id bigint, pick int", "None", slots)


def profile_changes(rows: DataFrame, parts: int = 8, slots: int = SLOTS) -> DataFrame:
    """What each batch changed in the users' profiles, to be appended and read by :func:`profiles`.

    Input: id, user_id, ts, action, intent, context_key, context_value. A user's rows are dealt to ``parts`` keys by
    their id, so a user with very many rows is several keys. A batch writes what it changed, not the table.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return _in_slots(dealt, ["user_id", "part"], ProfileChanges(), f"{ProfileChanges.TOTALS}, {ProfileChanges.CONTEXT}", "None", slots)


def profiles(changes: DataFrame) -> DataFrame:
    """User profiles: first and last seen, counters, last intent, and of every context key the newest value (by time, then
    id). Totals of a part only grow, so its largest are its last."""
    at = lambda c: F.timestamp_micros(c)
    part = changes.filter(F.col("context_key").isNull()).groupBy("user_id", "part").agg(
        F.min("first_us").alias("f"), F.max("last_us").alias("l"), F.max("messages").alias("m"), F.max("callbacks").alias("c"),
        F.max(F.when(F.col("intent_us").isNotNull(), F.struct("intent_us", "intent_id", "intent"))).alias("i"))
    totals = part.groupBy("user_id").agg(
        at(F.min("f")).alias("first_seen"), at(F.max("l")).alias("last_seen"), F.sum("m").alias("total_messages"), F.sum("c").alias("total_callbacks"), F.max("i")["intent"].alias("last_intent"))
    newest = changes.filter(F.col("context_key").isNotNull()).groupBy("user_id", "context_key").agg(F.max_by("context_value", F.struct("context_us", "context_id")).alias("v"))
    context = newest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("context_key", "v"))).alias("context"))
    return totals.join(context, "user_id", "left").withColumn("context", F.coalesce("context", F.create_map().cast("map<string,string>")))


def price_drops(prices: DataFrame, tick_seconds: int = 60, lateness: str = "1 day", slots: int = SLOTS) -> DataFrame:
    """Alerts when a watched price falls by the target percent; the baseline then becomes the new
    price. Input: user_id, listing_id, ts, price, baseline_price, target_drop_percent. The price of
    a tick is its last one, as a poll would see it."""
    doubles = {c: F.col(c).cast("double") for c in ("price", "baseline_price", "target_drop_percent")}
    rows = prices.withWatermark("ts", lateness).withColumns(doubles)
    schema = "ts timestamp, old_price double, new_price double, drop_pct double"
    return _in_slots(rows, ["user_id", "listing_id"], PriceDrops(tick_seconds), schema, "None", slots)


def cooldown(triggers: DataFrame, cooldown_hours: float, tick_seconds: int = 60, lateness: str = "1 day", slots: int = SLOTS) -> DataFrame:
    """Fire a (user, trigger) at most once per cooldown. Input: user_id, trigger, ts. Evaluation is
    per tick; the state expires when the cooldown has passed in event time."""
    rows = triggers.withWatermark("ts", lateness)
    return _in_slots(rows, ["user_id", "trigger"], Cooldown(int(cooldown_hours * 3600), tick_seconds), "fired_at timestamp", "EventTime", slots)


def silence_alerts(rows: DataFrame, key: str, max_silence_hours: float, lateness: str = "1 hour") -> DataFrame:
    """One alert per key and silent period: no row for ``max_silence_hours`` of event time. Serves
    ingest freshness (key = source, 48 h) and re-engagement (key = user, N days). Gaps inside a batch
    are found on ordered hour marks; open silences fire by timer when the watermark passes."""
    keyed = rows.select(F.col(key).cast("string").alias("key"), "ts").withWatermark("ts", lateness).groupBy("key")
    return keyed.transformWithStateInPandas(Silence(int(max_silence_hours * 3600)), "key string, last_seen timestamp", "Append", "EventTime")


def inactive_users(interactions: DataFrame, as_of: Column, inactive_days: int, keys: Sequence[str] = ("user_id", "bot_name")) -> DataFrame:
    """Batch form of re-engagement: keys whose newest interaction is at least N days old."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 8.64e10
    return interactions.groupBy(*keys).agg(F.max("ts").alias("last_seen"), days.alias("d")).filter(F.col("d") >= inactive_days).withColumn("inactive_days", F.floor("d").cast("int")).drop("d")
