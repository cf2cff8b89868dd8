"""Product analytics: health, funnels, variants, experiments, mining, quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.exprs import half_even
from gavel.functions.scale import group_percentiles, null_safe_join
from gavel.operators.aggregates import rate_pct, small_set
from gavel.operators.dedup import streak
from gavel.operators.joins import active_next_day, first_follow



def health_daily(interactions: DataFrame, since: Column | None = None) -> DataFrame:
    """Per bot and day: counts, users, success share, latency percentiles."""
    rows = (interactions if since is None else interactions.filter(F.col("ts") > since)).withColumn("day", F.to_date("ts"))
    keys = ["bot_name", "day"]
    n = F.count("*")
    base = rows.groupBy(*keys).agg(
        n.alias("total"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("outcome") == "success").alias("successes"),
        F.count_if(F.col("outcome") == "empty").alias("empties"), F.count_if(F.col("outcome") == "error").alias("errors"),
        rate_pct(F.count_if(F.col("outcome") == "success"), n).alias("success_rate_pct"), rate_pct(F.count_if(F.col("outcome") == "empty"), n).alias("empty_pct"))
    pct = group_percentiles(rows, keys, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, "__n").drop("__n")
    return null_safe_join(base, pct, keys, "left")


def feedback_summary(feedback: DataFrame, keys: Sequence[str]) -> DataFrame:
    up, n = F.count_if(F.col("rating") == 1), F.count("*")
    return feedback.groupBy(*keys).agg(
        n.alias("total"), up.alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"), F.count_if(F.col("rating") == 0).alias("neutral"), rate_pct(up, n).alias("satisfaction_pct"))


def funnel(events: DataFrame, keys: Sequence[str], steps: Sequence[str]) -> DataFrame:
    """Distinct users per step and their share of the first step; order of steps in time is not
    required. One row per step."""
    per = events.filter(F.col("event_type").isin(*steps)).groupBy(*keys, "event_type").agg(F.count_distinct("user_id").alias("users"))
    wide = per.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("event_type") == s, F.col("users"))), F.lit(0)).alias(f"__{i}") for i, s in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("step"), F.col(f"__{i}").alias("users")) for i, s in enumerate(steps)])
    return wide.select(*keys, F.col("__0").alias("__top"), F.explode(rows).alias("r")).select(
        *keys, "r.*", F.coalesce(half_even(F.try_divide(F.col("r.users") * 100.0, F.col("__top")), 2), F.lit(0.0)).alias("pct_of_top"))


def time_to_first_action(events: DataFrame, start: str, follow: str, within: str = "1 HOUR") -> DataFrame:
    """Median milliseconds from a user's first ``start`` to the first ``follow`` in the window."""
    pairs = first_follow(events, "user_id", "ts", F.col("event_type") == start, F.col("event_type") == follow, within)
    ms = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1000.0
    return group_percentiles(pairs.withColumn("ms", ms), [], "ms", {"p50_ms": 0.5}, "samples")


def actions_per_session(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average number of events per user and day."""
    days = events.groupBy(*keys, "user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("c"))
    return days.groupBy(*keys).agg(F.avg("c").alias("value"), F.count("*").alias("samples"))


def error_rate(events: DataFrame, error: str, keys: Sequence[str] = ()) -> DataFrame:
    return events.groupBy(*keys).agg((F.count_if(F.col("event_type") == error) / F.count("*")).alias("value"), F.count("*").alias("samples"))


def completion_rate(events: DataFrame, start: str, done: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of users with ``start`` who also have ``done`` (any order)."""
    users = events.groupBy(*keys, "user_id").agg(F.bool_or(F.col("event_type") == start).alias("s"), F.bool_or(F.col("event_type") == done).alias("e"))
    s = users.filter("s").groupBy(*keys).agg((F.count_if("e") / F.count("*")).alias("value"), F.count("*").alias("samples"))
    return s


def return_rate(events: DataFrame) -> DataFrame:
    """Users who were active on some day and again on the next, over all users."""
    back = active_next_day(events, "user_id", F.to_date("ts")).select("user_id").distinct().withColumn("r", F.lit(1))
    users = events.select("user_id").distinct().join(back, "user_id", "left")
    return users.agg((F.count("r") / F.count("*")).alias("value"), F.count("*").alias("samples"))


def compare_variants(metric: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(B − A)/|A| in percent from rows (variant, value, samples); NULL when A is zero."""
    side = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    wide = metric.groupBy(*keys).agg(side(a, "value").alias("value_a"), side(b, "value").alias("value_b"), side(a, "samples").alias("samples_a"), side(b, "samples").alias("samples_b"))
    return wide.withColumn("delta_pct", F.when(F.col("value_a") != 0, half_even((F.col("value_b") - F.col("value_a")) / F.abs("value_a") * 100.0, 2)))


LOWER_IS_BETTER = ["error_rate", "time_to_first_action"]


def rollback_decision(daily: DataFrame, min_samples: int = 20, threshold_pct: float = 20.0, bad_days: int = 2) -> DataFrame:
    """Newest decision per (feature, metric): inconclusive, ok, bad, or rollback after enough
    consecutive bad days. ``daily``: feature, metric, day, delta_pct, samples_a, samples_b."""
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("delta_pct") >= threshold_pct).otherwise(F.col("delta_pct") <= -threshold_pct)
    thin = F.col("delta_pct").isNull() | (F.col("samples_a") < min_samples) | (F.col("samples_b") < min_samples)
    judged = daily.withColumn("decision", F.when(thin, "inconclusive").when(worse, "bad").otherwise("ok"))
    keys = ["feature", "metric"]
    newest = judged.groupBy(*keys).agg(F.max_by(F.struct("decision", "delta_pct"), "day").alias("__l"), F.max("day").alias("day"))
    run = streak(judged, keys, "day", F.col("decision") == "bad", "consecutive_bad")
    j = null_safe_join(newest, run, keys)
    last = F.col("__l.decision")
    return j.select(*keys, "day", F.col("__l.delta_pct").alias("delta_pct"), "consecutive_bad", F.when((last == "bad") & (F.col("consecutive_bad") >= bad_days), "rollback").otherwise(last).alias("decision"))


def variant_bucket(user_id: Column, experiment_key: Column) -> Column:
    """0..9999 from the first eight hex digits of SHA-1('user:experiment')."""
    h = F.sha1(F.concat_ws(":", user_id.cast("string"), experiment_key))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(10000))


def assign_variant(user_id: Column, experiment_key: Column, split: Column) -> Column:
    """Variant of a ``map<variant, share>`` split: cumulative shares in alphabetical order, the
    last variant when the shares do not reach the bucket; 'A' for an empty split."""
    pct = variant_bucket(user_id, experiment_key) / 100.0
    entries = F.sort_array(F.map_entries(split))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("string").alias("pick"))

    def step(acc: Column, e: Column) -> Column:
        cum = acc["cum"] + e["value"] * 100.0
        return F.struct(cum.alias("cum"), F.coalesce(acc["pick"], F.when(pct < cum, e["key"])).alias("pick"))

    picked = F.aggregate(entries, start, step)["pick"]
    return F.coalesce(picked, F.try_element_at(entries, F.lit(-1))["key"], F.lit("A"))


def experiment_results(assignments: DataFrame, outcomes: DataFrame, primary: str, follow_up: str, negative: str) -> DataFrame:
    """Per experiment and variant: assigned users and distinct users per outcome."""
    keys = ["experiment_id", "variant"]
    a = assignments.groupBy(*keys).agg(F.count_distinct("user_id").alias("assigned"))
    per = outcomes.groupBy(*keys, "outcome_type").agg(F.count_distinct("user_id").alias("u"), F.max("ts").alias("t"))
    pick = lambda o: F.coalesce(F.max(F.when(F.col("outcome_type") == o, F.col("u"))), F.lit(0))
    o = per.groupBy(*keys).agg(pick(primary).alias("primary_succ"), pick(follow_up).alias("follow_up_succ"), pick(negative).alias("negative"), F.max("t").alias("last_event"))
    j = a.join(o, keys, "full_outer")
    return j.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("assigned", "primary_succ", "follow_up_succ", "negative")], "last_event")


def experiment_decision(
    results: DataFrame, experiments: DataFrame, as_of: Column, min_samples: int = 100, z_stop: float = -2.0, max_p: float = 0.05, min_lift: float = 0.05, abandon_days: int = 7
) -> DataFrame:
    """Continue, paused, winner or abandoned per experiment.

    ``experiments``: experiment_id, default_variant, started_at. The approximate p-value is
    exp(−χ²/2), kept under the name ``p_approx``.
    """
    age = lambda c: F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))) / 8.64e10)
    head = results.groupBy("experiment_id").agg(
        F.count("*").alias("variants"), F.min("variant").alias("__first"), F.collect_set("variant").alias("__names"), F.min("assigned").alias("min_assigned"), F.max("last_event").alias("last_event"))
    e = experiments.join(head, "experiment_id").withColumn(
        "control", F.when(F.array_contains("__names", F.col("default_variant")), F.col("default_variant")).otherwise(F.col("__first"))).drop("__names", "__first")
    rate = F.coalesce(F.try_divide(F.col("primary_succ").cast("double"), F.col("assigned").cast("double")), F.lit(0.0))
    r = results.withColumn("rate", rate).withColumn("se2", F.coalesce(F.try_divide(F.greatest(F.col("rate") * (1 - F.col("rate")), F.lit(0.0)), F.col("assigned").cast("double")), F.lit(0.0)))
    ctrl = r.select("experiment_id", F.col("variant").alias("control"), F.col("assigned").alias("a_n"), F.col("primary_succ").alias("a_s"), F.col("rate").alias("a_rate"), F.col("se2").alias("a_se2"))
    base = e.join(ctrl, ["experiment_id", "control"])
    se = F.sqrt(F.col("se2") + F.col("a_se2"))
    rivals = r.join(base.select("experiment_id", "control", "a_rate", "a_se2"), "experiment_id").filter(F.col("variant") != F.col("control")).withColumn(
        "z", F.when(se > 0, (F.col("rate") - F.col("a_rate")) / se).otherwise(0.0))
    worst = rivals.filter(F.col("z") < z_stop).groupBy("experiment_id").agg(F.min("variant").alias("paused_variant"))
    better = rivals.filter(F.col("rate") > F.col("a_rate")).groupBy("experiment_id").agg(
        F.min_by(F.struct("variant", "assigned", "primary_succ", "rate"), F.struct(-F.col("rate"), F.col("variant"))).alias("best"))
    j = base.join(worst, "experiment_id", "left").join(better, "experiment_id", "left")
    bn, bs, an, a_s = F.col("best.assigned").cast("double"), F.col("best.primary_succ").cast("double"), F.col("a_n").cast("double"), F.col("a_s").cast("double")
    succ, total = a_s + bs, an + bn
    fail = total - succ
    cell = lambda o, n, m: F.try_divide((o - n * m / total) * (o - n * m / total), n * m / total)
    chi = F.when((succ > 0) & (fail > 0), cell(a_s, an, succ) + cell(an - a_s, an, fail) + cell(bs, bn, succ) + cell(bn - bs, bn, fail)).otherwise(F.when(bn.isNotNull(), 0.0))
    lift = F.when(F.col("a_rate") > 0, (F.col("best.rate") - F.col("a_rate")) / F.col("a_rate")).otherwise(F.when(F.col("best").isNotNull(), F.lit(float("inf"))))
    out = j.withColumn("chi2", chi).withColumn("p_approx", F.exp(-F.col("chi2") / 2)).withColumn("lift", lift)
    abandoned = (age(F.col("started_at")) >= abandon_days) & ~F.coalesce(age(F.col("last_event")) <= abandon_days, F.lit(False))
    enough = (F.col("variants") >= 2) & (F.col("min_assigned") >= min_samples)
    wins = F.col("best").isNotNull() & (F.col("p_approx") < max_p) & (F.col("lift") >= min_lift)
    decision = F.when(abandoned, "abandoned").when(~enough, "continue").when(F.col("paused_variant").isNotNull(), "paused").when(wins, "winner").otherwise("continue")
    return out.select(
        "experiment_id", decision.alias("decision"), F.when(decision == "winner", F.col("best.variant")).alias("winner"), F.when(decision == "paused", F.col("paused_variant")).alias("paused_variant"), "chi2", "p_approx", "lift")


def bandit_weights(decisions: DataFrame, since: Column) -> DataFrame:
    """Arm weights avg·(1 + ln(n+1)/10), clamped to .1–5, over the trailing window."""
    keys = ["strategy_family", "task_type", "strategy"]
    scored = F.col("outcome_score").isNotNull()
    return (
        decisions.filter(F.col("decided_at") >= since).groupBy(*keys)
        .agg(F.count_if(scored).alias("trials"), F.count_if(F.col("outcome_score") >= 0.7).alias("wins"), F.avg("outcome_score").alias("avg_score"), F.avg("latency_ms").alias("avg_latency_ms"))
        .filter(F.col("trials") > 0)
        .withColumn("weight", F.greatest(F.lit(0.1), F.least(F.lit(5.0), F.col("avg_score") * (1 + F.log(F.col("trials") + 1) / 10.0)))))


def best_arm(weights: DataFrame) -> DataFrame:
    """Arm with the highest avg_score·weight per family and task; ties to the first name."""
    value = F.col("avg_score") * F.greatest("weight", F.lit(0.01))
    return weights.groupBy("strategy_family", "task_type").agg(F.min_by("strategy", F.struct(-value, F.col("strategy"))).alias("strategy"))


def issue_key(text: Column) -> Column:
    """Lower-cased, blank-collapsed, letters and digits only, at most 80 characters of key."""
    t = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    return F.nullif(F.substring(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_\s]", ""), 1, 80), F.lit(""))


def issue_clusters(interactions: DataFrame, feedback: DataFrame, since: Column, slow_ms: int = 2000, min_users: int = 5) -> DataFrame:
    """Empty, error, slow and badly rated interactions grouped by key, with severity."""
    i = interactions.filter(F.col("ts") >= since)
    msg = issue_key(F.col("user_message"))
    part = lambda df, kind, key: df.select(F.lit(kind).alias("issue_type"), key.alias("cluster_key"), "user_id", "bot_name")
    empty = part(i.filter((F.col("outcome") == "empty") & (F.length("user_message") > 1)), "empty_results", msg)
    error = part(i.filter((F.col("outcome") == "error") & F.col("error_msg").isNotNull()), "errors", issue_key(F.col("error_msg")))
    slow = part(i.filter((F.col("latency_ms") > slow_ms) & (F.col("outcome") == "success")), "slow_queries", F.coalesce(F.substring(F.nullif(F.col("query_type"), F.lit("")), 1, 80), msg))
    bad = feedback.filter((F.col("rating") == -1) & (F.col("ts") >= since)).select(F.col("interaction_id").alias("id"), F.col("user_id").alias("fu"), F.col("bot_name").alias("fb"))
    neg = interactions.join(bad, "id").select(F.lit("bad_responses").alias("issue_type"), msg.alias("cluster_key"), F.col("fu").alias("user_id"), F.col("fb").alias("bot_name"))
    rows = empty.unionByName(error).unionByName(slow).unionByName(neg).filter(F.col("cluster_key").isNotNull())
    g = rows.groupBy("issue_type", "cluster_key").agg(F.count_distinct("user_id").alias("affected"), F.count("*").alias("samples"), F.min("bot_name").alias("bot_name")).filter(F.col("affected") >= min_users)
    bad_kind = F.col("issue_type") == "bad_responses"
    return g.withColumn(
        "severity",
        F.when(bad_kind, F.when(F.col("affected") >= 10, "high").otherwise("medium")).when(F.col("affected") >= 50, "high").when(F.col("affected") >= 15, "medium").otherwise("low"),
    ).withColumn("fingerprint", F.sha1(F.concat_ws("|", "issue_type", "cluster_key")))


def empty_query_mining(interactions: DataFrame, known: DataFrame, since: Column, limit: int | None, min_count: int = 5, chars: tuple[int, int] = (3, 80)) -> DataFrame:
    """Repeated queries without answer that no known alias covers, most frequent first. Messages outside ``chars`` characters are no
    queries: that rule belongs to the report, as does its ``limit`` (None: all)."""
    q = F.lower(F.trim("user_message"))
    rows = interactions.filter((F.col("outcome") == "empty") & (F.col("ts") >= since) & F.length("user_message").between(*chars)).withColumn("q", q)
    counts = rows.groupBy("q").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).join(known.select(F.col("key").alias("q")).distinct(), "q", "left_anti")
    found = counts.join(small_set(rows, ["q"], "bot_name", "bots"), "q").orderBy(F.col("n").desc(), "q")
    return found if limit is None else found.limit(limit)


def quota_usage(calls: DataFrame, limits: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    """Requests and tokens per provider in the window and the use of the tightest limit.

    ``limits``: provider, rpm, tpm, rpd, tpd (NULL or 0 = none).
    """
    since = as_of - F.expr(f"INTERVAL {window_minutes} MINUTES")
    used = calls.filter((F.col("called_at") >= since) & (F.col("called_at") <= as_of)).groupBy("provider").agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens_total"), F.count_if("success").alias("__ok"))
    minutes, days = max(window_minutes, 1.0), max(window_minutes / 1440.0, 1.0 / 24.0)
    req, tok = F.coalesce("requests", F.lit(0)), F.coalesce("tokens_total", F.lit(0))
    cap = lambda value, limit, span: F.when(F.col(limit) > 0, F.struct((value / (F.col(limit) * F.lit(span))).alias("pct"), F.lit(limit).alias("basis")))
    options = F.array_compact(F.array(cap(req, "rpm", minutes), cap(tok, "tpm", minutes), cap(req, "rpd", days), cap(tok, "tpd", days)))
    top = F.aggregate(options, F.struct(F.lit(None).cast("double").alias("pct"), F.lit(None).cast("string").alias("basis")),
                      lambda a, x: F.when(a["pct"].isNull() | (x["pct"] > a["pct"]), x).otherwise(a))
    return limits.join(used, "provider", "left").select(
        "provider", req.alias("requests"), tok.alias("tokens_total"), half_even(req / (window_minutes * 1.0), 3).alias("rpm_used"),
        F.coalesce(F.try_divide(F.col("__ok").cast("double"), F.col("requests").cast("double")), F.lit(1.0)).alias("success_rate"),
        F.coalesce(half_even(top["pct"] * 100.0, 2), F.lit(0.0)).alias("pct_to_limit"), top["basis"].alias("limit_basis"))


def lead_metrics(leads: DataFrame, as_of: Column) -> DataFrame:
    """Leads in the last day and week, daily average, and the silent-day alert."""
    c = F.col("created_at")
    out = leads.agg(F.count_if(c > as_of - F.expr("INTERVAL 24 HOURS")).alias("leads_24h"), F.count_if(c > as_of - F.expr("INTERVAL 7 DAYS")).alias("leads_7d"))
    return out.withColumn("avg_7d", half_even(F.col("leads_7d") / 7.0, 2)).withColumn("is_silent", (F.col("leads_24h") == 0) & (F.col("leads_7d") / 7.0 >= 1))


def top_by_leads(leads: DataFrame, listings: DataFrame, key: str, n: int) -> DataFrame:
    j = leads.join(listings.select(F.col("id").alias("listing_id"), key), "listing_id")
    return j.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("leads")).orderBy(F.col("leads").desc(), key).limit(n)


AUDIT_FIELDS = ("area", "building", "type", "deal", "price")


def audit_scorecard(verdicts: DataFrame, min_confidence: int = 60) -> DataFrame:
    """Accuracy of judged rows: a row is right when at least 4 of 5 fields are; per-field shares.

    Columns: confidence and ``<field>_ok`` (NULL = not judged).
    """
    sure = F.coalesce(F.col("confidence") >= min_confidence, F.lit(False))
    right = sum((F.when(F.col(f"{f}_ok"), 1).otherwise(0) for f in AUDIT_FIELDS), F.lit(0)) >= 4
    share = lambda f: half_even(F.try_divide(F.count_if(sure & F.col(f"{f}_ok")) * 100.0, F.count_if(sure & F.col(f"{f}_ok").isNotNull())), 2)
    ok, total = F.count_if(sure & right), F.count_if(sure)
    out = verdicts.agg(
        ok.alias("ok"), (total - ok).alias("bug"), F.count_if(~sure).alias("unable"), half_even(F.try_divide(ok * 100.0, total), 2).alias("overall_pct"), *[share(f).alias(f"{f}_pct") for f in AUDIT_FIELDS])
    known = F.array_compact(F.array(*[F.col(f"{f}_pct") for f in AUDIT_FIELDS]))
    avg = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return out.withColumn("avg_field_pct", half_even(avg, 2))
