"""Product analytics and experiments."""

from pyspark.sql import functions as F

from gavel.operators import product as pr
from gavel.plans.registry import query
from gavel.plans.roles import BOTS, INTERACTIONS, LISTINGS, interactions, listings
from gavel.sources.tables import load_table, ts

_PCT = ", ".join(f"round(quantile_cont(latency_ms, {p}), 4) AS {n}" for n, p in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)))


@query("health_daily", f"""WITH {INTERACTIONS}
SELECT bot_name, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE outcome = 'success') AS successes, count(*) FILTER (WHERE outcome = 'empty') AS empties,
  count(*) FILTER (WHERE outcome = 'error') AS errors, round(100.0::DOUBLE * count(*) FILTER (WHERE outcome = 'success') / count(*), 1) AS success_rate_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE outcome = 'empty') / count(*), 1) AS empty_pct, {_PCT}
FROM interactions GROUP BY bot_name, CAST(ts AS DATE)""")
def q_health_daily(spark, d):
    h = pr.health_daily(interactions(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return h.withColumns({c: F.round(c, 4) for c in ("p50_ms", "p95_ms", "p99_ms")})


_FEEDBACK = """feedback AS (SELECT id AS interaction_id, user_id, bot_name, ts, k % 3 - 1 AS rating FROM interactions WHERE event_type = 'click')"""


def feedback(spark, d):
    return interactions(spark, d).filter(F.col("event_type") == "click").select(
        F.col("id").alias("interaction_id"), "user_id", "bot_name", "ts", (F.pmod("k", F.lit(3)) - 1).alias("rating"))


@query("feedback_summary", f"""WITH {INTERACTIONS}, {_FEEDBACK}
SELECT bot_name, count(*) AS total, count(*) FILTER (WHERE rating = 1) AS positive, count(*) FILTER (WHERE rating = -1) AS negative, count(*) FILTER (WHERE rating = 0) AS neutral,
  round(100.0::DOUBLE * count(*) FILTER (WHERE rating = 1) / count(*), 1) AS satisfaction_pct FROM feedback GROUP BY bot_name""")
def q_feedback(spark, d):
    return pr.feedback_summary(feedback(spark, d), ["bot_name"])


def _users(e: str) -> str:
    return f"count(DISTINCT user_id) FILTER (WHERE event_type = '{e}')"


@query("funnel", f"""WITH {INTERACTIONS}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {_users('view')} AS v, {_users('click')} AS c, {_users('purchase')} AS p FROM interactions GROUP BY 1)
SELECT day, 1 AS position, 'view' AS step, v AS users, CASE WHEN v > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS pct_of_top FROM d
UNION ALL SELECT day, 2, 'click', c, coalesce(round_even(c * 100.0::DOUBLE / nullif(v, 0), 2), 0) FROM d UNION ALL SELECT day, 3, 'purchase', p, coalesce(round_even(p * 100.0::DOUBLE / nullif(v, 0), 2), 0) FROM d""")
def q_funnel(spark, d):
    e = load_table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return pr.funnel(e, ["day"], ["view", "click", "purchase"])


@query("time_to_first_action", """
WITH m AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT e.user_id, t0, min(e.ts) AS t1 FROM events e JOIN m ON m.user_id = e.user_id WHERE event_type = 'click' AND e.ts >= t0 AND e.ts < t0 + INTERVAL 48 HOURS GROUP BY 1, 2)
SELECT round(quantile_cont((epoch_us(t1) - epoch_us(t0)) / 1000.0::DOUBLE, 0.5), 3) AS p50_ms, count(*) AS samples FROM c""")
def q_ttfa(spark, d):
    return pr.time_to_first_action(load_table(spark, d, "events"), "view", "click", "48 HOURS").select(F.round("p50_ms", 3).alias("p50_ms"), "samples")


@query("actions_per_session", """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS c FROM events GROUP BY ALL) SELECT round(avg(c), 6) AS value, count(*) AS samples FROM s""")
def q_aps(spark, d):
    return pr.actions_per_session(load_table(spark, d, "events")).withColumn("value", F.round("value", 6))


@query("error_rate", """SELECT round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS value, count(*) AS samples FROM events""")
def q_error_rate(spark, d):
    return pr.error_rate(load_table(spark, d, "events"), "error").withColumn("value", F.round("value", 6))


@query("completion_rate", """WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-29'), m AS (SELECT DISTINCT user_id FROM w WHERE event_type = 'view'), x AS (SELECT DISTINCT user_id FROM w WHERE event_type = 'purchase')
SELECT round(count(DISTINCT x.user_id) / count(DISTINCT m.user_id), 6) AS value, count(DISTINCT m.user_id) AS samples FROM m LEFT JOIN x USING (user_id)""")
def q_completion(spark, d):
    e = load_table(spark, d, "events").filter(F.col("ts") >= ts("2024-01-29 00:00:00"))
    return pr.completion_rate(e, "view", "purchase").withColumn("value", F.round("value", 6))


@query("return_rate", """WITH w AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE ts >= TIMESTAMP '2024-01-28')
SELECT round(count(DISTINCT b.user_id) / count(DISTINCT a.user_id), 6) AS value, count(DISTINCT a.user_id) AS samples FROM w a LEFT JOIN w b ON b.user_id = a.user_id AND b.d = a.d + 1""")
def q_return_rate(spark, d):
    return pr.return_rate(load_table(spark, d, "events").filter(F.col("ts") >= ts("2024-01-28 00:00:00"))).withColumn("value", F.round("value", 6))


_VARIANT = """ev AS (SELECT *, CASE WHEN ('0x' || left(sha1(user_id || ':ui'), 8))::BIGINT % 10000 / 100.0::DOUBLE < 30 THEN 'A' WHEN ('0x' || left(sha1(user_id || ':ui'), 8))::BIGINT % 10000 / 100.0::DOUBLE < 80 THEN 'B' ELSE 'C' END AS variant FROM events)"""


def variants(spark, d):
    e = load_table(spark, d, "events")
    split = F.create_map(F.lit("B"), F.lit(0.5), F.lit("A"), F.lit(0.3), F.lit("C"), F.lit(0.2))
    return e.withColumn("variant", pr.assign_variant(F.col("user_id"), F.lit("ui"), split))


@query("assign_variant", f"""WITH {_VARIANT} SELECT DISTINCT user_id, variant FROM ev""")
def q_assign(spark, d):
    return variants(spark, d).select("user_id", "variant").distinct()


_DELTA = """m AS (SELECT ['resale', 'analytics', 'roi', 'hub'][CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1] AS feature, CAST(ts AS DATE) AS day, 'error_rate' AS metric, variant, count(*) FILTER (WHERE event_type = 'error') / count(*) AS value, count(*) AS samples FROM ev GROUP BY ALL),
w AS (SELECT feature, day, metric, max(value) FILTER (WHERE variant = 'A') AS value_a, max(value) FILTER (WHERE variant = 'B') AS value_b, max(samples) FILTER (WHERE variant = 'A') AS samples_a, max(samples) FILTER (WHERE variant = 'B') AS samples_b FROM m GROUP BY ALL),
dl AS (SELECT *, CASE WHEN value_a <> 0 THEN round_even((value_b - value_a) / abs(value_a) * 100.0::DOUBLE, 2) END AS delta_pct FROM w)"""


def daily_delta(spark, d):
    bot = F.element_at(F.array(*[F.lit(b) for b in BOTS]), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(4)) + 1)
    e = variants(spark, d).withColumn("feature", bot).withColumn("day", F.to_date("ts")).withColumn("metric", F.lit("error_rate"))
    return pr.compare_variants(pr.error_rate(e, "error", ["feature", "day", "metric", "variant"]), "A", "B", ["feature", "day", "metric"])


@query("compare_variants", f"""WITH {_VARIANT}, {_DELTA} SELECT feature, strftime(day, '%Y-%m-%d') AS day, delta_pct, samples_a, samples_b FROM dl""")
def q_compare_variants(spark, d):
    return daily_delta(spark, d).select("feature", F.date_format("day", "yyyy-MM-dd").alias("day"), "delta_pct", "samples_a", "samples_b")


@query("rollback_decision", f"""WITH {_VARIANT}, {_DELTA}, j AS (SELECT *, CASE WHEN delta_pct IS NULL OR samples_a < 5 OR samples_b < 5 THEN 'inconclusive' WHEN delta_pct >= 5 THEN 'bad' ELSE 'ok' END AS dec FROM dl),
r AS (SELECT *, row_number() OVER (PARTITION BY feature, metric ORDER BY day DESC) AS rn, sum(CASE WHEN dec <> 'bad' THEN 1 ELSE 0 END) OVER (PARTITION BY feature, metric ORDER BY day DESC) AS br FROM j),
s AS (SELECT feature, metric, count(*) FILTER (WHERE br = 0) AS st FROM r GROUP BY feature, metric)
SELECT r.feature, r.metric, strftime(day, '%Y-%m-%d') AS day, delta_pct, st AS consecutive_bad, CASE WHEN dec = 'bad' AND st >= 2 THEN 'rollback' ELSE dec END AS decision FROM r JOIN s ON r.metric = s.metric AND r.feature = s.feature WHERE rn = 1""")
def q_rollback(spark, d):
    return pr.rollback_decision(daily_delta(spark, d), 5, 5.0, 2).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_EXP = """asg AS (SELECT DISTINCT 1 + user_id % 3 AS experiment_id, user_id, variant FROM ev), outc AS (SELECT 1 + user_id % 3 AS experiment_id, user_id, variant, event_type AS outcome_type, ts FROM ev WHERE NOT (user_id % 3 = 2 AND ts > TIMESTAMP '2024-01-12') AND NOT (user_id % 3 = 1 AND variant = 'B' AND ts > TIMESTAMP '2024-01-03')),
a AS (SELECT experiment_id, variant, count(DISTINCT user_id) AS assigned FROM asg GROUP BY ALL),
o AS (SELECT experiment_id, variant, count(DISTINCT user_id) FILTER (WHERE outcome_type = 'purchase') AS primary_succ, count(DISTINCT user_id) FILTER (WHERE outcome_type = 'click') AS follow_up_succ, count(DISTINCT user_id) FILTER (WHERE outcome_type = 'error') AS negative, max(ts) AS last_event FROM outc GROUP BY ALL),
res AS (SELECT a.experiment_id, a.variant, assigned, coalesce(primary_succ, 0) AS primary_succ, coalesce(follow_up_succ, 0) AS follow_up_succ, coalesce(negative, 0) AS negative, last_event FROM a LEFT JOIN o ON a.experiment_id = o.experiment_id AND a.variant = o.variant)"""


def results(spark, d):
    v = variants(spark, d).withColumn("experiment_id", F.pmod("user_id", F.lit(3)) + 1)
    asg = v.select("experiment_id", "user_id", "variant").distinct()
    x = F.pmod("user_id", F.lit(3))
    out = v.filter(~((x == 2) & (F.col("ts") > ts("2024-01-12 00:00:00"))) & ~((x == 1) & (F.col("variant") == "B") & (F.col("ts") > ts("2024-01-03 00:00:00")))).select(
        "experiment_id", "user_id", "variant", F.col("event_type").alias("outcome_type"), "ts")
    return pr.experiment_results(asg, out, "purchase", "click", "error")


@query("experiment_results", f"""WITH {_VARIANT}, {_EXP} SELECT experiment_id, variant, assigned, primary_succ, follow_up_succ, negative FROM res""")
def q_exp_results(spark, d):
    return results(spark, d).drop("last_event")


@query("experiment_decision", f"""WITH {_VARIANT}, {_EXP}, e AS (SELECT experiment_id, CASE WHEN experiment_id = 2 THEN 'B' ELSE 'A' END AS control, min(assigned) AS mn, max(last_event) AS le FROM res GROUP BY experiment_id),
r AS (SELECT *, primary_succ / assigned AS rate, greatest(primary_succ / assigned * (1 - primary_succ / assigned), 0) / assigned AS se2 FROM res), c AS (SELECT e.*, r.assigned AS an, r.primary_succ AS sa, r.rate AS ar, r.se2 AS as2 FROM e JOIN r ON r.experiment_id = e.experiment_id AND r.variant = e.control),
v AS (SELECT r.*, ar, CASE WHEN se2 + as2 > 0 THEN (rate - ar) / sqrt(se2 + as2) ELSE 0 END AS z FROM r JOIN c ON r.experiment_id = c.experiment_id AND r.variant <> c.control),
w AS (SELECT experiment_id, min(variant) AS paused FROM v WHERE z < -2 GROUP BY 1), b AS (SELECT experiment_id, arg_min(variant, (-rate, variant)) AS bv, arg_min(assigned, (-rate, variant))::DOUBLE AS bn, arg_min(primary_succ, (-rate, variant))::DOUBLE AS bs, max(rate) AS br FROM v WHERE rate > ar GROUP BY 1),
j AS (SELECT c.*, paused, bv, bn, bs, br, (sa + bs) AS su, (an + bn) AS tot, (an + bn - sa - bs) AS fa FROM c LEFT JOIN w USING (experiment_id) LEFT JOIN b USING (experiment_id)),
k AS (SELECT *, CASE WHEN su > 0 AND fa > 0 THEN pow(sa - an * su / tot, 2) / (an * su / tot) + pow(an - sa - an * fa / tot, 2) / (an * fa / tot) + pow(bs - bn * su / tot, 2) / (bn * su / tot) + pow(bn - bs - bn * fa / tot, 2) / (bn * fa / tot) WHEN bn IS NOT NULL THEN 0 END AS chi2 FROM j),
f AS (SELECT *, exp(-chi2 / 2) AS p, (br - ar) / ar AS lift, CASE WHEN TIMESTAMP '2024-01-31' - le > INTERVAL 8 DAYS THEN TRUE ELSE FALSE END AS stale FROM k),
d AS (SELECT *, CASE WHEN stale THEN 'abandoned' WHEN mn < 1 THEN 'continue' WHEN paused IS NOT NULL THEN 'paused' WHEN bv IS NOT NULL AND p < 0.5 AND lift >= 0.05 THEN 'winner' ELSE 'continue' END AS decision FROM f)
SELECT experiment_id, decision, CASE WHEN decision = 'winner' THEN bv END AS winner, CASE WHEN decision = 'paused' THEN paused END AS paused_variant, round(chi2, 5) AS chi2, round(p, 5) AS p_approx, round(lift, 5) AS lift FROM d""")
def q_exp_decision(spark, d):
    r = results(spark, d)
    ex = r.select("experiment_id").distinct().withColumn("default_variant", F.when(F.col("experiment_id") == 2, "B").otherwise("A")).withColumn("started_at", ts("2024-01-01 00:00:00"))
    out = pr.experiment_decision(r, ex, ts("2024-01-31 00:00:00"), 1, max_p=0.5)
    return out.withColumns({c: F.round(c, 5) for c in ("chi2", "p_approx", "lift")})


_DEC = """dec AS (SELECT bot_name AS strategy_family, CASE WHEN k < 50 THEN 'short' ELSE 'long' END AS task_type, event_type AS strategy, CASE WHEN outcome <> 'empty' THEN (k % 11) / 10.0::DOUBLE END AS outcome_score, latency_ms, ts AS decided_at FROM interactions),
bw AS (SELECT strategy_family, task_type, strategy, count(outcome_score) AS trials, count(*) FILTER (WHERE outcome_score >= 0.7) AS wins, avg(outcome_score) AS avg_score, avg(latency_ms) AS lat FROM dec WHERE decided_at >= TIMESTAMP '2024-01-17' GROUP BY ALL HAVING count(outcome_score) > 0),
ww AS (SELECT *, greatest(0.1, least(5.0, avg_score * (1 + ln(trials + 1) / 10.0::DOUBLE))) AS weight FROM bw)"""


def weights(spark, d):
    i = interactions(spark, d)
    dec = i.select(
        F.col("bot_name").alias("strategy_family"), F.when(F.col("k") < 50, "short").otherwise("long").alias("task_type"), F.col("event_type").alias("strategy"),
        F.when(F.col("outcome") != "empty", F.pmod("k", F.lit(11)) / 10.0).alias("outcome_score"), "latency_ms", F.col("ts").alias("decided_at"))
    return pr.bandit_weights(dec, ts("2024-01-17 00:00:00"))


@query("bandit_weights", f"""WITH {INTERACTIONS}, {_DEC} SELECT strategy_family, task_type, strategy, trials, wins, round(avg_score, 6) AS avg_score, round(weight, 6) AS weight FROM ww""")
def q_bandit(spark, d):
    return weights(spark, d).select("strategy_family", "task_type", "strategy", "trials", "wins", F.round("avg_score", 6).alias("avg_score"), F.round("weight", 6).alias("weight"))


@query("best_arm", f"""WITH {INTERACTIONS}, {_DEC} SELECT strategy_family, task_type, arg_min(strategy, (-avg_score * weight, strategy)) AS strategy FROM ww GROUP BY ALL""")
def q_best_arm(spark, d):
    return pr.best_arm(weights(spark, d))


@query("issue_clusters", f"""WITH {INTERACTIONS}, {_FEEDBACK}, u AS (SELECT 'empty_results' AS issue_type, lower(user_message) AS cluster_key, user_id, bot_name FROM interactions WHERE outcome = 'empty' AND ts >= TIMESTAMP '2024-01-08'
  UNION ALL SELECT 'errors', 'timeout after ' || k // 10 || ' s', user_id, bot_name FROM interactions WHERE outcome = 'error' AND ts >= TIMESTAMP '2024-01-08'
  UNION ALL SELECT 'slow_queries', CASE WHEN event_type = 'view' THEN 'browse' ELSE lower(user_message) END, user_id, bot_name FROM interactions WHERE latency_ms > 2000 AND outcome = 'success' AND ts >= TIMESTAMP '2024-01-08'
  UNION ALL SELECT 'bad_responses', lower(user_message), f.user_id, f.bot_name FROM feedback f JOIN interactions i ON i.id = f.interaction_id WHERE rating = -1 AND f.ts >= TIMESTAMP '2024-01-08'),
g AS (SELECT issue_type, cluster_key, count(DISTINCT user_id) AS affected, count(*) AS samples, min(bot_name) AS bot_name FROM u GROUP BY ALL HAVING count(DISTINCT user_id) >= 5)
SELECT *, CASE WHEN issue_type = 'bad_responses' THEN CASE WHEN affected >= 10 THEN 'high' ELSE 'medium' END WHEN affected >= 50 THEN 'high' WHEN affected >= 15 THEN 'medium' ELSE 'low' END AS severity, sha1(issue_type || '|' || cluster_key) AS fingerprint FROM g""")
def q_issues(spark, d):
    i = interactions(spark, d).withColumn("error_msg", F.when(F.col("outcome") == "error", F.concat(F.lit("Timeout  after: "), F.floor(F.col("k") / 10).cast("string"), F.lit(" s!")))).withColumn(
        "query_type", F.when(F.col("event_type") == "view", "browse"))
    return pr.issue_clusters(i, feedback(spark, d), ts("2024-01-08 00:00:00"))


@query("empty_query_mining", f"""WITH {INTERACTIONS}, c AS (SELECT lower(trim(user_message)) AS q, count(*) AS n, string_agg(DISTINCT bot_name, ',' ORDER BY bot_name) AS bots FROM interactions WHERE outcome = 'empty' AND ts >= TIMESTAMP '2024-01-02' AND length(user_message) BETWEEN 3 AND 80 GROUP BY 1 HAVING count(*) >= 5)
SELECT q, n, bots FROM c WHERE q NOT IN (SELECT DISTINCT 'find ' || event_type || ' 5' FROM events WHERE event_type IN ('view', 'click')) ORDER BY n DESC, q LIMIT 100""")
def q_empty_mining(spark, d):
    known = load_table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select(F.concat(F.lit("find "), "event_type", F.lit(" 5")).alias("key"))
    return pr.empty_query_mining(interactions(spark, d), known, ts("2024-01-02 00:00:00"), limit=100)


@query("quota_usage", f"""WITH {INTERACTIONS}, u AS (SELECT bot_name AS provider, count(*) AS requests, CAST(sum(latency_ms) AS BIGINT) AS tokens_total, count(*) FILTER (WHERE outcome = 'success') AS ok FROM interactions WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 1440 MINUTES AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1),
l AS (SELECT DISTINCT bot_name AS provider, CASE bot_name WHEN 'hub' THEN NULL ELSE 2 END AS rpm, CASE bot_name WHEN 'roi' THEN 20 END AS tpm, CASE bot_name WHEN 'resale' THEN 100 WHEN 'analytics' THEN 9000 END AS rpd, CASE bot_name WHEN 'analytics' THEN 20000 END AS tpd FROM interactions),
p AS (SELECT l.*, coalesce(requests, 0) AS r, coalesce(tokens_total, 0) AS t, ok, [coalesce(coalesce(requests, 0) / (rpm * 1440.0::DOUBLE), -1), coalesce(coalesce(tokens_total, 0) / (tpm * 1440.0::DOUBLE), -1), coalesce(coalesce(requests, 0) / (rpd * 1.0::DOUBLE), -1), coalesce(coalesce(tokens_total, 0) / (tpd * 1.0::DOUBLE), -1)] AS o FROM l LEFT JOIN u USING (provider))
SELECT provider, r AS requests, t AS tokens_total, round_even(r / 1440.0::DOUBLE, 3) AS rpm_used, round(coalesce(ok / nullif(r, 0), 1.0), 6) AS success_rate, CASE WHEN list_max(o) < 0 THEN 0.0 ELSE round_even(list_max(o) * 100.0::DOUBLE, 2) END AS pct_to_limit,
  CASE WHEN list_max(o) >= 0 THEN ['rpm', 'tpm', 'rpd', 'tpd'][list_position(o, list_max(o))] END AS limit_basis FROM p""")
def q_quota(spark, d):
    i = interactions(spark, d)
    calls = i.select(F.col("bot_name").alias("provider"), F.col("ts").alias("called_at"), F.col("latency_ms").alias("tokens"), (F.col("outcome") == "success").alias("success"))
    b = F.col("provider")
    limits = calls.select("provider").distinct().select(
        "provider", F.when(b != "hub", 2).alias("rpm"), F.when(b == "roi", 20).alias("tpm"), F.when(b == "resale", 100).when(b == "analytics", 9000).alias("rpd"), F.when(b == "analytics", 20000).alias("tpd"))
    return pr.quota_usage(calls, limits, ts("2024-01-30 00:00:00"), 1440).withColumn("success_rate", F.round("success_rate", 6))


@query("lead_metrics", """SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-29') AS leads_24h, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-23') AS leads_7d, round_even(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-23') / 7.0::DOUBLE, 2) AS avg_7d,
  count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-29') = 0 AND count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-23') / 7.0 >= 1 AS is_silent FROM events WHERE event_type = 'purchase'""")
def q_lead_metrics(spark, d):
    leads = load_table(spark, d, "events").filter(F.col("event_type") == "purchase").select(F.col("ts").alias("created_at"))
    return pr.lead_metrics(leads, ts("2024-01-30 00:00:00"))


@query("top_by_leads", f"""WITH {LISTINGS} SELECT building, count(*) AS leads FROM events JOIN listings ON listings.id = event_id WHERE event_type = 'purchase' GROUP BY building ORDER BY leads DESC, building LIMIT 10""")
def q_top_by_leads(spark, d):
    leads = load_table(spark, d, "events").filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("listing_id"))
    return pr.top_by_leads(leads, listings(spark, d), "building", 10)


@query("audit_scorecard", """WITH v AS (SELECT d.doc_id, CAST(50 + n_chars % 50 AS INT) AS confidence, quality = 1 AS a, toxic = 0 AS b, CASE WHEN lang <> 'de' THEN quality = 1 END AS c, n_chars % 4 > 0 AS e, n_chars % 7 > 0 AS f FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT *, coalesce(a::INT, 0) + coalesce(b::INT, 0) + coalesce(c::INT, 0) + coalesce(e::INT, 0) + coalesce(f::INT, 0) >= 4 AS r FROM v),
x AS (SELECT count(*) FILTER (WHERE confidence >= 60 AND r) AS ok, count(*) FILTER (WHERE confidence >= 60 AND NOT r) AS bug, count(*) FILTER (WHERE confidence < 60) AS unable, count(*) FILTER (WHERE confidence >= 60) AS t,
  round_even(count(*) FILTER (WHERE confidence >= 60 AND a) * 100.0::DOUBLE / count(a) FILTER (WHERE confidence >= 60), 2) AS area_pct, round_even(count(*) FILTER (WHERE confidence >= 60 AND b) * 100.0::DOUBLE / count(b) FILTER (WHERE confidence >= 60), 2) AS building_pct,
  round_even(count(*) FILTER (WHERE confidence >= 60 AND c) * 100.0::DOUBLE / count(c) FILTER (WHERE confidence >= 60), 2) AS type_pct, round_even(count(*) FILTER (WHERE confidence >= 60 AND e) * 100.0::DOUBLE / count(e) FILTER (WHERE confidence >= 60), 2) AS deal_pct,
  round_even(count(*) FILTER (WHERE confidence >= 60 AND f) * 100.0::DOUBLE / count(f) FILTER (WHERE confidence >= 60), 2) AS price_pct FROM s)
SELECT ok, bug, unable, round_even(ok * 100.0::DOUBLE / t, 2) AS overall_pct, area_pct, building_pct, type_pct, deal_pct, price_pct, round_even((area_pct + building_pct + type_pct + deal_pct + price_pct) / 5, 2) AS avg_field_pct FROM x""")
def q_audit_scorecard(spark, d):
    n = F.col("n_chars")
    j = load_table(spark, d, "labels").join(load_table(spark, d, "documents"), "doc_id")
    v = j.select(
        (n % 50 + 50).cast("int").alias("confidence"), (F.col("quality") == 1).alias("area_ok"), (F.col("toxic") == 0).alias("building_ok"), F.when(F.col("lang") != "de", F.col("quality") == 1).alias("type_ok"),
        (n % 4 > 0).alias("deal_ok"), (n % 7 > 0).alias("price_ok"))
    return pr.audit_scorecard(v)
