"""Time series, forecasts, anomaly checks and effect estimates, for all keys at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.exprs import half_even
from gavel.functions.scale import group_percentiles, null_safe_join, spread
from gavel.operators.joins import next_quarter
from gavel.operators.scores import supply_tier



def weekly_series(df: DataFrame, keys: Sequence[str], day: str, psf: str, created: str | None = None, band: tuple[float, float] = (100, 20000)) -> DataFrame:
    """Week → median psf, supply and (with ``created``) a demand proxy: rows created at most 30
    days before the message date, or later."""
    rows = df.filter(F.col(day).isNotNull() & F.col(psf).between(*band)).withColumn("week", F.to_date(F.date_trunc("week", day)))
    demand = F.count("*") if created is None else F.count_if(F.col(created) >= F.date_sub(F.to_date(day), 30))
    base = rows.groupBy(*keys, "week").agg(F.count("*").alias("supply"), demand.alias("demand"))
    med = group_percentiles(rows, [*keys, "week"], psf, {"median_psf": 0.5}, "__n").drop("__n")
    return null_safe_join(base, med, [*keys, "week"])


def entity_graph(listings: DataFrame, developers: DataFrame, weekly_area: DataFrame, top_areas: int = 50, top_buildings: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes (areas with liquidity tier, buildings, developers) and edges (containment, developer).

    ``developers``: building, developer. The tier is set by the upper median of weekly supply;
    weeks per area are few, so the sorted list stays small.
    """
    supplies = weekly_area.filter(F.col("supply") > 0).groupBy("area").agg(F.sort_array(F.collect_list("supply")).alias("s"))
    tier = supplies.select("area", supply_tier(F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1)).alias("tier"))
    stats = [F.count("*").alias("listings_total"), F.avg(F.when(F.col("psf") > 0, F.col("psf"))).alias("avg_psf")]
    areas = listings.filter(F.col("area") != "").groupBy("area").agg(*stats).orderBy(F.col("listings_total").desc(), "area").limit(top_areas)
    buildings = (
        listings.filter(F.col("building") != "").groupBy("building", "area").agg(*stats)
        .orderBy(F.col("listings_total").desc(), "building", "area").limit(top_buildings)
    )
    area_id = F.concat(F.lit("area:"), "area")
    bld_id = F.concat(F.lit("building:"), "building", F.lit("@"), F.coalesce("area", F.lit("")))
    node = ["node_id", "node_type", "name", "parent_id", "listings_total", "avg_psf", "tier"]
    none = lambda t: F.lit(None).cast(t)
    a = areas.join(tier, "area", "left").select(
        area_id.alias("node_id"), F.lit("area").alias("node_type"), F.col("area").alias("name"), none("string").alias("parent_id"), "listings_total", "avg_psf", F.coalesce("tier", F.lit("D")).alias("tier"))
    extra = buildings.filter(F.col("area") != "").select("area").distinct().join(areas.select("area"), "area", "left_anti").select(
        area_id.alias("node_id"), F.lit("area").alias("node_type"), F.col("area").alias("name"), none("string").alias("parent_id"), none("bigint").alias("listings_total"), none("double").alias("avg_psf"), none("string").alias("tier"))
    b = buildings.select(bld_id.alias("node_id"), F.lit("building").alias("node_type"), F.col("building").alias("name"), F.when(F.col("area") != "", area_id).alias("parent_id"), "listings_total", "avg_psf", none("string").alias("tier"))
    dev = developers.filter(F.col("developer") != "").select("building", "developer").distinct()
    d = dev.select("developer").distinct().select(
        F.concat(F.lit("developer:"), "developer").alias("node_id"), F.lit("developer").alias("node_type"), F.col("developer").alias("name"), none("string").alias("parent_id"), none("bigint").alias("listings_total"), none("double").alias("avg_psf"), none("string").alias("tier"))
    nodes = a.unionByName(extra).unionByName(b).unionByName(d).select(*node)
    contains = buildings.filter(F.col("area") != "").select(area_id.alias("src"), bld_id.alias("dst"), F.lit("area_contains_building").alias("kind"))
    built = buildings.join(dev, "building").select(bld_id.alias("src"), F.concat(F.lit("developer:"), "developer").alias("dst"), F.lit("building_by_developer").alias("kind"))
    return nodes, contains.unionByName(built)


def ols_trend(series: DataFrame, keys: Sequence[str], day: str, value: str, min_points: int = 6) -> DataFrame:
    """Per key: slope per day, intercept at the first day, rmse, residual std, last point."""
    keys = list(keys)
    rows = series.filter(F.col(value).isNotNull())
    first = rows.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("points"), F.max_by(value, day).alias("last_value"))
    xy = null_safe_join(rows, first.filter((F.col("points") >= min_points) & (F.col("last_day") > F.col("first_day"))), keys).withColumn("__x", F.datediff(day, "first_day").cast("double"))
    fit = xy.groupBy(*keys).agg(F.regr_slope(value, "__x").alias("slope"), F.regr_intercept(value, "__x").alias("intercept"))
    resid = null_safe_join(xy, fit, keys).withColumn("__r", F.col(value) - (F.col("intercept") + F.col("slope") * F.col("__x")))
    return resid.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("slope", "intercept", "first_day", "last_day", "last_value", "points")],
        F.sqrt(F.avg(F.col("__r") * F.col("__r"))).alias("rmse"), F.stddev_pop("__r").alias("resid_std"),
    )


def ols_forecast(trend: DataFrame, horizon: int, step_days: int = 30, z: float = 1.28) -> DataFrame:
    """Horizon points ``step_days`` apart with ± z·σ bounds."""
    steps = trend.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ds", F.date_add("last_day", F.col("step") * step_days))
    yhat = F.col("intercept") + F.col("slope") * F.datediff("ds", "first_day")
    return steps.withColumn("yhat", yhat).withColumn("yhat_lower", F.col("yhat") - z * F.col("resid_std")).withColumn("yhat_upper", F.col("yhat") + z * F.col("resid_std"))


def naive_forecast(series: DataFrame, keys: Sequence[str], day: str, value: str, horizon: int, last_n: int = 12) -> DataFrame:
    """Trend over the positions of the last points with ±10 % bounds, for keys without a model."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    recent = series.filter(F.col(value).isNotNull()).withColumn("__back", F.row_number().over(w)).filter(F.col("__back") <= last_n)
    fit = recent.groupBy(*keys).agg(
        F.count("*").alias("points"), F.max(day).alias("last_day"), F.regr_slope(value, -F.col("__back")).alias("slope"), F.regr_intercept(value, -F.col("__back")).alias("at0")).filter(F.col("points") >= 2)
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    yhat = F.col("at0") + F.col("slope") * (F.col("step") - 1)
    return out.withColumn("ds", F.date_add("last_day", F.col("step") * 30)).withColumn("yhat", yhat).withColumn("yhat_lower", F.col("yhat") * 0.9).withColumn("yhat_upper", F.col("yhat") * 1.1).drop("slope", "at0")


def _positions(series: DataFrame, keys: list[str], day: str, bucket: str = "month") -> DataFrame:
    """Position ``__i`` (from 0) and number ``__n`` of a key's rows in time order: rows are numbered inside their time bucket, and buckets
    are summed up. No window holds a whole key's rows, only one row per bucket."""
    cut = series.withColumn("__tb", F.date_trunc(bucket, F.col(day)))
    over = Window.partitionBy(*keys)
    before = over.orderBy("__tb").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "__tb").agg(F.count(F.lit(1)).alias("__bn"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__bn").over(before), F.lit(0))).withColumn("__n", F.sum("__bn").over(over)).drop("__bn")
    placed = cut.withColumn("__in", F.row_number().over(Window.partitionBy(*keys, "__tb").orderBy(day)))
    return null_safe_join(placed, sizes, [*keys, "__tb"]).withColumn("__i", (F.col("__before") + F.col("__in") - 1).cast("int")).drop("__tb", "__in", "__before")


def price_forecast(series: DataFrame, keys: Sequence[str], day: str, value: str, months_ahead: int) -> DataFrame:
    """Monthly forecast on positions with a 60/40 back-test for the confidence class and bounds
    that widen from ±15 % to ±25 %. Input: one row per key and month."""
    keys = list(keys)
    y, x = F.col(value), F.col("__i").cast("double")
    pos = _positions(series.filter(y.isNotNull()), keys, day)
    split = F.greatest(F.lit(3), F.floor(F.col("__n") * 0.6))
    train = F.col("__i") < split
    fit = pos.groupBy(*keys).agg(
        F.max("__n").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icpt"), F.avg(y).alias("mean"), F.min(y).alias("low"), F.max_by(y, F.col("__i")).alias("last"),
        F.regr_slope(F.when(train, y), F.when(train, x)).alias("ts"), F.regr_intercept(F.when(train, y), F.when(train, x)).alias("ti"))
    err = null_safe_join(pos, fit.select(*keys, "ts", "ti"), keys).filter(~train & (F.col("__n") >= 6)).groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(F.col("ts") * x + F.col("ti") - y, F.lit(2)))).alias("rmse"))
    j = null_safe_join(fit, err, keys, "left")
    rmse_pct = F.when(F.col("n") < 3, 100.0).otherwise(F.coalesce(F.when(F.col("mean") > 0, F.col("rmse") / F.col("mean") * 100.0), F.lit(0.0)))
    conf = F.when((F.col("n") < 3) | (F.col("rmse_pct") > 30), "low").when(F.col("rmse_pct") > 15, "medium").otherwise("high")
    steps = j.withColumn("rmse_pct", rmse_pct).withColumn("confidence", conf).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(months_ahead))))
    point = F.when(F.col("n") < 3, F.col("last")).otherwise(F.greatest(F.col("slope") * (F.col("n") + F.col("step") - 1) + F.col("icpt"), F.col("low") * 0.5))
    widen = F.when(F.col("n") < 3, 0.15).otherwise(0.15 + 0.10 * (F.col("step") - 1) / max(months_ahead - 1, 1))
    return (
        steps.withColumn("point", point).withColumn("lower", F.col("point") * (1 - widen)).withColumn("upper", F.col("point") * (1 + widen))
        .select(*keys, "step", "point", "lower", "upper", half_even("rmse_pct", 1).alias("rmse_pct"), "confidence"))


def mape_backtest(series: DataFrame, keys: Sequence[str], ts: str, value: str, min_points: int = 40) -> DataFrame:
    """Fit on the first 70 % of a metric's history, mean absolute percentage error on the rest."""
    keys = list(keys)
    pos = _positions(series, keys, ts, "hour").filter(F.col("__n") >= min_points)
    start = null_safe_join(pos, pos.groupBy(*keys).agg(F.min(ts).alias("__t0")), keys)
    x = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__t0").cast("timestamp"))) / 1e6
    xy = start.withColumn("__x", x).withColumn("__train", F.col("__i") < F.floor(F.col("__n") * 0.7))
    on_train = lambda c: F.when(F.col("__train"), F.col(c))
    fit = xy.groupBy(*keys).agg(F.regr_slope(on_train(value), on_train("__x")).alias("__s"), F.regr_intercept(on_train(value), on_train("__x")).alias("__c"))
    test = null_safe_join(xy.filter(~F.col("__train") & (F.abs(F.col(value)) > 1e-9)), fit, keys)
    ape = F.abs((F.col(value) - (F.col("__s") * F.col("__x") + F.col("__c"))) / F.col(value)) * 100.0
    out = test.groupBy(*keys).agg(F.avg(ape).alias("mape_pct"), F.max("__n").alias("samples"))
    return out.withColumn("confidence", F.when(F.col("mape_pct") < 10, "high").when(F.col("mape_pct") < 25, "medium").otherwise("low"))


ELASTICITY = {"supply": -0.3, "demand": 0.4, "rate": -0.8}


def scenario_shift(scenario: Column) -> Column:
    """Percent shift of a scenario text such as 'supply +30%', 'demand -10%', 'rates +1%'."""
    s = F.lower(scenario)
    out = None
    for word, e in ELASTICITY.items():
        delta = F.coalesce(F.regexp_extract(s, word + r"s?\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
        out = F.when(s.contains(word), delta * e) if out is None else out.when(s.contains(word), delta * e)
    return out.otherwise(0.0)


def what_if(forecast: DataFrame, scenarios: DataFrame, key: str) -> DataFrame:
    """Forecast points shifted by each scenario of their entity (``scenarios``: key, scenario)."""
    j = forecast.join(scenarios, key).withColumn("shift_pct", scenario_shift(F.col("scenario")))
    mult = 1.0 + F.col("shift_pct") / 100.0
    return j.select(
        key, "scenario", half_even("shift_pct", 2).alias("shift_pct"), "step", "ds", half_even(F.col("yhat") * mult, 2).alias("yhat"),
        half_even(F.col("yhat_lower") * mult, 2).alias("yhat_lower"), half_even(F.col("yhat_upper") * mult, 2).alias("yhat_upper"))


def forecast_change(forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current value, last forecast point and percent change per entity."""
    last = forecast.groupBy(*keys).agg(F.max_by("yhat", "step").alias("predicted"), F.max("last_value").alias("current"))
    return last.withColumn("pct_change", F.when(F.col("current") != 0, (F.col("predicted") - F.col("current")) / F.col("current") * 100.0))


def compare_entities(changes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Winner by forecast growth for each requested pair (columns a, b)."""
    side = lambda p: changes.select(F.col(key).alias(p), F.col("pct_change").alias(f"{p}_pct"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    return j.withColumn("winner", F.when(F.col("a_pct") > F.col("b_pct"), F.col("a")).when(F.col("a_pct").isNotNull() & F.col("b_pct").isNotNull(), F.col("b")))


def zscore_anomaly(history: DataFrame, current: DataFrame, keys: Sequence[str], value: str, min_points: int = 10, limit: float = 3.0) -> DataFrame:
    """Current value of each metric against mean and population std of its history."""
    stats = history.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).filter(F.col("n") >= min_points)
    z = F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(0.0)
    return null_safe_join(current, stats, keys).withColumn("z_score", z).withColumn("is_anomaly", F.abs("z_score") > limit).withColumn("direction", F.when(F.col("z_score") > 0, "high").otherwise("low"))


def empty_rate_anomaly(interactions: DataFrame, as_of: str, lookback_days: int = 14, sigma: float = 2.0) -> DataFrame:
    """Bots whose empty-answer rate today exceeds mean + σ of the days before."""
    today = F.lit(as_of).cast("date")
    window = interactions.filter((F.col("ts") > F.date_sub(today, lookback_days).cast("timestamp_ntz")) & (F.to_date("ts") <= today))
    daily = window.groupBy("bot_name", F.to_date("ts").alias("d")).agg((F.count_if(F.col("outcome") == "empty") / F.count("*")).alias("er"))
    stats = daily.filter(F.col("d") < today).groupBy("bot_name").agg(F.avg("er").alias("mu"), F.stddev_pop("er").alias("sd"))
    pct = lambda c: F.round(F.col(c) * 100.0, 1)
    return (
        daily.filter(F.col("d") == today).join(stats, "bot_name", "left")
        .filter((F.coalesce("sd", F.lit(0.0)) > 0) & (F.col("er") > F.col("mu") + sigma * F.col("sd")))
        .select("bot_name", pct("er").alias("today_pct"), pct("mu").alias("mean_pct"), pct("sd").alias("sd_pct")))


def forecast_alerts(forecast: DataFrame, metric: str, size_limit: float, backlog_limit: float = 50_000) -> DataFrame:
    """Alerts per metric family when the forecast band crosses the family's threshold.

    ``forecast``: metric name, last_value, ds, yhat_lower, yhat_upper.
    """
    name = F.lower(F.col(metric))
    f = forecast.withColumn(
        "__limit",
        F.when(name.contains("size_mb"), F.lit(float(size_limit))).when(name.startswith("staging.pending"), F.lit(float(backlog_limit))).when(name.contains("quota_used_pct"), 90.0))
    s = f.groupBy(metric).agg(
        F.max("last_value").alias("current"), F.min("yhat_lower").alias("low"), F.max("yhat_upper").alias("high"), F.min_by("ds", F.struct("yhat_lower", "ds")).alias("low_at"),
        F.min(F.when(F.col("yhat_upper") > F.col("__limit"), F.col("ds"))).alias("over_at"))
    name, cur = F.lower(F.col(metric)), F.col("current")
    rule = lambda cond, kind, sev, when: F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(sev).alias("severity"), when.alias("when")))
    accuracy = name.contains("accuracy") | name.contains("success_rate") | name.contains("alive_ratio")
    never = F.lit(None).cast("date")
    rules = F.array_compact(F.array(
        rule(accuracy & (F.col("low") < cur - 2.0), "accuracy_drop", "HIGH", F.col("low_at")),
        rule(name.contains("size_mb") & F.col("over_at").isNotNull(), "disk_full", "CRITICAL", F.col("over_at")),
        rule(name.startswith("staging.pending") & F.col("over_at").isNotNull(), "staging_overflow", "HIGH", F.col("over_at")),
        rule(name.startswith("leads.intake_") & (cur >= 5) & (F.col("low") < cur * 0.5), "leads_drop", "MEDIUM", never),
        rule(name.contains("quota_used_pct") & F.col("over_at").isNotNull(), "quota", "HIGH", F.col("over_at")),
        rule(name.contains("latency") & (cur > 0) & (F.col("high") > cur * 1.5), "latency_rise", "MEDIUM", never),
    ))
    return s.select(metric, "current", F.explode(rules).alias("a")).select(metric, "current", "a.type", "a.severity", "a.when")


# ---- effect estimates ------------------------------------------------------------------


def _cross_products(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray]:
    """Matrix of sums of products of (1, cols…): one aggregate, (k+1)² numbers to the driver."""
    k = len(cols)
    c = [F.lit(1.0), *[F.col(x).cast("double") for x in cols]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    row = df.agg(*[F.sum(c[i] * c[j]) for i, j in pairs]).first()
    m = np.zeros((k + 1, k + 1))
    for (i, j), v in zip(pairs, row):
        m[i, j] = m[j, i] = v or 0.0
    return int(m[0, 0]), m


def _coefficients(m: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of the last column on (1, the others)."""
    return np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]


#: Cumulative Poisson(1) probabilities: how often a row is drawn in one replicate.
POISSON_STEPS = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)]).tolist()
#: Replicates that one MD5 gives weights for, 8 hex digits each.
DIGEST_SHARES = 4


def poisson_weights(digests: bytes) -> np.ndarray:
    """Poisson(1) draws, a row of ``DIGEST_SHARES`` per MD5, from 8 hex digits each, so every engine draws the same."""
    u = np.frombuffer(digests, ">u4").reshape(-1, DIGEST_SHARES) / float(1 << 32)
    return np.searchsorted(POISSON_STEPS, u, side="left").astype(float)  # how many steps are below


def _bootstrap_products(rows: DataFrame, cols: Sequence[str], replicates: int, seed: int) -> np.ndarray:
    """(replicate, columns + 1, columns + 1): weighted sums of cross products. The digest is that of 'id:block:seed', a block being
    ``DIGEST_SHARES`` replicates. A task adds up its rows, block by block, and hands on one row per sum."""
    k = len(cols) + 1
    first, second = np.triu_indices(k)
    blocks = -(-replicates // DIGEST_SHARES)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((blocks, DIGEST_SHARES, len(first)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(c).to_numpy(zero_copy_only=False) for c in cols]])
            products = x[:, first] * x[:, second]
            heads = [f"{i}:".encode() for i in batch.column("__id").to_pylist()]
            for block in range(blocks):
                tail = f"{block}:{seed}".encode()
                digests = b"".join([md5(head + tail, usedforsecurity=False).digest() for head in heads])
                total[block] += poisson_weights(digests).T @ products
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "s"])

    dealt = spread(rows.select("__id", *cols), "__id")
    sums = dealt.mapInArrow(add_up, "place bigint, s double").groupBy("place").agg(F.sum("s").alias("s")).collect()  # a few thousand
    flat = np.zeros(blocks * DIGEST_SHARES * len(first))
    for r in sums:
        flat[r["place"]] = r["s"]
    out = np.zeros((blocks * DIGEST_SHARES, k, k))
    out[:, first, second] = out[:, second, first] = flat.reshape(-1, len(first))
    return out[:replicates]


def ate_linear(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Average treatment effect by linear adjustment, with a bootstrap 95 % interval and a
    random-common-cause check (the estimate may shift by less than 30 %).

    Sums of cross products are the only thing that leaves the executors: one pass for the
    estimate, one for all Poisson-bootstrap replicates, one for the check.
    """
    cols = [treatment, *confounders, outcome]
    rows = df.select(F.col(row_id).cast("string").alias("__id"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    n, m = _cross_products(rows, cols)
    ate = float(_coefficients(m)[1])
    low = high = None
    if replicates:
        slopes = [_coefficients(c)[1] for c in _bootstrap_products(rows, cols, replicates, seed)]
        low, high = (float(v) for v in np.percentile(slopes, [2.5, 97.5]))
    noise = F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    _, mr = _cross_products(rows.withColumn("__noise", noise), [treatment, *confounders, "__noise", outcome])
    shifted = float(_coefficients(mr)[1])
    passed = bool(abs(shifted - ate) < 0.30 * max(abs(ate), 1e-9))
    means = {c: m[0, i + 1] / n for i, c in enumerate(cols)}
    stds = {c: float(np.sqrt(max((m[i + 1, i + 1] - n * means[c] ** 2) / max(n - 1, 1), 0.0))) or 1.0 for i, c in enumerate(cols)}
    schema = "treatment string, outcome string, n bigint, ate double, ate_lower double, ate_upper double, refutation_passed boolean, means map<string,double>, stds map<string,double>"
    return df.sparkSession.createDataFrame([(treatment, outcome, n, ate, low, high, passed, {k: float(v) for k, v in means.items()}, stds)], schema)


def counterfactual(study: DataFrame, scenarios: DataFrame, treatment: str, outcome: str, overrides: Mapping[str, str]) -> DataFrame:
    """Predicted outcome of scenarios: base mean + ATE·Δtreatment, nudged by 10 % of |ATE| per
    standard deviation of each overridden confounder. ``study`` has one row and is read as
    scalar values; ``overrides`` maps confounder → scenario column."""
    one = lambda e: study.agg(F.first(e)).scalar()
    ate = one(F.col("ate"))
    lo, hi = one(F.col("ate_lower")), one(F.col("ate_upper"))
    mean = lambda c: one(F.col("means")[c])
    delta = F.col("treatment") - mean(treatment)
    pred = mean(outcome) + ate * delta
    for conf, col in overrides.items():
        nudge = 0.10 * F.abs(ate) * (F.col(col) - mean(conf)) / one(F.col("stds")[conf])
        pred = pred + F.coalesce(nudge, F.lit(0.0))
    spread = lambda bound: F.coalesce(F.abs(ate - bound), F.lit(0.0)) * F.abs(delta)
    return scenarios.withColumn("predicted", pred).withColumn("predicted_lower", F.col("predicted") - spread(lo)).withColumn("predicted_upper", F.col("predicted") + spread(hi))


def wave_hit_rate(tx: DataFrame, wave: Column, min_wave: int, drop: float = 0.97) -> DataFrame:
    """How often an area's quarter with a deal wave was followed by a clearly lower price."""
    q = F.to_date(F.date_trunc("quarter", "deal_date"))
    waves = tx.filter(wave).groupBy("area", q.alias("quarter")).agg(F.count("*").alias("n")).filter(F.col("n") > min_wave)
    nxt = next_quarter(tx, ["area"], "deal_date", "price")
    hits = null_safe_join(waves, nxt, ["area", "quarter"])
    return hits.agg(F.avg(F.when(F.col("avg_next") < F.col("avg_now") * drop, 1.0).otherwise(0.0)).alias("hit_rate"), F.count("*").alias("n_obs"))


def season_hit_rate(tx: DataFrame, date: str, ratio: float = 0.85) -> DataFrame:
    """How often summer (Jun–Aug) deals stayed below ``ratio`` of spring (Mar–May) deals."""
    month = F.month(date)
    years = tx.groupBy(F.year(date).alias("y")).agg(F.count_if(month.between(6, 8)).alias("summer"), F.count_if(month.between(3, 5)).alias("spring"))
    both = years.filter((F.col("summer") > 0) & (F.col("spring") > 0))
    return both.agg(F.avg(F.when(F.col("summer") < F.col("spring") * ratio, 1.0).otherwise(0.0)).alias("hit_rate"), F.count("*").alias("n_obs"))


def ema_confidence(confidence: Column, hit_rate: Column, alpha: float = 0.25) -> Column:
    """Confidence after one validation, kept within .05 and .99; unchanged without data."""
    moved = (1 - alpha) * confidence + alpha * hit_rate
    return F.when(hit_rate.isNull(), confidence).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.99), moved)))
