"""Skew-safe building blocks shared by the operators.

One key may own a third of all rows, so nothing here gathers an unbounded group in a
single task: groups are pre-aggregated, cut into value or time buckets, or limited on
the map side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.session import cut_lineage

ONE_TASK = 65_536  # values of a key that one task may order


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet each other; the right keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    out = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.drop(*[f"__r_{k}" for k in keys])


def salt_nulls(key: Column, *spread: Column | str) -> Column:
    """Text key for a left join in which NULL finds nothing: NULLs become many keys that no table
    holds, so rows without a key do not meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("string")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by a key before CPU-heavy work on them, to as many tasks as the session's shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows of every key. The ``row_number() <= n`` filter lets Spark drop
    rows before the shuffle (window group limit), so a hot key ships n rows per task."""
    rn = rank_col or "__rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key."""
    return top_n(df, keys, order, 1)


def count_distinct_groups(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct values per key; two shuffles, the first spread over (key, value)."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias(name))


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    count_name: str = "n",
    buckets: int = 64,
    one_task: int = ONE_TASK,
) -> DataFrame:
    """Exact, linearly interpolated percentiles per key without one big group per task.

    1. rows collapse to (key, value, count): the shuffle is spread over key *and* value, and the result is
       written to the shared folder, so the input is read once;
    2. where no key has more than ``one_task`` values, a key's values are ordered in one task; else
    3. a bounded sketch per larger key gives value cut points, so each bucket holds about 1/``buckets`` of its values;
    4. bucket counts give each bucket's rank offset (at most ``buckets`` rows per key);
    5. only buckets that hold a wanted rank are ordered, and the two neighbours of every
       rank are read off. The sketch decides the balance of the work, not the result.
    """
    keys = list(keys)
    vals = cut_lineage(value_counts(df, keys, value), "values")
    return counted_percentiles(vals, keys, probs, count_name, buckets, one_task)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(key, ``__v``, ``__c``): how often each value occurs per key; NULL values are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))


def _ranked_in_buckets(vals: DataFrame, keys: list[str], large: DataFrame, wanted: Sequence[Column], buckets: int) -> DataFrame:
    """Counted values of the buckets that hold a wanted rank, with ``__end``, the number of rows up to and with each, and
    ``__total``. Keys that are not ``large`` are one bucket. A sketch depends on the order in which its parts arrive, so the
    sketches are written once: all uses of a key's cut points must see the same ones."""
    size = vals.groupBy(*keys).agg(F.sum("__c").alias("__total"))
    cuts = F.array_distinct(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 1000)).alias("__cuts")
    if keys:
        sketch = null_safe_join(vals, large, keys, "left_semi").groupBy(*keys).agg(cuts)
        groups = cut_lineage(null_safe_join(size, sketch, keys, "left"), "sketches")
        sketched = null_safe_join(vals, groups, keys)
    else:
        groups = cut_lineage(vals.agg(cuts, F.sum("__c").alias("__total")), "sketches")
        sketched = vals.withColumn("__cuts", groups.select("__cuts").scalar()).withColumn("__total", groups.select("__total").scalar())
    below = F.size(F.filter("__cuts", lambda s: s < F.col("__v")))
    bucketed = sketched.withColumn("__pb", F.when(F.col("__cuts").isNull(), 0).otherwise(below)).drop("__cuts")
    over_buckets = Window.partitionBy(*keys).orderBy("__pb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "__pb")
        .agg(F.sum("__c").alias("__bn"), F.first("__total").alias("__total"))
        .withColumn("__before", F.coalesce(F.sum("__bn").over(over_buckets), F.lit(0)))
    )
    hit = reduce(
        lambda a, b: a | b,
        [(r >= F.col("__before")) & (r < F.col("__before") + F.col("__bn")) for r in wanted],
    )
    needed = offsets.filter(hit).select(*keys, "__pb", "__before")
    in_bucket = Window.partitionBy(*keys, "__pb").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_join(bucketed, needed, [*keys, "__pb"]).withColumn("__end", F.col("__before") + F.sum("__c").over(in_bucket))


def counted_percentiles(vals: DataFrame, keys: Sequence[str], probs: Mapping[str, float], count_name: str = "n", buckets: int = 64, one_task: int = ONE_TASK) -> DataFrame:
    """:func:`group_percentiles` of a table of :func:`value_counts` that is cheap to read (it is used up to five times)."""
    keys = list(keys)
    held = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"))
    wanted = []
    for p in probs.values():
        pos = (F.col("__total") - 1) * F.lit(float(p))
        wanted += [F.floor(pos), F.ceil(pos)]
    if (held.agg(F.max("__d")).first()[0] or 0) <= one_task:
        group = Window.partitionBy(*keys)
        end = F.sum("__c").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        ranked = vals.withColumn("__end", end).withColumn("__total", F.sum("__c").over(group))
    else:
        ranked = _ranked_in_buckets(vals, keys, held.filter(F.col("__d") > one_task), wanted, buckets)
    aggs = [F.first("__total").alias("__t")]
    for i, (lo, hi) in enumerate(zip(wanted[::2], wanted[1::2])):
        aggs.append(F.min(F.when((F.col("__end") > lo) & (F.col("__end") - F.col("__c") <= lo), F.col("__v"))).alias(f"__lo{i}"))
        aggs.append(F.min(F.when((F.col("__end") > hi) & (F.col("__end") - F.col("__c") <= hi), F.col("__v"))).alias(f"__hi{i}"))
    found = ranked.groupBy(*keys).agg(*aggs)
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("__t") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        cols.append((F.col(f"__lo{i}") * (1.0 - frac) + F.col(f"__hi{i}") * frac).alias(name))  # a sum of halves is exact, a difference is not
    return found.select(*keys, F.col("__t").alias(count_name), *cols)


def split_lag(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    carry: Sequence[str],
    prefix: str = "prev_",
    bucket: str = "hour",
) -> DataFrame:
    """``lag(1)`` of ``carry`` columns per key in (ts, tie) order, cut into time buckets.

    The sort runs per (key, time bucket); the first row of a bucket takes the last row of
    the nearest earlier non-empty bucket, found on one row per (key, bucket).
    """
    keys = list(keys)
    cut = df.withColumn("__tb", F.date_trunc(bucket, F.col(ts)))
    w = Window.partitionBy(*keys, "__tb").orderBy(ts, tie)
    packed = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in carry])
    rows = cut.withColumn("__in", F.lag(packed).over(w))
    tails = cut.groupBy(*keys, "__tb").agg(F.max_by(packed, F.struct(F.col(ts), F.col(tie))).alias("__tail"))
    heads = tails.withColumn("__before", F.lag("__tail").over(Window.partitionBy(*keys).orderBy("__tb"))).drop("__tail")
    out = null_safe_join(rows, heads, [*keys, "__tb"], "left")
    prev = F.coalesce(F.col("__in"), F.col("__before"))
    for c in carry:
        out = out.withColumn(f"{prefix}{c}", prev[f"{prefix}{c}"])
    return out.drop("__tb", "__in", "__before")


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    gap_seconds: int,
    bucket: str = "hour",
    same_breaks: str | None = None,
) -> DataFrame:
    """First row of the session per row, as ``session_start`` and ``session_first`` (its tie
    id): a session opens when the gap to the previous row of the key exceeds ``gap_seconds``,
    or when ``same_breaks`` has the previous row's value. Long keys are worked through per
    (key, time bucket)."""
    keys = list(keys)
    carry = [ts] + ([same_breaks] if same_breaks else [])
    lagged = split_lag(df, keys, ts, tie, carry, "__p_", bucket)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"__p_{ts}").cast("timestamp"))
    is_open = F.col(f"__p_{ts}").isNull() | (gap > gap_seconds * 1_000_000)
    if same_breaks:
        is_open = is_open | F.col(same_breaks).eqNullSafe(F.col(f"__p_{same_breaks}"))
    mark = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"))
    opened = lagged.withColumn("__open", F.when(is_open, mark)).withColumn("__tb", F.date_trunc(bucket, F.col(ts)))
    run = Window.partitionBy(*keys, "__tb").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    inside = opened.withColumn("__start", F.max("__open").over(run))
    last_open = opened.groupBy(*keys, "__tb").agg(F.max("__open").alias("__lo"))
    before = Window.partitionBy(*keys).orderBy("__tb").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_open.withColumn("__carry", F.max("__lo").over(before)).drop("__lo")
    out = null_safe_join(inside, carried, [*keys, "__tb"], "left")
    start = F.coalesce("__start", "__carry")
    return (
        out.withColumn("session_start", start["t"]).withColumn("session_first", start["i"])
        .drop("__tb", "__start", "__carry", "__open", *[f"__p_{c}" for c in carry])
    )


def score_rank(df: DataFrame, score: str, ties: Sequence[Column], name: str = "rank", partition: Sequence[str] = ()) -> DataFrame:
    """Dense 1..n row order by descending score, ranked per integer score band.

    Bands are counted first (few rows), then rows are numbered inside their band and
    shifted by the number of rows in higher bands; no single task sorts everything.
    """
    part = list(partition)
    banded = df.withColumn("__band", F.floor(F.col(score)))
    higher = Window.partitionBy(*part).orderBy(F.col("__band").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        banded.groupBy(*part, "__band")
        .agg(F.count(F.lit(1)).alias("__bn"))
        .withColumn("__above", F.coalesce(F.sum("__bn").over(higher), F.lit(0)))
        .drop("__bn")
    )
    w = Window.partitionBy(*part, "__band").orderBy(F.col(score).desc_nulls_last(), *ties)
    ranked = banded.withColumn("__rn", F.row_number().over(w))
    return (
        null_safe_join(ranked, sizes, [*part, "__band"], "left")
        .withColumn(name, (F.col("__above") + F.col("__rn")).cast("int"))
        .drop("__band", "__rn", "__above")
    )
