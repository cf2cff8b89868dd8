"""Write policies, expressed as DataFrame → DataFrame so that any sink can take the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.scale import null_safe_join, top_n

OVERWRITE, KEEP_FIRST, PREFER_NEW, PREFER_OLD, MERGE_MAP = "overwrite", "keep_first", "prefer_new", "prefer_old", "merge_map"


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], policy: str | Mapping[str, str] = OVERWRITE) -> DataFrame:
    """Merge ``updates`` (unique on ``keys``) into ``target``; NULL keys match each other.

    Policy per table or per column: ``overwrite`` takes the new value even when NULL,
    ``keep_first`` keeps the stored row, ``prefer_new``/``prefer_old`` coalesce, and
    ``merge_map`` merges map columns with new entries winning.
    """
    values = [c for c in target.columns if c not in keys]
    t = target.select(*[F.col(k).alias(f"__t_{k}") for k in keys], *[F.col(c).alias(f"__o_{c}") for c in values], F.lit(True).alias("__ot"))
    u = updates.select(*[F.col(k).alias(f"__u_{k}") for k in keys], *[F.col(c).alias(f"__n_{c}") for c in values], F.lit(True).alias("__nt"))
    cond = None
    for k in keys:
        part = t[f"__t_{k}"].eqNullSafe(u[f"__u_{k}"])
        cond = part if cond is None else cond & part
    joined = t.join(u, cond, "full_outer")

    def merged(c: str) -> Column:
        how = policy if isinstance(policy, str) else policy.get(c, OVERWRITE)
        old, new = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        if how == OVERWRITE:
            return F.when(F.col("__nt"), new).otherwise(old)
        if how == KEEP_FIRST:
            return F.when(F.col("__ot"), old).otherwise(new)
        if how == PREFER_NEW:
            return F.coalesce(new, old)
        if how == PREFER_OLD:
            return F.coalesce(old, new)
        if how == MERGE_MAP:
            kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
            return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))
        raise ValueError(f"unknown policy {how!r}")

    key_cols = [F.when(F.col("__ot"), F.col(f"__t_{k}")).otherwise(F.col(f"__u_{k}")).alias(k) for k in keys]
    return joined.select(*key_cols, *[merged(c).alias(c) for c in values]).select(*target.columns)


def replace_keys(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete-then-insert of every (NULL-able) key that ``new`` touches."""
    touched = new.select(*keys).distinct()
    return null_safe_join(target, touched, keys, "left_anti").unionByName(new)


def merge_override(base: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Live rows stand in for the baseline rows of the same key."""
    return base.join(live.select(key).distinct(), key, "left_anti").unionByName(live)


def retention(df: DataFrame, bucket: str, group: str, newest_first: Sequence[Column], row_key: str, keep: Mapping[str, int]) -> DataFrame:
    """Flag the rows beyond the newest N of every (bucket, group) as victims."""
    limits = F.coalesce(*[F.when(F.col(bucket) == b, F.lit(n)) for b, n in keep.items()], F.lit(0))
    kept = (
        top_n(df.withColumn("__limit", limits), [bucket, group], newest_first, max(keep.values()), "__rn")
        .filter(F.col("__rn") <= F.col("__limit"))
        .select(F.col(row_key), F.lit(False).alias("__victim"))
    )
    return df.join(kept, row_key, "left").withColumn("is_victim", F.coalesce("__victim", F.lit(True))).drop("__victim")
