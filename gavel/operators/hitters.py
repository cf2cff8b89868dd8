"""Keys with the largest sums: a mergeable summary of bounded size finds them, an exact recount settles them.

Every task keeps at most ``capacity`` keys (Misra-Gries: when there are more, the smallest kept sum is taken off all of them), so what is
shuffled does not grow with the number of keys. What was taken off bounds every sum that is missing. If the n-th exact
sum is above that bound the answer is exact; otherwise all keys are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.session import cut_lineage

#: Keys of a task beyond which its summary is cut back to ``capacity``, as a multiple of it.
SLACK = 4


def summary(rows: DataFrame, capacity: int) -> DataFrame:
    """(key, held, taken): per task its largest keys with sums that are too small by ``taken`` at most, and one row without a key that
    says what the task took off. ``rows``: key (text), w (not negative)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, taken = pd.Series(dtype=float), 0.0
        for frame in frames:
            held = held.add(frame.groupby("key")["w"].sum(), fill_value=0.0)
            if len(held) > SLACK * capacity:
                cut = held.nlargest(capacity + 1).iloc[-1]
                held, taken = held[held > cut] - cut, taken + float(cut)
        if len(held) > capacity:
            cut = held.nlargest(capacity + 1).iloc[-1]
            held, taken = held[held > cut] - cut, taken + float(cut)
        yield pd.DataFrame({"key": [*held.index, None], "held": [*held.to_numpy(), 0.0], "taken": [0.0] * len(held) + [taken]})

    return rows.mapInPandas(run, "key string, held double, taken double")


def largest_sums(df: DataFrame, key: str, weight: str, n: int, capacity: int = 4096) -> DataFrame | None:
    """The rows of ``df`` whose key may be among the ``n`` with the largest sums of ``weight``, or None where the summary cannot tell (a flat
    distribution, or negative weights). Null weights are nothing, null keys one key."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    tagged = F.when(F.col(key).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(key).cast("string")))
    rows = df.select(tagged.alias("key"), w.alias("w"))
    if not df.filter(F.col(weight) < 0).isEmpty():
        return None
    found = cut_lineage(summary(rows, capacity), "hitters")
    bound = found.agg(F.coalesce(F.sum("taken"), F.lit(0.0))).first()[0]
    sums = found.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("held").alias("held"))
    # whose sum is at most ``bound`` below the n-th held one or above it
    nth = sums.orderBy(F.col("held").desc()).limit(n).agg(F.min("held"), F.count(F.lit(1))).first()
    if bound and (nth[1] < n or nth[0] <= bound):
        return None
    kept = sums.filter(F.col("held") + bound >= (nth[0] or 0.0)) if nth[1] >= n else sums
    return df.withColumn("__key", tagged).join(kept.select(F.col("key").alias("__key")), "__key", "left_semi").drop("__key")
