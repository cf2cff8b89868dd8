"""Connected components of document links, and tables kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.session import cut_lineage


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the folder in ``spark.checkpoint.dir`` and read it from there: nothing before it
    is computed again, also not when executors are lost."""
    return cut_lineage(df, f"llm-{purpose}")


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of all ids in ``links`` (columns a, b).

    Alternates large-star and small-star steps: every round connects an id's larger, then its smaller
    neighbours to its smallest one, and the number of rounds is logarithmic in the length of a chain. Each
    step is a grouped minimum (combined before the shuffle) and a join, which adaptive execution
    splits where one id has very many links. Links of an id with itself and repeated links count once.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        paired = large.join(lower, "u")
        small = paired.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(paired.select("u", F.col("m").alias("v")))
        edges = keep(small.filter("u <> v").distinct(), "edges")
        last, state = state, _state(edges)
        if state == last:
            # every id has one link, to the smallest id of its component
            tops = edges.select(F.col("v").alias("id")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops.select("id", F.col("id").alias("component")))
    raise RuntimeError("components did not settle")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
