"""Table sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the given Parquet tables.
TABLES: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read one table with its declared schema (no inference, pruning and pushdown intact)."""
    return spark.read.schema(TABLES[name]).parquet(f"{directory.rstrip('/')}/{name}.parquet")


def ts(text: str) -> Column:
    """A zone-less timestamp literal; folds to a constant, so filters reach Parquet."""
    return F.lit(text).cast("timestamp_ntz")


def incremental_scan(
    df: DataFrame,
    state: DataFrame,
    source: str,
    row_id: str,
    stored_offset: str = "stored_offset",
    loaded_max: str = "loaded_max",
    max_lead: int = 500_000,
    max_offset: int | None = None,
) -> DataFrame:
    """Rows newer than what is loaded, per source.

    ``state`` has one row per source: the highest loaded id (``loaded_max``) and the offset
    the sync log remembers. An offset that runs more than ``max_lead`` ahead of the data, or
    beyond ``max_offset`` (none by default), is ignored in favour of the data. Sources without state are read
    from the start.
    """
    real = F.coalesce(F.col(loaded_max), F.lit(0))
    log = F.coalesce(F.col(stored_offset), F.lit(0))
    wrong = (real > 0) & (log > real + max_lead)
    if max_offset is not None:
        wrong = wrong | (log > max_offset)
    floor = state.select(source, F.greatest(real, F.when(wrong, real).otherwise(log)).alias("__min_id"))
    return (
        df.join(floor, source, "left")
        .filter(F.col(row_id) > F.coalesce(F.col("__min_id"), F.lit(0)))
        .drop("__min_id")
    )
