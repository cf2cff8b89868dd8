"""Plan shapes: no cross joins, no row-wise Python, filters and columns reach the scan."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plans import BAD  # noqa: E402

from gavel.plans import load_all
from gavel.plans.q_c_joins import nullable_bench
from gavel.sources.tables import load_table, ts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["flagship_deal_scores", "rule_match_join", "substring_lookup", "entity_search_cascade", "mad_outliers", "vector_topk_cosine", "kpi_rollup", "dedup_exact_broker"])
def test_no_cross_join_without_broadcast(spark, sf, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(load_all()[name].plan(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not [b for b in BAD if b in plan]


def test_filters_and_columns_reach_parquet(spark, sf):
    df = load_table(spark, sf, "orders").filter(F.col("o_orderdate") >= ts("2001-01-01 00:00:00")).select("o_orderkey", "o_orderdate")
    plan = _plan(df)
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_top_n_limits_before_the_shuffle(spark, sf):
    assert _plan(load_all()["latest_per_key"].plan(spark, sf)).count("WindowGroupLimit") == 2


def test_both_benchmark_classes_read_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cols = "area string, property_type string, bedrooms int, deal_type string, price double"
    tx = spark.createDataFrame([("a", "t", i % 2, "sale", float(i)) for i in range(20)], cols).mapInArrow(counted, cols)
    rows = {r.bedrooms: (r["median"], r.n) for r in nullable_bench(tx).collect()}
    assert rows == {0: (9.0, 10), 1: (10.0, 10), None: (9.5, 20)} and seen.value == 20
