"""Figures agree with SQL where a value lies between two roundings."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from gavel.functions.scale import group_percentiles
from gavel.sources.tables import TABLES

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


def compare(spark, sf, folder, name, **tables):
    """Rows of a query and of its SQL over the smallest tables, some of them replaced by DuckDB SELECTs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY ({tables.get(t) or f'SELECT * FROM {chr(39)}{sf}/{t}.parquet{chr(39)}'}) TO '{folder}/{t}.parquet' (FORMAT parquet)".replace("{sf}", sf))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = ", ".join(df.columns)
    return sorted(map(tuple, df.collect()), key=repr), sorted(con.execute(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall(), key=repr)


HALF_CENTS = "SELECT o_orderkey, o_custkey, o_orderstatus, (o_orderkey % 500) * 1000 + 500.0::DOUBLE AS o_totalprice, o_orderdate, '3-MEDIUM' AS o_orderpriority FROM '{sf}/orders.parquet'"


@pytest.mark.parametrize("name", ["advert_texts", "clean_text", "price_amount"])
def test_millions_between_two_cents(spark, sf, tmp_path, name):
    """A price of 1.005 million is written as C does: by its binary value, ties to even."""
    got, want = compare(spark, sf, tmp_path, name, orders=HALF_CENTS)
    assert got == want


def test_median_between_two_values(spark):
    """The median of two prices is their exact middle; rounded to whole numbers, a middle of .5 goes up."""
    pairs = [(i, float(a), float(b)) for i, (a, b) in enumerate([(61087.27, 61087.73), (50000.01, 90000.99), (1024.37, 104999.63), (3333.33, 99999.67), (12345.67, 88888.33), (900.68, 55001.32)])]
    rows = spark.createDataFrame([(k, v) for k, *pair in pairs for v in pair], "k int, v double")
    got = {r["k"]: r["m"] for r in group_percentiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {k: a * 0.5 + b * 0.5 for k, a, b in pairs}


def test_scores_between_two_steps(spark, sf, tmp_path):
    """A confidence of .12345 is rounded on its binary value, and the best row of a group follows from it."""
    from gavel.plans.roles import listings

    con = duckdb.connect()
    cents = f"SELECT c_custkey, c_name, c_nationkey, (c_custkey * 37 % 1000) + 0.5::DOUBLE AS c_acctbal, c_mktsegment FROM '{sf}/customer.parquet'"
    got, want = compare(spark, sf, tmp_path, "cross_source_winners", customer=cents)
    assert got == want
    rounded = {r["c"] for r in listings(spark, str(tmp_path)).select(F.col("confidence_score").alias("c")).collect()}
    assert rounded == {r[0] for r in con.execute(f"SELECT DISTINCT round(c_acctbal / 10000, 4) FROM '{tmp_path}/customer.parquet' JOIN '{tmp_path}/orders.parquet' ON c_custkey = o_custkey").fetchall()}


def test_living_scores_between_two_whole_numbers(spark, sf, tmp_path):
    half = "SELECT c_custkey, c_name, c_nationkey, floor(c_acctbal) + 0.5::DOUBLE AS c_acctbal, c_mktsegment FROM '{sf}/customer.parquet'"
    got, want = compare(spark, sf, tmp_path, "rank_areas_living", customer=half)
    assert got == want
