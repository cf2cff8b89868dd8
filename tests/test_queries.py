"""Every registered query against its SQL on DuckDB over whole tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check import rows_of  # noqa: E402
from gavel.plans import load_all  # noqa: E402
from gavel.sources.tables import TABLES  # noqa: E402

QUERIES = {name: q.plan for name, q in load_all().items()}  # the training-data queries have tests of their own
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_every_query_has_an_oracle_or_a_test_here():
    assert set(QUERIES) - set(ORACLE) == {"text_cluster", "fuzzy_canonical_name"}


def test_merged_facts_point_to_survivors(spark, sf):
    rows = {r.id: r.superseded_by for r in QUERIES["near_dup_merge"](spark, sf).collect()}
    assert rows and None not in rows.values() and not set(rows.values()) & set(rows) and all(a != b for a, b in rows.items())


def test_bootstrap_interval_holds_the_estimate(spark, sf):
    row = QUERIES["ate_bootstrap"](spark, sf).first()
    assert row.ate_lower < row.ate < row.ate_upper and row.n == QUERIES["ate_linear"](spark, sf).first().n


def test_every_text_is_in_one_cluster(spark, sf):
    rows = QUERIES["text_cluster"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == len({r.doc_id for r in rows}) == docs and len({r.cluster_id for r in rows}) == 10


def _kept(x, y):
    """Length of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_fuzzy_names_are_the_best_of_all(spark, sf):
    from gavel.functions.similarity import token_sort

    rows = [r for r in QUERIES["fuzzy_canonical_name"](spark, sf).collect() if r.score < 100]
    names = spark.read.parquet(f"{sf}/part.parquet").selectExpr("lower(trim(p_name)) AS n").distinct().select(token_sort("n").alias("n")).distinct()
    names = [r.n for r in names.collect()]
    values = spark.createDataFrame([(r.value,) for r in rows], "value string").select("value", token_sort("value").alias("v"))
    best = {r.value: max(200 * _kept(r.v, n) / (len(r.v) + len(n)) for n in names) for r in values.limit(25).collect()}
    assert best and all(abs(r.score - best[r.value]) < 0.01 for r in rows if r.value in best)


def test_flagship_has_rows(spark):
    assert contract.entry(spark).count() == 25


def test_queries_over_whole_tables(spark, sf):
    """Pages of one host are no copies of each other, and long messages have siblings as well."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    kept = QUERIES["fingerprint_dedup"](spark, sf).filter("NOT is_dup").count()
    assert kept == pages.select("url").distinct().count() > QUERIES["fingerprint_dedup"](spark, sf).filter("NOT is_dup").count()
    from gavel.plans.roles import messages

    anchors = QUERIES["sibling_window_join"](spark, sf).select("anchor_id").distinct().count()
    assert anchors == messages(spark, sf).filter("chat IS NOT NULL AND lang IS NOT NULL AND ts IS NOT NULL").count()
    assert anchors > QUERIES["sibling_window_join"](spark, sf).select("anchor_id").distinct().count()
