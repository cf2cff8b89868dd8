"""Bootstrap sums are added up where the rows are."""

from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from gavel.operators import series as se


def test_weighted_sums_equal_those_of_a_loop(spark):
    data = [(f"r{i}", float(i % 3 == 0), float(i), float(i * i % 17)) for i in range(40)]
    rows = spark.createDataFrame(data, "__id string, t double, c double, y double").repartition(3)
    got = se._bootstrap_products(rows, ["t", "c", "y"], 6, 42)
    want = np.zeros((8, 4, 4))
    for key, *x in data:
        v = np.array([1.0, *x])
        for block in range(2):
            digest = md5(f"{key}:{block}:42".encode()).hexdigest()
            for s in range(4):
                u = int(digest[8 * s : 8 * s + 8], 16) / 2**32
                want[4 * block + s] += sum(u > step for step in se.POISSON_STEPS) * np.outer(v, v)
    assert got.shape == (6, 4, 4) and np.allclose(got, want[:6])


def test_no_row_is_multiplied_in_front_of_a_shuffle(spark, monkeypatch):
    """Rows are dealt out once, not once per block of replicates."""
    seen = []
    monkeypatch.setattr(se, "spread", lambda df, key: seen.append(df.count()) or df)
    rows = spark.range(50).select(F.col("id").cast("string").alias("__id"), F.lit(1.0).alias("t"), F.col("id").cast("double").alias("y"))
    se._bootstrap_products(rows, ["t", "y"], 200, 42)
    assert seen == [50]


def test_lookups_read_their_tables_once(spark):
    """The stages of a lookup read values and names where they were written, not what they are made of."""
    from gavel.operators.joins import substring_lookup

    rows = spark.range(30).select(F.concat(F.lit("tower "), (F.col("id") % 5).cast("string")).alias("v"))
    names = spark.range(20).select(F.concat(F.lit("TOWER "), (F.col("id") % 4).cast("string")).alias("n"))
    found = substring_lookup(rows, names, "v", "n")
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["value"], r["hit"], r["stage"]) for r in found.collect()} == {(f"tower {i}", f"TOWER {i}", 2) for i in range(4)}
