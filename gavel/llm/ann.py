"""Approximate nearest neighbours by a hash-prefix forest.

The vectors are dealt to shards by id; every shard has a forest: for each tree the hash strings (one
bit per random hyperplane) of its vectors in a sorted array. A query descends every tree to its longest
matching prefix and then ascends all trees together, one bit at a time, until enough vectors share
the prefix in some tree; all of these are candidates (levels are taken whole, there is no cap) and are scored
exactly. Each shard returns its best, and a window over the query picks the result.

Queries meet the shards in blocks: a task holds one shard and one block, both of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a hash string.
DEPTH = 32

HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``vector`` (doubles), ``dim``: vectors with finite components that are not all zero. Of rows
    that repeat an id the greatest vector counts; null ids take no part."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~odd & F.exists(v, lambda x: x != 0))
    one = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(v).alias("vector"))
    return one.withColumn("dim", F.size("vector"))


class Forest:
    """The sorted hash strings of one shard."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int = 11):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / self.norms[:, None]
        self.centre = unit.mean(axis=0)
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], DEPTH))
        self.strings, self.order = [], []
        for plane in self.planes:
            codes = self._codes(unit, plane)
            order = np.argsort(codes, kind="stable")
            self.order.append(order)
            self.strings.append(codes[order])

    def _codes(self, unit: np.ndarray, plane: np.ndarray) -> np.ndarray:
        bits = (unit - self.centre) @ plane > 0
        return (bits.astype(np.int64) << np.arange(DEPTH - 1, -1, -1)).sum(axis=1)

    def candidates(self, query: np.ndarray, enough: int) -> np.ndarray:
        """Rows that share the longest prefixes with the query, whole levels until there are enough."""
        unit = (query / np.sqrt((query * query).sum()))[None, :]
        codes = np.array([self._codes(unit, plane)[0] for plane in self.planes])
        levels = np.arange(DEPTH + 1)
        low = (codes[:, None] >> (DEPTH - levels)) << (DEPTH - levels)
        high = low + (1 << (DEPTH - levels))
        begin = np.array([np.searchsorted(s, x) for s, x in zip(self.strings, low)])
        end = np.array([np.searchsorted(s, x) for s, x in zip(self.strings, high)])
        reach = (end - begin).sum(axis=0)  # at least the number of different rows
        marked = np.zeros(len(self.vectors), bool)
        for level in range(DEPTH, -1, -1):
            if reach[level] < enough and level:
                continue
            for order, a, b in zip(self.order, begin[:, level], end[:, level]):
                marked[order[a:b]] = True
            if marked.sum() >= enough:
                break
        return np.flatnonzero(marked)

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines, summed row by row: equal vectors have equal scores."""
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * np.sqrt((query * query).sum()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def nearest(
    items: DataFrame,
    queries: DataFrame,
    k: int = 5,
    trees: int = 96,
    share: float = 0.45,
    least: int = 512,
    shard_rows: int = 4096,
    block_queries: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest found by cosine, ties to the
    smaller id; fewer where there are fewer. A query is never its own neighbour.

    Trees are ascended until ``share`` of a shard's rows, and ``least`` of them, are candidates: vectors without
    structure need a large share, clustered ones do with a small. Only vectors of one dimension are
    compared. Null vectors, vectors with null or non-finite components and zero vectors take no part; an empty
    side gives no rows. Other columns are not read.
    """
    rows, asked = usable(items, id_col, vector_col), usable(queries, id_col, vector_col)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    left = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "vector")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector")

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if shard.num_rows and block.num_rows:
            ids = shard.column("id").to_numpy()
            forest = Forest(_matrix(shard.column("vector")), trees)
            enough = max(int(np.ceil(share * len(ids))), least, k + 1)
            for own, query in zip(block.column("id").to_pylist(), _matrix(block.column("vector"))):
                found = forest.candidates(query, enough)
                found = found[ids[found] != own]
                score = forest.scores(query, found)
                best = np.lexsort((ids[found], -score))[:k]
                out["query_id"] += [own] * len(best)
                out["vec_id"] += ids[found[best]].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["dim", "shard", "block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, HITS)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
