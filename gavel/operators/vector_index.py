"""Vector search by learnt cells: coarse centroids, inverted lists, multi-probe, exact re-ranking.

An index deals every vector to the nearest of a bounded number of centroids, learnt from a bounded sample. A query looks at the
lists of its nearest cells and scores their members exactly. Asked for the exact answer it goes on: the k-th
result found and a cell's radius bound what the cell can hold (triangle inequality), so only cells that may
hold something nearer are read. Lists longer than ``list_rows`` are split into slices, queries meet lists in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.scale import top_n
from gavel.session import cut_lineage

#: Largest matrix of centroids a task is given, in bytes.
MOST_CENTRE_BYTES = 64 << 20
#: Distances are compared with this slack, so that rounding never hides a result.
SLACK = 1e-6

HITS = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: cell, slice, id, vec. Of each cell: centroid, radius, members and slices."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    slices: np.ndarray
    metric: str


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _placed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Where vectors lie: for cosine on the unit sphere, on which nearness by distance is nearness by cosine."""
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None] if metric == "cosine" else vectors


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :], 0))


def usable(vectors: DataFrame, vec: str, metric: str) -> DataFrame:
    """Rows whose vector is finite, not empty and, for cosine, not zero; the vector in doubles."""
    v = F.col(vec)
    rows = vectors.withColumn(vec, v.cast("array<double>")).filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.filter(F.exists(v, lambda x: x != 0)) if metric == "cosine" else rows


def learn_cells(items: DataFrame, cells: int, metric: str, sample_rows: int, rounds: int = 10) -> np.ndarray:
    """Centroids from the ``sample_rows`` items with the smallest id hashes."""
    dim = items.select(F.max(F.size("vec"))).first()[0] or 0
    if cells * dim * 8 > MOST_CENTRE_BYTES:
        raise ValueError(f"{cells} cells of {dim} dimensions are more than {MOST_CENTRE_BYTES} bytes")
    unit = F.expr("transform(vec, x -> x / sqrt(aggregate(vec, 0D, (s, y) -> s + y * y)))") if metric == "cosine" else F.col("vec")
    sample = cut_lineage(items.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(array_to_vector(unit).alias("v")), "cell-sample")
    model = KMeans(k=cells, seed=7, maxIter=rounds, featuresCol="v").fit(sample)
    return np.array(model.clusterCenters())


def build_index(items: DataFrame, metric: str = "cosine", cells: int | None = None, sample_rows: int = 100_000, list_rows: int = 8192) -> VectorIndex | None:
    """Index of ``items`` (id bigint, vec). ``cells``: about the square root of the rows by default, 4,096 at most. All vectors must
    have one dimension; :func:`usable` ones are indexed. Nothing to index gives None."""
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    rows = usable(items.select(F.col("id").cast("long").alias("id"), "vec"), "vec", metric)
    n = rows.count()
    if not n:
        return None
    cells = min(cells or min(4096, max(1, round(n**0.5))), n)
    centres = learn_cells(rows, cells, metric, sample_rows) if cells > 1 else np.zeros((1, rows.first()["vec"].__len__()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_placed(_matrix(batch.column("vec")), metric), centres)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "gap"])

    dealt = cut_lineage(rows.mapInArrow(assign, "id long, vec array<double>, cell int, gap double"), "cells")
    radii, sizes, slices = np.zeros(len(centres)), np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        radii[r.cell], sizes[r.cell], slices[r.cell] = r.radius, r.n, -(-r.n // list_rows)
    per_cell = F.element_at(F.lit([int(s) for s in slices]), F.col("cell") + 1)
    return VectorIndex(dealt.select("cell", F.pmod(F.xxhash64("id"), per_cell).cast("int").alias("slice"), "id", "vec"), centres, radii, sizes, slices, metric)


ROUTE = "qid long, qvec array<double>, cell int, slice int"


def _routes(index: VectorIndex, queries: DataFrame, pick) -> DataFrame:
    """One row per query and list slice; ``pick(order, bound, batch)`` says which of the ordered cells."""
    centres, radii, slices, full, metric = index.centres, index.radii, index.slices, index.sizes > 0, index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_placed(_matrix(batch.column("qvec")), metric), centres)
            d[:, ~full] = np.inf
            order = np.argsort(d, axis=1, kind="stable")
            near = np.take_along_axis(d, order, 1)
            bound = near - radii[order]
            q, at = np.nonzero(pick(batch, near, bound) & np.isfinite(near))
            cell = order[q, at]
            times = slices[cell]
            q, cell = np.repeat(q, times), np.repeat(cell, times)
            within = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
            for a in range(0, len(q), 16384):
                part = slice(a, a + 16384)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("qid").take(pa.array(q[part])), batch.column("qvec").take(pa.array(q[part])), pa.array(cell[part].astype(np.int32)), pa.array(within[part].astype(np.int32))],
                    ["qid", "qvec", "cell", "slice"])

    return queries.mapInArrow(run, ROUTE)


def _scan(index: VectorIndex, routes: DataFrame, k: int, blocks: int) -> DataFrame:
    """The best ``k`` of each list slice for every query routed to it: qid, id, score."""
    metric = index.metric

    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if members.num_rows and asked.num_rows:
            m, q, ids = _matrix(members.column("vec")), _matrix(asked.column("qvec")), members.column("id").to_numpy()
            if metric == "cosine":
                norms = (m * m).sum(axis=1)
                score = np.stack([(m * x).sum(axis=1) / np.sqrt((x * x).sum() * norms) for x in q])  # row by row: equal vectors have equal scores
                rank = -score
            else:
                score = rank = np.stack([np.sqrt(((m - x) ** 2).sum(axis=1)) for x in q])
            best = np.stack([np.lexsort((ids, r))[:k] for r in rank])
            out = [np.repeat(asked.column("qid").to_numpy(), best.shape[1]), ids[best].reshape(-1), np.take_along_axis(score, best, 1).reshape(-1)]
        return pa.table({c: pa.array(x) for c, x in zip(HITS.names, out)})

    keys = ["cell", "slice", "block"]
    asked = routes.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    needed = asked.select(*keys).distinct()
    members = index.rows.join(needed, ["cell", "slice"]).select(*[F.col(c).alias(c) for c in (*keys, "id", "vec")])
    return members.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, HITS)


def search(index: VectorIndex | None, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, block_queries: int = 2048) -> DataFrame:
    """Nearest items per query: ``qid``, ``id``, ``score`` (cosine, or the L2 distance), ``position`` (from 1; ties to the smaller id).

    ``queries``: qid bigint, qvec; unusable vectors have no result. ``probes``: cells looked at. ``exact``: further
    cells are read until none can hold a nearer item.
    """
    spark = queries.sparkSession
    schema = "qid long, id long, score double, position int"
    if index is None:
        return spark.createDataFrame([], schema)
    asked = usable(queries.select(F.col("qid").cast("long").alias("qid"), "qvec"), "qvec", index.metric)
    order = [F.col("score").desc() if index.metric == "cosine" else F.col("score").asc(), F.col("id")]
    best = lambda hits: top_n(hits, ["qid"], order, k, "position").select("qid", "id", "score", F.col("position").cast("int").alias("position"))
    if exact:
        asked = cut_lineage(asked, "vector-queries")
    blocks = max(1, -(-asked.count() // block_queries))
    first = _scan(index, _routes(index, asked, lambda batch, near, bound: np.arange(near.shape[1])[None, :] < probes), k, blocks)
    if not exact:
        return best(first)
    first = cut_lineage(best(first), "vector-probes")
    return best(first.drop("position").unionByName(_scan(index, exact_routes(index, asked, first, k, probes), k, blocks)))


def exact_routes(index: VectorIndex, asked: DataFrame, found: DataFrame, k: int, probes: int) -> DataFrame:
    """Cells beyond the first ``probes`` that may hold something as near as the k-th of ``found``."""
    far = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))) if index.metric == "cosine" else F.col("score")
    kth = found.filter(F.col("position") == k).select("qid", far.alias("reach"))
    limited = asked.join(kth, "qid", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))

    def pick(batch: pa.RecordBatch, near: np.ndarray, bound: np.ndarray) -> np.ndarray:
        reach = batch.column("reach").to_numpy()[:, None]
        return (np.arange(near.shape[1])[None, :] >= probes) & (bound <= reach + SLACK * (1 + np.where(np.isinf(reach), 0, reach)))

    return _routes(index, limited, pick)


def scored_pairs(index: VectorIndex, routes: DataFrame) -> int:
    """How many (query, item) pairs these routes score."""
    per = F.element_at(F.lit([float(n) / s for n, s in zip(index.sizes, index.slices)]), F.col("cell") + 1)
    return int(round(routes.agg(F.coalesce(F.sum(per), F.lit(0.0))).first()[0]))
