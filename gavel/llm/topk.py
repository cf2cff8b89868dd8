"""Exact top-k inner products by block-at-a-time pruning.

Vectors of integers are documents, their dimensions terms. They are put in an order in which alike vectors are near
(the signs of fixed random projections, then the id) and cut into ranges, the blocks. A block holds its forward index, the
codes of its vectors, and for every term the largest and smallest code in it. For a query the
sum of its terms times these maxima (minima where the query is negative) bounds every score in the block. A query
takes blocks by falling bound and scores them through their forward index until the bounds fall below
its k-th score: ties are still scored, so the result is exact.

A shard is the blocks of one partition of the order and has maxima of its own. Each query first searches the one shard
with the highest bound; its k-th score there then decides which other shards it meets at all. Queries meet shards in
blocks of bounded size; a shard is read only for blocks of queries that need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.links import keep

#: Vectors of a block and blocks that a query takes between two looks at its k-th score.
BLOCK_ROWS, WAVE = 64, 8
#: Signs in the order's key.
KEY_BITS = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1

INDEX = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("ids", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("high", T.BinaryType()), T.StructField("low", T.BinaryType()),
])
ROUTES = T.StructType([T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("bound", T.LongType())])
HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``dim``, ``codes`` = floor(scale * x): vectors without null or non-finite components. Of rows that repeat an
    id the greatest vector counts; null ids take no part. A code beyond a long is the end of its range."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~odd)
    one = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(v).alias("v"))
    codes = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(LEAST))), F.lit(float(MOST)))))
    return one.select("id", F.size("v").alias("dim"), codes.alias("codes"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, exact: in doubles while these hold the sums, then in longs, then in Python integers whose
    result is cut to the range of a long."""
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    reach = top(a) * top(b) * max(1, a.shape[1])
    if reach < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach <= MOST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a query with a vector between ``low`` and ``high`` is larger; (queries, blocks)."""
    return product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1), np.concatenate([high, low], axis=1))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _raw(rows: list[bytes], dim: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(r, "<i8") for r in rows]).reshape(-1, dim) if dim else np.zeros((len(rows), 0), np.int64)


def order_key(dim: int, codes: np.ndarray, seed: int = 5) -> np.ndarray:
    planes = np.random.default_rng(seed + dim).standard_normal((dim, KEY_BITS))
    signs = codes.astype(np.float64) @ planes > 0
    return signs @ (1 << np.arange(KEY_BITS - 1, -1, -1))


def build_index(rows: DataFrame, shards: int, block_rows: int) -> DataFrame:
    """One row per block, and one with ``block`` = -1 for each shard (dim, part): the maxima of the whole of it."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                keys[at] = order_key(int(dim), _matrix(batch.column("codes").take(pa.array(at)), int(dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], [*batch.schema.names, "key"])

    def packed(dim, part, block, ids, codes):
        return {"dim": dim, "part": part, "block": block, "ids": ids.astype("<i8").tobytes(), "codes": codes.astype("<i8").tobytes(), "high": codes.max(axis=0).tobytes(), "low": codes.min(axis=0).tobytes()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("ids", "codes", "high", "low")]])
        ids, codes, dim, part, blocks, top = [], [], None, None, 0, None

        def flush(whole: bool) -> list[dict]:
            nonlocal ids, codes, blocks, top
            out = []
            if ids:
                i, c = np.concatenate(ids), np.concatenate(codes)
                last = len(i) if whole else len(i) - len(i) % block_rows
                for a in range(0, last, block_rows):
                    out.append(packed(dim, part, blocks, i[a : min(last, a + block_rows)], c[a : min(last, a + block_rows)]))
                    blocks += 1
                if last:
                    both = c[:last] if top is None else np.concatenate([top, c[:last]])
                    top = np.stack([both.max(axis=0), both.min(axis=0)])
                ids, codes = [i[last:]], [c[last:]]
            if whole and top is not None:
                out.append(packed(dim, part, -1, np.zeros(0, np.int64), top))
                ids, codes, blocks, top = [], [], 0, None
            return out

        for batch in batches:
            dims, parts = batch.column("dim").to_numpy(), batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(dims)]
            for a, b in zip(edges, edges[1:]):
                done = flush(True) if (dims[a], parts[a]) != (dim, part) else []
                dim, part = int(dims[a]), int(parts[a])
                ids.append(batch.column("id").slice(a, b - a).to_numpy())
                codes.append(_matrix(batch.column("codes").slice(a, b - a), dim))
                if sum(map(len, ids)) >= 16 * block_rows:
                    done += flush(False)
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema)
        if done := flush(True):
            yield pa.RecordBatch.from_pylist(done, schema)

    with_key = rows.mapInArrow(keyed, T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())]))
    ranged = with_key.repartitionByRange(shards, "dim", "key", "id").sortWithinPartitions("dim", "key", "id")
    return ranged.select("dim", F.spark_partition_id().alias("part"), "id", "codes").mapInArrow(cut, INDEX)


def search_blocks(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, ids: list[np.ndarray], blocks: list[np.ndarray], high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best ``k`` of each query that reach its ``floor``: places in use, ids, scores; and how many blocks were scored."""
    bound = _bounds(queries, high, low)
    order = np.argsort(~bound, axis=1, kind="stable")  # falling, and nothing overflows
    best, owner, used = np.full((len(queries), k), LEAST), np.full((len(queries), k), MOST), np.zeros((len(queries), k), bool)
    floor, scored = floor.copy(), 0
    for first in range(0, len(blocks), WAVE):
        chosen = order[:, first : first + WAVE]
        at, place = np.nonzero(np.take_along_axis(bound, chosen, 1) >= floor[:, None])
        if not len(at):
            break
        block_of = chosen[at, place]
        by = np.argsort(block_of, kind="stable")
        at, block_of = at[by], block_of[by]
        heads = np.flatnonzero(np.concatenate([[True], block_of[1:] != block_of[:-1]]))
        for a, b in zip(heads, [*heads[1:], len(at)]):
            rows, block = at[a:b], int(block_of[a])
            scored += len(rows)
            score = product(queries[rows], blocks[block])
            names = np.broadcast_to(ids[block], score.shape)
            real = names != own[rows, None]
            real &= score >= floor[rows, None]
            if not real.any():
                continue
            score, names, real = np.concatenate([best[rows], score], 1), np.concatenate([owner[rows], names], 1), np.concatenate([used[rows], real], 1)
            # scores fall as their complement rises; unused places come last
            pick = np.lexsort((names, ~score, ~real), axis=-1)[:, :k]
            best[rows], owner[rows], used[rows] = (np.take_along_axis(x, pick, 1) for x in (score, names, real))
            full = used[rows, k - 1]
            floor[rows[full]] = np.maximum(floor[rows[full]], best[rows[full], k - 1])
    return used, owner, best, scored


def top_inner_products(
    items: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = 1024,
    shard_rows: int = 4096,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` largest inner products of floor(scale * x), ties to the
    smaller id; fewer where there are fewer candidates. A query is never its own candidate.

    Only vectors of one dimension are compared. Null vectors and ids and vectors with null or non-finite components
    take no part; of rows that repeat an id the greatest vector counts; an empty side gives no rows. Scores beyond a long
    are the end of its range. Other columns are not read. Vectors without structure give bounds that
    prune little: all blocks are then scored, which is the work of comparing all.
    """
    rows = integer_vectors(items, scale, id_col, vector_col)
    shards = max(1, -(-rows.count() // shard_rows))
    index = keep(build_index(rows, shards, block_rows), "block-index")
    blocks, tops = index.filter("block >= 0"), index.filter("block = -1").select("dim", "part", "high", "low")
    asked = keep(integer_vectors(queries, scale, id_col, vector_col), "block-queries")
    pieces = max(1, -(-asked.count() // block_queries))
    top_pieces = max(1, -(-tops.count() // 1024))
    asked = asked.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int"))

    def route(wanted: DataFrame, only_best: bool) -> DataFrame:
        """Shards whose bound reaches a query's floor; ``only_best``: of each group of shards the one with the highest bound."""

        def run(asked_table: pa.Table, top_table: pa.Table) -> pa.Table:
            out = {"id": np.zeros(0, np.int64), "part": np.zeros(0, np.int64), "bound": np.zeros(0, np.int64)}
            if asked_table.num_rows and top_table.num_rows:
                dim = asked_table.column("dim")[0].as_py()
                ids, parts = asked_table.column("id").to_numpy(), top_table.column("part").to_numpy()
                bound = _bounds(_matrix(asked_table.column("codes"), dim), *(_raw(top_table.column(c).to_pylist(), dim) for c in ("high", "low")))
                if only_best:
                    q, s = np.arange(len(ids)), bound.argmax(axis=1)
                else:
                    wanted_shards = (bound >= asked_table.column("floor").to_numpy()[:, None]) & (parts[None, :] != asked_table.column("seed").to_numpy()[:, None])
                    q, s = np.nonzero(wanted_shards)
                out = {"id": ids[q], "part": parts[s], "bound": bound[q, s]}
            return pa.table({"id": pa.array(out["id"], pa.int64()), "part": pa.array(out["part"].astype(np.int32), pa.int32()), "bound": pa.array(out["bound"], pa.int64())})

        keys = ["dim", "piece", "tops"]
        left = wanted.withColumn("tops", F.explode(F.sequence(F.lit(0), F.lit(top_pieces - 1))))
        right = tops.select("dim", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.pmod("part", F.lit(top_pieces)).alias("tops"), "part", "high", "low")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, ROUTES)

    def search(wanted: DataFrame) -> DataFrame:
        """Hits of the queries in ``wanted`` (id, dim, codes, piece, part, floor) in their shards."""

        def run(block_table: pa.Table, asked_table: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64)] * 3
            if block_table.num_rows and asked_table.num_rows:
                dim = asked_table.column("dim")[0].as_py()
                ids = [np.frombuffer(x, "<i8") for x in block_table.column("ids").to_pylist()]
                codes = [np.frombuffer(x, "<i8").reshape(len(i), dim) for i, x in zip(ids, block_table.column("codes").to_pylist())]
                own = asked_table.column("id").to_numpy()
                used, names, score, _ = search_blocks(
                    _matrix(asked_table.column("codes"), dim), own, asked_table.column("floor").to_numpy(), ids, codes,
                    *(_raw(block_table.column(c).to_pylist(), dim) for c in ("high", "low")), k)
                q, place = np.nonzero(used)
                out = [own[q], names[q, place], score[q, place]]
            return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(HITS.names, out)})

        keys = ["dim", "part", "piece"]
        needed = blocks.join(wanted.select(*keys).distinct(), ["dim", "part"])
        needed = needed.select(*[F.col(c).alias(c) for c in needed.columns])  # columns of its own, as both sides come from ``wanted``
        return needed.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, HITS)

    seeds = route(asked, only_best=True).groupBy("id").agg(F.max_by("part", F.struct("bound", "part")).alias("seed"))
    seeded = keep(asked.join(seeds, "id"), "block-seeds")
    first = keep(search(seeded.select("id", "dim", "codes", "piece", F.col("seed").alias("part"), F.lit(LEAST).alias("floor"))), "block-first")
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    floored = seeded.join(kth, "id", "left").withColumn("floor", F.coalesce("kth", F.lit(LEAST))).drop("kth")
    routes = route(floored, only_best=False).select("id", "part")
    rest = search(floored.select("id", "dim", "codes", "piece", "floor").join(routes, "id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT))) AS codes
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), terms AS (
  SELECT vec_id, len(codes) AS dim, generate_subscripts(codes, 1) AS i, unnest(codes) AS c FROM usable
), scores AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(sum(q.c * d.c) AS BIGINT) AS score
  FROM terms q JOIN terms d ON q.i = d.i AND q.dim = d.dim AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
