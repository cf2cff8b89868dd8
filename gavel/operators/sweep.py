"""Sorted sweeps over (key, time): neighbours in time without a join per time bucket.

Rows are dealt by range of (key, time), so a key with very many rows is split by time into tasks of equal size. A row near the edge
of its range is handed to every range that has rows of its key within the horizon as well. Each range is then sorted
and read once. Ranges have ``RANGE_ROWS`` rows on average, and the driver holds two rows per range.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.session import cut_lineage

#: Rows of a range, and result rows handed on at once.
RANGE_ROWS, GIVEN = 100_000, 50_000


def sweep_key(keys: Sequence[str]) -> Column:
    """One text for a row's keys; null if one of them is."""
    texts = [F.col(k).cast("string") for k in keys]
    return F.when(~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.concat_ws("\u001f", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]))


def swept(rows: DataFrame, horizon_us: int, run: Callable[[dict[str, np.ndarray], pa.Table], Iterator[pa.Table]], schema: T.StructType, ranges: int | None = None) -> DataFrame:
    """``run`` over every range of ``rows`` (columns __k text, __t micros, others; null keys and times are dropped).

    It gets the sorted range as an Arrow table and, as arrays, ``t``, ``own`` (false for rows handed over, which belong to another
    range), and ``run`` (equal for rows of one key). It yields tables of ``schema``.
    """
    rows = rows.filter(F.col("__k").isNotNull() & F.col("__t").isNotNull())
    ranges = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    tie = F.xxhash64(*[c for c in rows.columns if c not in ("__k", "__t")]).alias("__tie")
    dealt = rows.select("*", tie).repartitionByRange(ranges, "__k", "__t", "__tie").drop("__tie")
    marked = cut_lineage(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    ends = marked.groupBy("__part").agg(F.min(F.struct("__k", "__t")).alias("lo"), F.max(F.struct("__k", "__t")).alias("hi")).orderBy("__part").collect()  # one row per range
    parts, first, last = [r["__part"] for r in ends], [tuple(r.lo) for r in ends], [tuple(r.hi) for r in ends]
    place = {p: i for i, p in enumerate(parts)}

    def hand_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, t = batch.column("__part").to_numpy(), batch.column("__t").to_numpy()
            at = np.arange(batch.num_rows)
            source, target = [at], [part]
            for p in np.unique(part).tolist():
                (k0, t0), (k1, t1) = first[place[p]], last[place[p]]
                key = batch.column("__k")
                is_first, is_last = (np.asarray(pa.compute.equal(key, k)) for k in (k0, k1))
                edge = np.flatnonzero((part == p) & ((is_first & (t - t0 <= horizon_us)) | (is_last & (t1 - t <= horizon_us))))
                for i in edge.tolist():
                    k = k0 if is_first[i] else k1
                    low, high = bisect_left(last, (k, int(t[i]) - horizon_us)), bisect_right(first, (k, int(t[i]) + horizon_us))
                    others = [q for q in parts[low:high] if q != p]
                    source.append(np.full(len(others), i))
                    target.append(np.array(others, part.dtype))
            source, target = np.concatenate(source), np.concatenate(target)
            out = batch.take(pa.array(source))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(target.astype(np.int32)), pa.array(target == part[source])], [*out.schema.names, "__target", "__own"])

    handed = marked.mapInArrow(hand_over, T.StructType([*marked.schema.fields, T.StructField("__target", T.IntegerType()), T.StructField("__own", T.BooleanType())]))
    placed = handed.drop("__part").repartitionById(max(parts, default=0) + 1, "__target").sortWithinPartitions("__target", "__k", "__t")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("__k").combine_chunks()
            new = np.concatenate([[True], np.asarray(pa.compute.not_equal(key[1:], key[:-1]))]) if len(key) > 1 else np.ones(1, bool)
            arrays = {"t": table.column("__t").to_numpy(), "own": table.column("__own").to_numpy(zero_copy_only=False), "run": np.cumsum(new)}
            for out in run(arrays, table):
                yield from out.to_batches()

    return placed.mapInArrow(sweep, schema)


def _bounds(run: np.ndarray, t: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of a sorted range the first row of its key not before t - horizon, and the one behind the last not after t + horizon."""
    low, high = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    heads = [*np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])).tolist(), len(t)]
    for a, b in zip(heads, heads[1:]):
        own = t[a:b]
        low[a:b], high[a:b] = a + np.searchsorted(own, own - horizon), a + np.searchsorted(own, own + horizon, side="right")
    return low, high


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def siblings(anchors: DataFrame, rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, window_s: int, ranges: int | None = None) -> DataFrame:
    """(anchor_id, sibling_id, keys): rows of the same keys within ± ``window_s`` seconds of an anchor, itself included."""
    columns = [sweep_key(keys).alias("__k"), micros(ts).alias("__t"), F.col(row_id).alias("__id"), *keys]
    both = anchors.select(*columns, F.lit(True).alias("__anchor")).unionByName(rows.select(*columns, F.lit(False).alias("__anchor")))
    horizon = window_s * 1_000_000
    id_type = both.schema["__id"].dataType
    schema = T.StructType([T.StructField("anchor_id", id_type), T.StructField("sibling_id", id_type), *[T.StructField(k, both.schema[k].dataType) for k in keys]])

    def run(arrays: dict[str, np.ndarray], table: pa.Table) -> Iterator[pa.Table]:
        anchor = table.column("__anchor").to_numpy(zero_copy_only=False)
        low, high = _bounds(arrays["run"], arrays["t"], horizon)
        asked = np.flatnonzero(anchor & arrays["own"])
        upto = np.concatenate([[0], np.cumsum(high[asked] - low[asked])])
        a = 0
        while a < len(asked):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + GIVEN)))
            times = high[asked[a:b]] - low[asked[a:b]]
            left = np.repeat(asked[a:b], times)
            right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[asked[a:b]], times)
            met = ~anchor[right]
            left, right = pa.array(left[met]), pa.array(right[met])
            yield pa.table([table.column("__id").take(left), table.column("__id").take(right), *[table.column(k).take(left) for k in keys]], names=schema.names)
            a = b

    return swept(both, horizon, run, schema, ranges)


def nearest(left: DataFrame, right: DataFrame, key: str, ts: str, tolerance_s: int, values: Sequence[str], row_id: str, ranges: int | None = None) -> DataFrame:
    """Every left row that has one, with the right row of its key nearest in time within the tolerance (the earlier one on ties, then the
    smallest values): row_id, key, near_ts, near_…"""
    packed = F.struct(*[F.col(v).alias(f"near_{v}") for v in values])
    # of right rows at one moment only one can be the answer
    marks = right.groupBy(key, F.col(ts).alias("near_ts")).agg(F.min(packed).alias("__v"))
    a = left.select(sweep_key([key]).alias("__k"), micros(ts).alias("__t"), F.col(row_id), F.col(key), F.lit(None).cast(marks.schema["near_ts"].dataType).alias("near_ts"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), F.lit(True).alias("__asks"))
    b = marks.select(sweep_key([key]).alias("__k"), micros("near_ts").alias("__t"), F.lit(None).cast(a.schema[row_id].dataType).alias(row_id), key, "near_ts", "__v", F.lit(False).alias("__asks"))
    both, horizon = a.unionByName(b), tolerance_s * 1_000_000
    schema = T.StructType([both.schema[row_id], both.schema[key], both.schema["near_ts"], both.schema["__v"]])

    def run(arrays: dict[str, np.ndarray], table: pa.Table) -> Iterator[pa.Table]:
        t, group = arrays["t"], arrays["run"]
        asks = table.column("__asks").to_numpy(zero_copy_only=False)
        asked, marked = np.flatnonzero(asks & arrays["own"]), np.flatnonzero(~asks)
        if not len(asked) or not len(marked):
            return
        order = np.lexsort((asks, t, group))  # marks at the asked moment stand before it
        rank = np.empty(len(t), np.int64)
        rank[order] = np.arange(len(t))
        marked = marked[np.argsort(rank[marked])]
        after = np.searchsorted(rank[marked], rank[asked])
        far = np.iinfo(np.int64).max
        pick, gap = np.full(len(asked), -1), np.full(len(asked), far)
        for place in (after - 1, after):
            ok = (place >= 0) & (place < len(marked))
            found = marked[np.clip(place, 0, len(marked) - 1)]
            ok &= group[found] == group[asked]
            distance = np.where(ok, np.abs(t[found] - t[asked]), far)
            better = ok & (distance <= horizon) & (distance < gap)  # the earlier one comes first and keeps a tie
            pick[better], gap[better] = found[better], distance[better]
        hit = pick >= 0
        left, right = pa.array(asked[hit]), pa.array(pick[hit])
        yield pa.table([table.column(row_id).take(left), table.column(key).take(left), table.column("near_ts").take(right), table.column("__v").take(right)], names=schema.names)

    return swept(both, horizon, run, schema, ranges).select(row_id, key, "near_ts", "__v.*")
