"""Hash joins of very many small values, shipped as packed arrays instead of rows.

A task sorts its (hash, place) values and cuts them into buckets of the hash range; every bucket's
share travels as one binary: differences of the sorted hashes and the places in byte planes,
compressed. A bucket is then matched in NumPy. Buckets have a bounded number of values on average, whatever
the size of the input: the caller chooses their number by the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gavel.llm.batches import mix64

#: Values that a task gathers before it ships them, and the values of an average bucket.
GATHERED, BUCKET_VALUES = 1 << 21, 2_000_000

SHIPPED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("payload", T.BinaryType())])
REPLIES = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("payload", T.BinaryType())])
PLACES = T.StructType([T.StructField("__row", T.LongType()), T.StructField("__index", T.BinaryType()), T.StructField("__probe", T.BinaryType())])


def buckets_for(values: int) -> int:
    return max(16, -(-values // BUCKET_VALUES))


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").reshape(-1), at + n * width


def pack(hashes: np.ndarray, places: np.ndarray, rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> bytes:
    """``hashes`` ascending; ``places`` index a sequence in which row i (``rows[i]``, with
    its document's id ``order[i]``) begins at ``first[i]``."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    used = np.unique(np.searchsorted(first, places, side="right") - 1)
    offset = np.zeros(len(first), np.int64)
    offset[used] = np.arange(len(used))
    head = np.array([len(hashes), len(used)], "<u8").tobytes()
    table = b"".join(_planes(np.diff(c, prepend=c.dtype.type(0)).view(np.uint64), 8) for c in (rows[used].astype(np.int64), order[used].astype(np.int64), first[used].astype(np.int64)))
    return zstandard.ZstdCompressor(level=1).compress(head + _planes(steps, 8) + _planes(places.astype(np.uint64), 4) + table)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, place inside the row, row, order) of a payload's values."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, m = np.frombuffer(raw, "<u8", 2).tolist()
    steps, at = _unplanes(raw, 16, n, 8)
    places, at = _unplanes(raw, at, n, 4)
    columns = []
    for _ in range(3):
        diff, at = _unplanes(raw, at, m, 8)
        columns.append(np.cumsum(diff.view(np.int64)))
    which = np.searchsorted(columns[2], places.astype(np.int64), side="right") - 1
    return np.cumsum(steps), places.astype(np.int64) - columns[2][which], columns[0][which], columns[1][which]


class Gatherer:
    """Values of one kind and task until they are shipped."""

    def __init__(self, kind: int, buckets: int, bits: int = 64):
        self.kind, self.buckets, self.shift = kind, buckets, np.uint64(64 - bits)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.places, self.rows, self.order, self.first, self.count, self.end = [], [], [], [], [], 0, 0

    def add(self, hashes: np.ndarray, places: np.ndarray, rows: np.ndarray, order: np.ndarray, first: np.ndarray, length: int) -> Iterator[tuple[int, int, bytes]]:
        self.hashes.append(hashes)
        self.places.append(places + self.end)
        self.rows.append(rows)
        self.order.append(order)
        self.first.append(first + self.end)
        self.count += len(hashes)
        self.end += length
        if self.count >= GATHERED or self.end >= 1 << 31:
            yield from self.ship()

    def ship(self) -> Iterator[tuple[int, int, bytes]]:
        if self.count:
            hashes, places, rows, order, first = (np.concatenate(x) for x in (self.hashes, self.places, self.rows, self.order, self.first))
            self.clear()
            by = np.argsort(hashes)
            hashes, places = hashes[by], places[by]
            edges = [(b << 64) // self.buckets for b in range(1, self.buckets)]
            cuts = [0, *np.searchsorted(hashes, np.array(edges, np.uint64)).tolist(), len(hashes)]
            for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    yield b, self.kind, pack(hashes[lo:hi] >> self.shift, places[lo:hi], rows, order, first)
        self.clear()


def shipped(values: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v[0] for v in values], pa.int32()), pa.array([v[1] for v in values], pa.int32()), pa.array([v[2] for v in values], pa.binary())], SHIPPED.names)


INDEX, PROBE = 0, 1


def match_earlier(packed: DataFrame, groups: int, index_too: bool, index_step: int = 0) -> DataFrame:
    """Places of probes whose hash is indexed under a smaller id, and (``index_too``) places of
    index values whose hash is probed under a larger one: (__row, __index, __probe), one row per row. They
    return packed as well, each bucket's in ``groups`` parts by row.

    With ``index_step`` nothing is shipped as an index: the probes at multiples of it in their row are the index.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = {INDEX: [], PROBE: []}
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
            parts[kind].append(unpack(payload.as_py()))
        empty = {"group": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())}
        if not parts[PROBE] or not (parts[INDEX] or index_step):
            return pa.table(empty)
        sides = {k: [np.concatenate(c) for c in zip(*v)] for k, v in parts.items() if v}
        if index_step:
            fixed = sides[PROBE][1] % index_step == 0
            sides[INDEX] = [c[fixed] for c in sides[PROBE]]
            if not fixed.any():
                return pa.table(empty)
        del parts
        out_rows, out_kind, out_places = [], [], []
        for kind, other, best in ((PROBE, INDEX, np.minimum), *([(INDEX, PROBE, np.maximum)] if index_too else [])):
            keys, _, _, order = sides[other]
            by = np.argsort(keys, kind="stable")
            keys, order = keys[by], order[by]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            extreme, keys = best.reduceat(order, heads), keys[heads]
            mine, places, rows, own = sides[kind]
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            hit &= (extreme[at] < own) if kind == PROBE else (extreme[at] > own)
            out_rows.append(rows[hit])
            out_kind.append(np.full(int(hit.sum()), kind, np.uint8))
            out_places.append(places[hit])
        rows, kinds, places = np.concatenate(out_rows), np.concatenate(out_kind), np.concatenate(out_places)
        group = (mix64(rows.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        by = np.lexsort((places, kinds, rows, group))
        rows, kinds, places, group = rows[by], kinds[by], places[by], group[by]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        payloads = [_pack_reply(rows[a:b], kinds[a:b], places[a:b]) for a, b in zip(heads, [*heads[1:], len(group)])]
        return pa.table({"group": pa.array(group[heads].astype(np.int32)), "payload": pa.array(payloads, pa.binary())})

    replies = packed.groupBy("bucket").applyInArrow(run, REPLIES)
    return replies.groupBy("group").applyInArrow(_merge_replies, PLACES)


def _pack_reply(rows: np.ndarray, kinds: np.ndarray, places: np.ndarray) -> bytes:
    head = np.array([len(rows)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + _planes(np.diff(rows, prepend=np.int64(0)).view(np.uint64), 8) + kinds.tobytes() + _planes(places.astype(np.uint64), 4))


def _merge_replies(table: pa.Table) -> pa.Table:
    parts = []
    for payload in table.column("payload"):
        raw = zstandard.ZstdDecompressor().decompress(payload.as_py())
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        steps, at = _unplanes(raw, 8, n, 8)
        kinds = np.frombuffer(raw, np.uint8, n, at)
        places, _ = _unplanes(raw, at + n, n, 4)
        parts.append((np.cumsum(steps.view(np.int64)), kinds, places.astype("<u4")))
    rows, kinds, places = (np.concatenate(c) for c in zip(*parts))
    by = np.lexsort((places, kinds, rows))
    rows, kinds, places = rows[by], kinds[by], places[by]
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    found = {k: [] for k in (INDEX, PROBE)}
    for a, b in zip(heads, [*heads[1:], len(rows)]):
        cut = a + int(np.searchsorted(kinds[a:b], PROBE))
        found[INDEX].append(places[a:cut].tobytes())
        found[PROBE].append(places[cut:b].tobytes())
    return pa.table({"__row": pa.array(rows[heads]), "__index": pa.array(found[INDEX], pa.binary()), "__probe": pa.array(found[PROBE], pa.binary())})


def places_of(column: pa.Array, first: np.ndarray) -> np.ndarray:
    """The places of all rows of a batch, counted from where each row begins."""
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, "<u4").astype(np.int64) + first[i] for i, p in enumerate(column.to_pylist()) if p)])
