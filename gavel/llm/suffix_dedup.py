"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

All strings of ``length`` bytes that start more than once in the corpus are found, and every byte under
one of them goes. Texts that are equal count as one text that occurs several times.

1. Buckets. The suffixes that start in a text are put into buckets by the smallest hash of a 64-byte
   run inside their first ``length`` bytes: equal strings share it. A run of neighbouring suffixes with one
   such hash is shipped as one piece of text, and only if its bucket has another (or repeats itself).
2. One block of buckets is sorted at a time. Suffixes are ordered by their first bytes; longer ties are
   resolved by ranks of a difference-cover sample: two suffixes at any positions have, within ``COVER``
   bytes, a common offset at which both are sampled. Ranks of samples are made by doubling. So a block needs
   memory for its own text only, however long and repetitive it is.
3. A bucket with more than ``hot_runs`` runs is not gathered: the hash of each of its strings is counted
   with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.batches import RangeHash, text_pieces
from gavel.llm.links import keep

#: Bytes of a hashed run, and the period of the difference cover.
GRAM, COVER = 64, 16
#: Bytes of run text in an average block.
BLOCK_BYTES = 4 << 20

_BYTES = RangeHash(4)


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences are all residues, taken greedily."""
    chosen, open_ = [0], set(range(1, period))
    while open_:
        reached = {r: {(r - c) % period for c in chosen} | {(c - r) % period for c in chosen} for r in range(period)}
        best = max(range(period), key=lambda r: (len(reached[r] & open_), -r))
        chosen.append(best)
        open_ = set(range(period)) - {(a - b) % period for a in chosen for b in chosen}
    return np.array(sorted(chosen))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - span : width - span + n])


def suffix_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes with one bucket: (text, start in the text, number, bucket, may repeat itself)."""
    width = length - GRAM + 1
    sizes = np.diff(offsets)
    if len(data) < length or not (sizes >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, bool),)
    prefixes = _BYTES.prefixes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = _BYTES.ranges(prefixes, at, at + GRAM)
    least = _window_minima(grams, width)
    text = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.flatnonzero(text[: len(least)] == text[length - 1 : length - 1 + len(least)])
    least, owner = least[valid], text[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(valid) != 1)
    heads = np.flatnonzero(new)
    number = np.diff(np.append(heads, len(valid)))
    start, bucket = valid[heads], least[heads]
    # a run can hold a string twice only if the bucket's 64 bytes stand twice under it
    names = np.unique(bucket)
    small = np.flatnonzero(grams <= names[-1])
    spot = np.searchsorted(names, grams[small])
    hit = names[spot] == grams[small]
    small, spot = small[hit], spot[hit]
    key = np.sort(spot * (len(data) + 1) + small)
    mine = np.searchsorted(names, bucket) * (len(data) + 1)
    twice = np.searchsorted(key, mine + start + number + width - 1) - np.searchsorted(key, mine + start) > 1
    return owner[heads], start - offsets[owner[heads]], number, bucket.view(np.int64), twice


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key first."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``length`` bytes with another one.
    ``text``: bytes, long enough behind each start."""
    if not len(starts):
        return np.zeros(0, bool)
    cover = difference_cover(COVER)
    padded = np.concatenate([text, np.zeros(2 * length + COVER, np.uint8)])
    n = len(text) + length  # positions that get ranks; strings past the end are compared with zeros on both sides
    words = np.zeros((2, n), np.uint64)
    for half in (0, 1):
        for b in range(8):
            words[half] |= padded[half * 8 + b : half * 8 + b + n].astype(np.uint64) << np.uint64(56 - 8 * b)
    head = _ranks(words[0], words[1])
    del words

    # ranks of sampled suffixes by their first 16, 32, ... bytes, up to the part that must be equal
    sampled = np.isin(np.arange(n) % COVER, cover)
    place = np.cumsum(sampled) - 1
    spots = np.flatnonzero(sampled)
    by_size = {COVER: head[spots]}
    size, goal = COVER, (length - COVER) // COVER * COVER

    def after(ranks: np.ndarray, step: int) -> np.ndarray:
        further = np.minimum(spots + step, n - 1)
        return np.where(spots + step < n, ranks[np.minimum(place[further], len(ranks) - 1)], -1)

    while size * 2 <= goal:
        by_size[size * 2] = _ranks(by_size[size], after(by_size[size], size))
        size *= 2
    rank, covered = by_size[size], size
    while covered < goal:
        size = max(s for s in by_size if s <= goal - covered)
        rank, covered = _ranks(rank, after(by_size[size], covered)), covered + size

    tail = head[starts + length - COVER]
    ends = _ranks(head[starts], tail)
    # `goal` bytes from a sampled offset, the first COVER and the last COVER bytes cover the string; where
    # the length is no multiple of COVER the bytes between are compared through one more head
    if goal + COVER < length:
        ends = _ranks(ends, head[starts + length - 2 * COVER])
    tied = np.bincount(ends)[ends] > 1
    found = np.zeros(len(starts), bool)
    live = np.flatnonzero(tied)
    for offset in range(COVER):
        mine = live[np.isin((starts[live] + offset) % COVER, cover)]
        if len(mine):
            both = _ranks(ends[mine], rank[place[starts[mine] + offset]])
            found[mine] |= np.bincount(both)[both] > 1
    return found


def _intervals(starts: np.ndarray) -> np.ndarray:
    """Ascending starts to rows (first, last) of neighbours."""
    heads = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1])) if len(starts) else np.zeros(0, np.int64)
    return np.stack([starts[heads], starts[np.append(heads[1:], len(starts)) - 1]], axis=1) if len(starts) else np.zeros((0, 2), np.int64)


MARKS = T.StructType([T.StructField("row", T.LongType()), T.StructField("marks", T.BinaryType())])


def _marks(rows: list[int], marks: list[bytes]) -> pa.Table:
    return pa.table({"row": pa.array(rows, pa.int64()), "marks": pa.array(marks, pa.binary())})


def sort_block(table: pa.Table, length: int) -> pa.Table:
    """The repeated strings of a block's runs, as marks of their texts."""
    rows, starts = table.column("row").to_pylist(), table.column("start").to_pylist()
    pieces, buckets = table.column("piece").to_pylist(), table.column("bucket").to_pylist()
    twice = table.column("twice").to_pylist()
    same: dict[tuple[int, bytes], list[int]] = {}
    for i, key in enumerate(zip(buckets, pieces)):
        same.setdefault(key, []).append(i)
    kinds: dict[int, int] = {}
    for bucket, _ in same:
        kinds[bucket] = kinds.get(bucket, 0) + 1
    whole, mixed = [], []
    for key, members in same.items():
        if len(members) > 1:
            whole += members  # equal pieces: all their strings are repeated
        if kinds[key[0]] > 1 or twice[members[0]]:
            mixed.append((key[1], members))
    out_rows, out = [], []
    for i in whole:
        out_rows.append(rows[i])
        out.append(np.array([starts[i], starts[i] + len(pieces[i]) - length], "<u4").tobytes())
    if mixed:
        text = np.frombuffer(b"".join(p for p, _ in mixed), np.uint8)
        sizes = np.array([len(p) for p, _ in mixed])
        base = np.cumsum(sizes) - sizes
        number = sizes - length + 1
        inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        found = repeated_starts(text, np.repeat(base, number) + inside, length)
        at = np.cumsum(number) - number
        for (_, members), a, k in zip(mixed, at, number):
            if len(members) == 1 and (hit := np.flatnonzero(found[a : a + k])).size:
                out_rows.append(rows[members[0]])
                out.append((_intervals(hit) + starts[members[0]]).astype("<u4").tobytes())
    return _marks(out_rows, out)


def repeated_strings(rows: DataFrame, length: int, hot_runs: int) -> DataFrame:
    """(row, marks): intervals (first, last start) of repeated strings in distinct texts ``rows`` (__row, __id, __text)."""
    found = T.StructType([T.StructField("row", T.LongType()), T.StructField("start", T.LongType()), T.StructField("number", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("twice", T.BooleanType())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_pieces(batches, "__text"):
            owner, start, number, bucket, twice = suffix_runs(data, offsets, length)
            row = part.column(0).to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, start, number, bucket, twice)], found.names)

    every = rows.select("__row", "__text").mapInArrow(runs, found).distinct()
    every = keep(every, "runs")
    sizes = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("runs"), F.max("twice").alias("twice")).filter("runs > 1 or twice").drop("twice")
    shared = keep(every.join(sizes, "bucket"), "shared")
    bytes_ = shared.agg(F.sum(F.col("number") + length)).first()[0] or 0
    blocks = max(16, -(-bytes_ // BLOCK_BYTES))
    wanted = shared.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "number", "bucket", "twice", "runs")).alias("__runs"))
    first = rows.groupBy("__row").agg(F.min("__id").alias("__first"))
    ship = T.StructType([T.StructField("block", T.IntegerType()), *(found[c] for c in ("row", "start", "bucket", "twice")), T.StructField("runs", T.LongType()), T.StructField("piece", T.BinaryType())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode()
                runs_ = batch.column(2)[i].as_py()
                cut = [raw[r["start"] : r["start"] + r["number"] + length - 1] for r in runs_]
                columns = [[(r["bucket"] % blocks) for r in runs_], [batch.column(0)[i].as_py()] * len(runs_), *([r[c] for r in runs_] for c in ("start", "bucket", "twice", "runs")), cut]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], ship.names)

    one = wanted.join(first, "__row").join(rows, "__row").filter(F.col("__id").eqNullSafe(F.col("__first"))).select("__row", "__text", "__runs")
    shipped = one.mapInArrow(pieces, ship)
    cold = shipped.filter(F.col("runs") <= hot_runs).groupBy("block").applyInArrow(lambda table: sort_block(table, length), MARKS)
    return cold.unionByName(_hot(shipped.filter(F.col("runs") > hot_runs), length)) if shared.filter(F.col("runs") > hot_runs).limit(1).count() else cold


def _hot(shipped: DataFrame, length: int) -> DataFrame:
    """Marks of crowded buckets by counting the hash of every string."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("start", T.LongType()), T.StructField("strings", T.ArrayType(T.LongType()))])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for piece in batch.column(2).to_pylist():
                data = np.frombuffer(piece, np.uint8)
                at = np.arange(len(data) - length + 1)
                values.append(_BYTES.ranges(_BYTES.prefixes(data), at, at + length).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int64()))], schema.names)

    each = shipped.select("row", "start", "piece").mapInArrow(strings, schema).select("row", "start", F.posexplode("strings").alias("i", "string")).select("row", (F.col("start") + F.col("i")).alias("at"), "string")
    often = each.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string")
    starts = each.join(often, "string").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("at"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_intervals(np.array(v, np.int64)).astype("<u4").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], MARKS.names)

    return starts.mapInArrow(marks, MARKS)


def text_number(docs: DataFrame, text: Column) -> Column:
    """A number of each text that no unlike text of the table shares: hashes with one salt after another, compared by SHA-256."""
    for salt in range(64):
        number = F.xxhash64(F.lit(salt), text, F.octet_length(text))
        texts = docs.select(number.alias("number"), F.sha2(text, 256).alias("digest")).groupBy("number").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
        if texts.filter("least <> most").isEmpty():
            return number
    raise RuntimeError("no salt gives every text a number of its own")


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = 6000, whole_characters: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept`` (the remaining bytes, in order). One row per input row.

    A byte goes if some ``length`` bytes over it also start anywhere else, in the same or another row; strings
    are judged on the input and never cross texts. With ``whole_characters`` a character goes if one of its bytes
    does, so ``kept`` is UTF-8. Null and empty texts have no bytes. Equal rows, and rows
    without or with one id, are texts like all others. Further columns pass through, whatever their names
    (but for the four that are added and ``__row``, ``__marks``).
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    text = F.coalesce(docs[text_col], F.lit(""))
    row = text_number(docs, text)
    rows = docs.select(row.alias("__row"), docs[id_col].alias("__id"), text.alias("__text")).filter(F.octet_length("__text") >= length)
    copies = rows.groupBy(F.col("__row").alias("row")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    everything = copies.select("row", F.unhex(F.lit("00000000ffffff7f")).alias("marks"))
    marks = repeated_strings(rows, length, hot_runs).unionByName(everything)
    by_row = marks.groupBy(F.col("row").alias("__marked")).agg(F.collect_list("marks").alias("__marks"))
    names = docs.columns
    added = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]
    joined = docs.withColumn("__row", row).join(by_row, F.col("__row") == F.col("__marked"), "left").drop("__row", "__marked")
    schema = T.StructType([*docs.schema.fields, *added])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_pieces(batches, text_col):
            lists = part.column(len(names)).to_pylist()
            edges = np.zeros(len(data) + 1, np.int64)
            for i, found in enumerate(lists):
                size = int(offsets[i + 1] - offsets[i])
                if found and size >= length:
                    pairs = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2).astype(np.int64)
                    np.add.at(edges, offsets[i] + pairs[:, 0], 1)
                    np.add.at(edges, offsets[i] + np.minimum(pairs[:, 1], size - length) + length, -1)
            gone = np.cumsum(edges[:-1]) > 0
            if whole_characters and len(data):
                heads = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_or.reduceat(gone, heads), np.diff(np.append(heads, len(data))))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[offsets[:-1][np.diff(offsets) > 0]] |= gone[offsets[:-1][np.diff(offsets) > 0]]
            count = lambda mask: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])[offsets])
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(~gone)])[offsets]
            kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(upto)), pa.py_buffer(data[~gone])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(np.diff(offsets)), pa.array(count(gone)), pa.array(count(opens)), kept], schema.names)

    return joined.mapInArrow(apply, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 399)) AS i, h FROM d WHERE length(h) >= 800),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS m FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM k) WHERE c > 1),
e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS opens FROM r),
g AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
p AS (SELECT doc_id, span, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY ALL),
b AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM p),
x AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
             string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
      FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(x.n_removed, 0) AS BIGINT) AS n_removed, coalesce(x.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN x.doc_id IS NULL THEN d.h ELSE x.kept || substr(d.h, 2 * x.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
