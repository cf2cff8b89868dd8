"""Substring dedup by fixed-block anchors.

A window is ``window`` consecutive words. Wherever a text repeats a window of an earlier document, the
window contains one of that document's non-overlapping blocks of ``(window + 1) // 2`` words.

1. Blocks of every document are indexed; every rolling run of that many words of every document probes
   them (blocks are runs as well, so they travel with the probes). What is hit under a smaller id, and the blocks that were hit, are anchors.
2. Anchors are extended: the windows around a hit probe are compared, as whole word sequences by a
   64-bit hash, with the windows around the hit blocks. Overlapping windows unite to maximal repeats.

Both steps ship packed arrays (``packed``); probing is one lookup per word, and no pairs of documents are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.batches import BLANK, Words, text_pieces, word_runs, word_windows
from gavel.llm.packed import INDEX, PROBE, SHIPPED, Gatherer, buckets_for, match_earlier, places_of, shipped


def _spread(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Whether each of n positions lies in [a - before, a + after] of some a."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.maximum(at - before, 0), 1)
    np.add.at(edges, np.minimum(at + after + 1, n), -1)
    return np.cumsum(edges[:-1]) > 0


def _ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row hashes, ids, and which rows have an id."""
    return rows.column(0).to_numpy(), rows.column(1).fill_null(0).to_numpy(), rows.column(1).is_valid().to_numpy(zero_copy_only=False)


def _emit(gatherers: dict[int, Gatherer], values: Iterator) -> Iterator[pa.RecordBatch]:
    for which, *args in values:
        if out := list(gatherers[which].add(*args)):
            yield shipped(out)
    for g in gatherers.values():
        if out := list(g.ship()):
            yield shipped(out)


def repeated_windows(docs: DataFrame, window: int, buckets: int, bits: int) -> DataFrame:
    """(__row, __probe): for rows of ``docs`` (__row, __id, __text) the first words of all windows
    that also start in a document with a smaller id."""
    block = (window + 1) // 2
    reach = window - block

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values():
            for rows, data, offsets in text_pieces(batches, "__text"):
                row, ident, named = _ids(rows)
                words = Words(data, offsets)
                at, hashes = word_windows(words, block)
                at, hashes = at[named[words.doc[at]]], hashes[named[words.doc[at]]]
                yield PROBE, hashes, at, row, ident, words.first[:-1], len(words.start)

        yield from _emit({PROBE: Gatherer(PROBE, buckets, bits)}, values())

    def extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values():
            for rows, data, offsets in text_pieces(batches, "__text"):
                row, ident, _ = _ids(rows)
                words = Words(data, offsets)
                total = len(words.start)
                for kind, name in ((INDEX, "__index"), (PROBE, "__probe")):
                    hit = places_of(rows.column(rows.schema.get_field_index(name)), words.first)
                    # windows that contain the run of words at a hit start up to ``reach`` words before it
                    start = np.flatnonzero(_spread(hit, reach, 0, total))
                    start = start[start + window <= words.first[words.doc[start] + 1]]
                    yield kind, word_runs(words, start, start + window), start, row, ident, words.first[:-1], total

        yield from _emit({k: Gatherer(k, buckets) for k in (INDEX, PROBE)}, values())

    hits = match_earlier(docs.mapInArrow(anchors, SHIPPED), buckets, index_too=True, index_step=block)
    around = docs.join(hits, "__row").select("__row", "__id", "__text", "__index", "__probe")
    return match_earlier(around.mapInArrow(extensions, SHIPPED), buckets, index_too=False)


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_removed``, ``kept_text`` (the words that stay,
    joined by one blank).

    A word goes if a window over it, judged on the input, also starts in a document with a smaller id.
    Null and empty texts have no words. A row without an id removes and loses nothing; rows that repeat
    an id do not remove each other's words. Other columns are not read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    given = docs.select(docs[id_col].cast("long").alias("__id"), text.alias("__text"))
    # equal rows have equal results, so the id with 16 bits of the text's hash names a row (and, unlike a
    # hash, neighbours' names differ little, which packs well)
    hashed = F.xxhash64("__text")
    name = F.shiftleft("__id", 16).bitwiseXOR(hashed.bitwiseAND(F.lit(0xFFFF)))
    rows = given.select(F.coalesce(name, hashed).alias("__row"), "__id", "__text")
    size = given.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    # anchors are compared by so many bits of their hash that about one probe in 4000 is hit by chance (and
    # is refused when it is extended)
    found = repeated_windows(rows, window, buckets_for(size // 5), min(64, max(32, (size // 32).bit_length() + 12)))
    schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_pieces(batches, "__text"):
            words = Words(data, offsets)
            total, n = len(words.start), part.num_rows
            hit = places_of(part.column(part.schema.get_field_index("__probe")), words.first)
            gone = _spread(hit, 0, window - 1, total)
            stay = np.flatnonzero(~gone)
            doc = words.doc[stay]
            later = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(stay) else np.zeros(0, bool)
            edges = np.zeros(len(data) + 1, np.int64)
            np.add.at(edges, words.start[stay] - later, 1)  # with one blank before all but the first
            np.add.at(edges, words.end[stay], -1)
            mask = np.cumsum(edges[:-1]) > 0
            out = np.where(BLANK[data], np.uint8(0x20), data)[mask]
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])[offsets]
            kept = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.ascontiguousarray(upto)), pa.py_buffer(out)]).cast(pa.string())
            counts = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(counts), pa.array(np.bincount(words.doc[gone], minlength=n)), kept], schema.names)

    joined = rows.join(found, "__row", "left").select("__row", "__id", "__text", "__probe")
    return joined.mapInArrow(apply, schema).select(F.col("__id").alias(id_col), "n_words", "n_removed", "kept_text")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
), h AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS t FROM g),
m AS (SELECT t, min(doc_id) AS first_id FROM h GROUP BY t),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT h.doc_id, h.i, unnest(range(13)) AS k FROM h JOIN m USING (t) WHERE h.doc_id > m.first_id)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, count(c.i) AS n_removed, coalesce(string_agg(x.word, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '') AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
