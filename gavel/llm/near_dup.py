"""Near-duplicates: MinHash signatures in a multi-index Hamming join, confirmed on full shingle sets.

A signature has ``chunks * width`` symbols of 16 bits. Two signatures that differ in fewer than
``chunks * (errors + 1)`` symbols differ in at most ``errors`` symbols of some chunk (pigeonhole). So every
chunk is indexed once for each way to leave out ``errors`` of its symbols, and all pairs under the
distance meet in some bucket.

A bucket never emits all its pairs. First every member meets the bucket's smallest id; confirmed
links are merged to components. Where a bucket then still has several components, its members meet the one
with the fewest shingles of its own, and finally those members of different components that share one of their
rarest shingles, as all pairs of the wanted similarity do. Links between members of one component would add
nothing, so no connection is lost. Documents with the same shingle set are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.batches import Words, mix64, text_pieces, word_runs, word_windows
from gavel.llm.links import components, keep


#: Centres of clouds that a text is compared with at once.
CENTRES = 4


def shingles(data: np.ndarray, offsets: np.ndarray, length: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and where each
    text's begin. A text with fewer words has its whole sequence; without words, nothing."""
    words = Words(data, offsets, lower)
    at, hashes = word_windows(words, length)
    counts = np.diff(words.first)
    few = np.flatnonzero((counts > 0) & (counts < length))
    short = word_runs(words, words.first[few], words.first[few + 1]) if len(few) else np.zeros(0, np.uint64)
    doc, every = np.concatenate([words.doc[at], few]), np.concatenate([hashes, short])
    order = np.lexsort((every, doc))
    doc, every = doc[order], every[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (every[1:] != every[:-1])
    return every[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x51ED2701)).reshape(2, n)


def min_hashes(hashes: np.ndarray, first: np.ndarray, symbols: int) -> np.ndarray:
    """16-bit symbols of the texts' signatures (rows without shingles are zero)."""
    out = np.zeros((len(first) - 1, symbols), np.uint16)
    rows = np.flatnonzero(np.diff(first) > 0)
    if len(rows):
        salt, factor = _multipliers(symbols)
        for j in range(symbols):
            with np.errstate(over="ignore"):
                values = (hashes ^ salt[j]) * (factor[j] | np.uint64(1))
            out[rows, j] = mix64(np.minimum.reduceat(values, first[rows])) & np.uint64(0xFFFF)
    return out


def signatures(docs: DataFrame, words: int, symbols: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n_shingles``, ``set_a`` and ``set_b`` (128-bit hash of the shingle set), ``signature``."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("signature", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_pieces(batches, "__text"):
            hashes, first = shingles(data, offsets, words)
            sums = []
            for salt in (1, 2):
                with np.errstate(over="ignore"):
                    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes + np.uint64(salt)))])
                    sums.append((upto[first[1:]] - upto[first[:-1]]).view(np.int64))
            signed = min_hashes(hashes, first, symbols)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(first)), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in signed], pa.binary())], schema.names
            )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text")).mapInArrow(run, schema)


def chunk_keys(classes: DataFrame, chunks: int, width: int, errors: int) -> DataFrame:
    """(key, rep): the buckets of every class, one for each chunk and choice of left-out symbols."""
    schema = T.StructType([T.StructField("rep", classes.schema["rep"].dataType), T.StructField("keys", T.ArrayType(T.LongType()))])
    left = [np.array(c) for c in combinations(range(width), width - errors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, chunks, width).astype(np.uint64)
            keys = np.zeros((n, chunks, len(left)), np.uint64)
            for v, kept in enumerate(left):
                code = np.zeros((n, chunks), np.uint64)
                for s in kept:
                    code = mix64(code ^ flat[:, :, s])
                keys[:, :, v] = mix64(code + np.arange(chunks, dtype=np.uint64) * np.uint64(len(left)) + np.uint64(v))
            offsets = np.arange(n + 1, dtype=np.int32) * (chunks * len(left))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema.names)

    return classes.select("rep", "signature").mapInArrow(run, schema).select(F.explode("keys").alias("key"), "rep")


def shingle_rows(texts: DataFrame, words: int) -> DataFrame:
    """(rep, hash): the shingles of every text."""
    schema = T.StructType([T.StructField("rep", texts.schema["id"].dataType), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_pieces(batches, "text"):
            hashes, first = shingles(data, offsets, words)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))], schema.names)

    return texts.select("id", "text").mapInArrow(run, schema).select("rep", F.explode("hashes").alias("hash"))


def rare_shingle_pairs(rare: DataFrame, placed: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest shingles.

    ``rare`` (rep, n, hash, pos): of a text with n shingles the n - ceil(per_cent % of n) + 1 rarest, and their position, from 1. Texts
    that are similar enough share at least one of these, in any fixed order of all shingles; and with the first they share no more
    is left behind it in either text than their intersection needs, so later meetings of frequent shingles make no pair.
    """
    rows = rare.join(placed, "rep")
    open_ = rows.groupBy("hash").agg(F.min("component").alias("__lo"), F.max("component").alias("__hi")).filter("__lo < __hi").select("hash")
    rows = keep(rows.join(open_, "hash"), "rare")
    left = rows.select("hash", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    right = rows.select(F.col("hash").alias("hb"), F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    sizes = f"100 * na >= {per_cent} * nb AND 100 * nb >= {per_cent} * na"
    enough = f"{100 + per_cent} * (1 + least(na - pa, nb - pb)) >= {per_cent} * (na + nb)"
    possible = F.expr(f"ca < cb AND {sizes} AND {enough}")
    return left.join(right, (F.col("hash") == F.col("hb")) & possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def within_distance(pairs: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most ``distance`` symbols."""
    sig = classes.select(F.col("rep"), F.col("signature"))
    with_a = pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
    with_b = with_a.join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    schema = T.StructType([T.StructField(c, classes.schema["rep"].dataType) for c in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            near = pa.array((one != two).sum(axis=1) <= distance)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], schema.names)

    return with_b.select("a", "b", "sa", "sb").mapInArrow(run, schema)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, per_cent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= ``per_cent`` * union of their full shingle sets.
    ``texts``: (id, text) of at least the pairs' documents."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    schema = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.array(pc.add(pc.fill_null(pc.binary_length(batch.column(2)), 0), pc.fill_null(pc.binary_length(batch.column(3)), 0))))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + (1 << 20), side="right")))
                rows = batch.slice(first, last - first)
                first = last
                n = rows.num_rows
                stacked = pa.concat_arrays([rows.column(2), rows.column(3)])
                sets = [(h, f) for _, d, o in text_pieces(iter([pa.record_batch([stacked], ["t"])]), "t", 1 << 62) for h, f in [shingles(d, o, words)]]
                hashes, at = sets[0]
                sizes = np.diff(at)
                pair = np.concatenate([np.arange(n), np.arange(n)])
                owner = np.repeat(pair, sizes)
                order = np.lexsort((hashes, owner))
                same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
                shared = np.bincount(owner[order][1:][same], minlength=n)
                union = sizes[:n] + sizes[n:] - shared
                near = pa.array((100 * shared >= per_cent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(near), rows.column(1).filter(near)], schema.names)

    return both.mapInArrow(run, schema)


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    per_cent: int = 80,
    chunks: int = 12,
    width: int = 5,
    errors: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` (smallest id reachable over links
    of at least ``per_cent`` % Jaccard similarity), ``kept`` (it is that id).

    All pairs with fewer than ``chunks * (errors + 1)`` unlike symbols are compared. Null and empty
    texts have no shingles and no links, and are their own component. An id stands for one text: of rows
    that repeat an id with other texts, links are confirmed on the greatest one. A row without an id takes its
    class's component, if one exists. Other columns are not read.
    """
    distance = chunks * (errors + 1) - 1
    rows = keep(signatures(docs, words, chunks * width, id_col, text_col), "signatures")
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"), F.first("signature").alias("signature"))
    classes = keep(classes.filter(F.col("rep").isNotNull()), "classes")

    keyed = chunk_keys(classes, chunks, width, errors)
    leads = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("__last")).filter("lead < __last").drop("__last")
    buckets = keep(keyed.join(leads, "key"), "buckets")

    stars = buckets.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = keep(within_distance(stars, classes, distance), "stars")
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # the texts are shuffled once, for all steps: only those of documents that share a bucket go on
    texts = keep(_texts_of(source, buckets.select(F.col("rep").alias("id")).distinct()), "texts")
    links = keep(confirm(stars, texts, words, per_cent), "links")
    found = keep(components(links), "components")

    # who shares a bucket with another component; all others are connected already
    placed = buckets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("__lo"), F.max("component").alias("__hi")).filter("__lo < __hi").select("key")
    apart = keep(placed.join(open_keys, "key"), "apart")
    sized = apart.select("rep").distinct().join(classes.select("rep", F.col("n_shingles").alias("n")), "rep")
    each = shingle_rows(texts.join(sized.select(F.col("rep").alias("id")), "id", "left_semi"), words)
    counted = each.join(each.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")), "hash").join(sized, "rep")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("texts", "hash"))
    rare = counted.withColumn("__rank", rank).filter(F.expr(f"__rank <= n - ({per_cent} * n + 99) DIV 100 + 1")).select("rep", "n", "hash", "texts", F.col("__rank").alias("pos"))
    rare = keep(rare, "rare")

    # a second star per bucket, around the member with the fewest shingles of its own: the centre of a cloud
    own = rare.groupBy("rep").agg(F.count_if(F.col("texts") == 1).alias("own"))
    centred = apart.join(own, "rep")
    centres = centred.groupBy("key").agg(F.min(F.struct("own", "rep", "component")).alias("c"))
    # of a text's buckets the best few centres: the last step finds what they do not
    met = centred.join(centres, "key").filter("component <> c.component").groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct("c.own", "c.rep"))), 1, CENTRES).alias("c"))
    met = met.select("rep", F.explode("c.rep").alias("c"))
    pairs = met.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
    second = keep(within_distance(pairs.join(stars, ["a", "b"], "left_anti"), classes, distance), "stars")
    links = keep(links.unionByName(confirm(second, texts, words, per_cent)), "links")
    found = keep(components(links), "components")

    # what is still apart and similar shares a rare shingle
    placed = apart.select("rep").distinct().join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    cross = rare_shingle_pairs(rare.filter("texts > 1").select("rep", "n", "hash", "pos"), placed, per_cent)
    cross = keep(cross.join(stars.unionByName(second), ["a", "b"], "left_anti"), "cross")
    found = components(links.unionByName(confirm(cross, texts, words, per_cent)))

    placed = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    linked = full.join(placed, ["set_a", "set_b", "n_shingles"], "left").select("id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _texts_of(source: DataFrame, members: DataFrame) -> DataFrame:
    """One text for each member id."""
    return source.join(members, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""
