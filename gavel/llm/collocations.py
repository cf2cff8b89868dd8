"""Phrase collocations from suffix subtrees built group by group (ERA-style vertical partitioning).

Three scans over the texts:

1. Words are counted per lang. Every (lang, word) gets a 64-bit code; a code is used only if no other word shares it
   (checked over all words, another seed is taken otherwise), so codes stand for words exactly.
2. Two-word prefixes whose words both reach the least frequency are counted. Those that reach it as well are live. Prefixes are
   grouped by frequency so that a group has at most ``budget`` suffixes; a prefix with more is split by its
   suffixes' further words.
3. Every suffix with a live prefix, cut at four words, at the end of its piece or before the first pair that is not live, goes
   to its group. A group sorts its suffixes, which is its depth-truncated subtree, and reads a phrase's count as the total of
   the leaves below its node. Equal suffixes of a task are one leaf with a count, so a text
   that is copied often ships little.

Scans know live words and pairs from bit filters of bounded size. A filter's errors let dead suffixes through, which cost
time but change no count. Scores and drops are joins on the counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.batches import LOWER, mix64, text_pieces
from gavel.llm.links import keep

#: The longest phrase.
DEPTH = 4
#: Text worked on at once, and records that a task gathers before it ships them.
SCAN_BYTES, GATHERED = 4 << 20, 1_000_000
#: Records of an average bucket of pairs.
BUCKET_RECORDS = 2_000_000
#: Shares of a lang whose best phrases are picked first.
SHARES = 16
#: Most bits of a filter: 16 MB.
FILTER_BITS = 1 << 27

WORD_ROWS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
SHIPPED = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("payload", T.BinaryType())])
NODES = T.StructType([T.StructField("key", T.ArrayType(T.LongType())), T.StructField("f", T.LongType())])

_DIVIDES = np.zeros(256, bool)
_DIVIDES[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_DIVIDES
_WORD[[0x20, 0x09]] = False


class Tokens:
    """The words of a piece of texts: ``word`` (index into ``names``, lower-cased), ``lang`` (index into ``langs``) and ``run``, equal
    for words of the same piece of the same text; ``code`` of each word in its lang."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, lang_col: str, seed: int):
        inside = _WORD[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = inside[inner]  # a text's start and end cut words
        ends[inner - 1] = inside[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(offsets, start, side="right") - 1
        self.run = np.cumsum(_DIVIDES[data])[start] + doc if len(start) else np.zeros(0, np.int64)
        places = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=places[1:])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(LOWER[data[inside]].tobytes())])
        coded = texts.dictionary_encode()
        self.names, self.word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang = pc.fill_null(batch.column(batch.schema.get_field_index(lang_col)).cast(pa.string()), "und").dictionary_encode()
        self.langs, self.lang = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        both, which, self.count = np.unique(self.lang * max(1, len(self.names)) + self.word, return_inverse=True, return_counts=True)
        self.of_lang, self.of_word = both // max(1, len(self.names)), both % max(1, len(self.names))
        heads = [xxhash.xxh3_128_digest(name.encode()) for name in self.langs]
        codes = [xxhash.xxh3_64_intdigest(heads[i] + w, seed) for i, w in zip(self.of_lang.tolist(), self.names.take(pa.array(self.of_word)).to_pylist())]
        self.of_code = np.array(codes, np.uint64)
        self.of_code[self.of_code == 0] = 1  # 0 ends a suffix
        self.code = self.of_code[which]


def scan(batches: Iterator[pa.RecordBatch], text_col: str, lang_col: str, seed: int) -> Iterator[Tokens]:
    for batch, data, offsets in text_pieces(batches, text_col, SCAN_BYTES):
        tokens = Tokens(batch, data, offsets, lang_col, seed)
        if len(tokens.word):
            yield tokens


def count_words(docs: DataFrame, seed: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``word``, ``code``, ``n`` of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in scan(batches, text_col, lang_col, seed):
            names = t.names.cast(pa.large_string()).take(pa.array(t.of_word)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(t.langs, pa.string()).take(pa.array(t.of_lang)), names, pa.array(t.of_code.view(np.int64)), pa.array(t.count.astype(np.int64))], WORD_ROWS.names)

    return docs.select(text_col, lang_col).mapInArrow(run, WORD_ROWS).groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


# --- filters of bounded size ------------------------------------------------------------------


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One value for each row of codes, to deal rows out and for filters; rows are never judged equal by it."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix64(out ^ c)
    return out


class BitFilter:
    """May say yes to a value that is not in it, never no to one that is."""

    def __init__(self, bits: int, packed: bytes):
        self.shift, self.bits = np.uint64(64 - (bits.bit_length() - 1)), np.frombuffer(packed, np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = values >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_filter(keys: DataFrame, columns: list[str], count: int) -> BitFilter:
    """Segments of the bits are made by tasks; the driver gets ``FILTER_BITS`` at most."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * count).bit_length()))
    segments = 16
    shift, per = np.uint64(64 - (bits.bit_length() - 1)), bits // segments

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[mixed([batch.column(c).to_numpy().view(np.uint64) for c in columns]) >> shift] = True
        for s in np.flatnonzero(own.reshape(segments, per).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own[s * per : (s + 1) * per], bitorder="little").tobytes()], pa.binary())], SHIPPED.names)

    def join(table: pa.Table) -> pa.Table:
        parts = np.stack([np.frombuffer(x, np.uint8) for x in table.column("payload").to_pylist()])
        return pa.table({"group": table.column("group").slice(0, 1), "payload": pa.array([np.bitwise_or.reduce(parts, axis=0).tobytes()], pa.binary())})

    whole = {r["group"]: bytes(r["payload"]) for r in keys.select(*columns).mapInArrow(mark, SHIPPED).groupBy("group").applyInArrow(join, SHIPPED).toLocalIterator()}
    return BitFilter(bits, b"".join(whole.get(s, bytes(per // 8)) for s in range(segments)))


# --- records of codes with counts, packed -----------------------------------------------------


def add_up(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of codes in ascending order, each once, with their summed counts."""
    by = np.lexsort(columns[::-1])
    columns, n = [c[by] for c in columns], n[by]
    if not len(n):
        return columns, n
    new = np.zeros(len(n), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new)
    return [c[heads] for c in columns], np.add.reduceat(n, heads)


def pack(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Ascending rows of codes and their counts. The first column is stored by differences."""
    first = np.diff(columns[0], prepend=np.uint64(0))
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in (first, n.astype(np.uint64))]
    head = np.array([len(n), len(columns)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + planes[0] + planes[1] + b"".join(c.astype("<u8").tobytes() for c in columns[1:]))


def unpack(payload: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    rows, width = np.frombuffer(raw, "<u8", 2).tolist()
    plane = lambda at: np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * rows, at).reshape(8, rows).T).view("<u8").reshape(-1)
    rest = [np.frombuffer(raw, "<u8", rows, 16 + 8 * rows * (2 + i)) for i in range(width - 1)]
    return [np.cumsum(plane(16)), *rest], plane(16 + 8 * rows).astype(np.int64)


def ship(records: Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Gathers (codes, counts, group) of a task, adds equal rows up and sends each group's as one value."""
    held, size = [], 0

    def send() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*(h[0] for h in held))]
        group, n = np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held])
        rows, n = add_up([group.astype(np.uint64), *columns], n)
        group, columns = rows[0].astype(np.int64), rows[1:]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        for a, b in zip(heads, [*heads[1:], len(group)]):
            payload = pack([c[a:b] for c in columns], n[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([group[a]], pa.int32()), pa.array([payload], pa.binary())], SHIPPED.names)

    for columns, n, group in records:
        columns, n = add_up([group.astype(np.uint64), *columns], n)
        held.append((columns[1:], n, columns[0].astype(np.int64)))
        size += len(n)
        if size >= GATHERED:
            yield from send()
            held, size = [], 0
    if size:
        yield from send()


def gathered(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [unpack(x.as_py()) for x in table.column("payload")]
    return add_up([np.concatenate(c) for c in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts]))


def nodes_table(columns: list[np.ndarray], n: np.ndarray) -> pa.Table:
    flat = np.stack(columns, axis=1).reshape(-1).view(np.int64)
    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(columns), dtype=np.int32)), pa.array(flat))
    return pa.table({"key": keys, "f": pa.array(n.astype(np.int64))})


# --- the three scans --------------------------------------------------------------------------


def count_pairs(docs: DataFrame, seed: int, live: BitFilter, words: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``key`` (two codes) and ``f`` of the word pairs that reach ``least``."""
    buckets = max(16, -(-words // BUCKET_RECORDS))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        for t in scan(batches, text_col, lang_col, seed):
            good = live.has(mixed([t.code]))
            at = np.flatnonzero(good[:-1] & good[1:] & (t.run[1:] == t.run[:-1]))
            columns = [t.code[at], t.code[at + 1]]
            yield columns, np.ones(len(at), np.int64), (mixed(columns) % np.uint64(buckets)).astype(np.int64)

    def total(table: pa.Table) -> pa.Table:
        columns, n = gathered(table)
        enough = n >= least
        return nodes_table([c[enough] for c in columns], n[enough])

    shipped = docs.select(text_col, lang_col).mapInArrow(lambda b: ship(pairs(b)), SHIPPED)
    return shipped.groupBy("group").applyInArrow(total, NODES)


class Groups:
    """Which group a prefix belongs to. Slots are ranges of the prefixes' mixed values; neighbouring slots are put together while their
    suffixes fit the budget. Prefixes over the budget are dealt out by their whole suffix to groups of their own."""

    def __init__(self, slots: np.ndarray, groups: int, hot: np.ndarray, spread: int):
        self.slots, self.groups, self.hot, self.spread = slots, groups, hot, max(1, spread)
        self.shift = np.uint64(64 - (len(slots).bit_length() - 1))

    def of(self, columns: list[np.ndarray]) -> np.ndarray:
        prefix = mixed(columns[:2])
        out = self.slots[(prefix >> self.shift).astype(np.int64)]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, prefix), len(self.hot) - 1)
            hot = self.hot[at] == prefix
            out = np.where(hot, self.groups + (mixed(columns) % np.uint64(self.spread)).astype(np.int64), out)
        return out


def group_prefixes(pairs: DataFrame, budget: int) -> Groups:
    """The driver gets one number per slot, 8 slots per budget of suffixes, and at most one prefix per budget."""
    total = pairs.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    slots = 1 << max(8, (8 * total // budget).bit_length())
    shift = np.uint64(64 - (slots.bit_length() - 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = mixed([batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b")])
            yield pa.RecordBatch.from_arrays([pa.array((value >> shift).astype(np.int64)), pa.array(value.view(np.int64)), batch.column("f")], ["slot", "value", "f"])

    placed = pairs.select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"), "f").mapInArrow(place, "slot long, value long, f long")
    load = np.zeros(slots, np.int64)
    for r in placed.filter(F.col("f") <= budget).groupBy("slot").agg(F.sum("f").alias("f")).toLocalIterator():
        load[r["slot"]] = r["f"]
    hot = [(r["value"], r["f"]) for r in placed.filter(F.col("f") > budget).select("value", "f").toLocalIterator()]
    group, filled, of_slot = 0, 0, np.zeros(slots, np.int64)
    for s, f in enumerate(load.tolist()):
        if filled and filled + f > budget:
            group, filled = group + 1, 0
        of_slot[s] = group
        filled += f
    return Groups(of_slot, group + 1, np.sort(np.array([v for v, _ in hot], np.int64).view(np.uint64)), -(-sum(f for _, f in hot) // budget))


def subtree_counts(docs: DataFrame, seed: int, live: BitFilter, groups: Groups, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``key`` and ``f`` of the phrases of three and four words that reach ``least``."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        for t in scan(batches, text_col, lang_col, seed):
            pair = np.zeros(len(t.code) + DEPTH, bool)
            pair[: len(t.code) - 1] = (t.run[1:] == t.run[:-1]) & live.has(mixed([t.code[:-1], t.code[1:]]))
            at = np.flatnonzero(pair[:-1] & pair[1:])
            columns = [t.code[at + i] for i in range(3)]
            fourth = np.zeros(len(at), np.uint64)
            longer = pair[at + 2]
            fourth[longer] = t.code[at[longer] + 3]
            columns.append(fourth)
            yield columns, np.ones(len(at), np.int64), groups.of(columns)

    def subtree(table: pa.Table) -> pa.Table:
        columns, n = gathered(table)
        split = table.column("group")[0].as_py() >= groups.groups  # other groups hold more of these prefixes
        whole = (columns[3] != 0) & (n >= least)
        inner, m = add_up(columns[:3], n)
        enough = np.ones(len(m), bool) if split else m >= least
        return pa.concat_tables([nodes_table([c[whole] for c in columns], n[whole]), nodes_table([c[enough] for c in inner], m[enough])])

    shipped = docs.select(text_col, lang_col).mapInArrow(lambda b: ship(suffixes(b)), SHIPPED)
    counted = shipped.groupBy("group").applyInArrow(subtree, NODES)
    return counted.groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


# --- scores -----------------------------------------------------------------------------------

_WIDE = "decimal(19,0)"


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover_per_cent: int = 80, budget: int = 1_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of two to four words of each lang: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Null texts are empty, a null lang is ``und``; texts without words add nothing, and an empty table gives no rows. Repeated rows count
    each time. ``budget``: suffixes of a group, so what one task sorts. Other columns are not read.
    """
    for seed in range(1, 9):
        words = keep(count_words(docs, seed, text_col, lang_col), "colloc-words")
        frequent = words.filter(F.col("n") >= least)
        shared = words.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).filter((F.col("words") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            break
    else:
        raise RuntimeError("no seed gives every frequent word a code of its own")
    all_words, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") >= least)).first()
    pairs = keep(count_pairs(docs, seed, bit_filter(frequent, ["code"], known), all_words, least, text_col, lang_col), "colloc-pairs")
    ends = pairs.select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))
    longer = subtree_counts(docs, seed, bit_filter(ends, ["a", "b"], pairs.count()), group_prefixes(pairs, budget), least, text_col, lang_col)
    phrases = keep(pairs.unionByName(longer), "colloc-phrases")
    return best_phrases(phrases, words, least, top, cover_per_cent)


def best_phrases(phrases: DataFrame, words: DataFrame, least: int, top: int, cover_per_cent: int) -> DataFrame:
    """Scores, drops and ranks from the counts of phrases (``key``, ``f``) and words."""
    frequent = words.filter(F.col("n") >= least)
    counts = phrases.unionByName(frequent.select(F.array("code").alias("key"), F.col("n").alias("f")))
    cuts = phrases.select("key", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("key", 1, F.col("k")), "right": F.slice("key", F.col("k") + 1, F.size("key") - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"CAST(CAST(a AS {_WIDE}) * 2000000 AS decimal(27,0)) div (CAST(l AS {_WIDE}) + CAST(r AS {_WIDE}))")
    scored = cuts.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # every phrase inside a longer one, with the greatest count of such a longer one
    spans = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("key") - n + 1), lambda i: F.slice("key", i, n)))),
        lambda x: F.size(x) > 0,
    )
    covered = phrases.filter(F.size("key") > 2).select(F.explode(spans).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    kept = scored.join(covered, "key", "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast(_WIDE) * 100 < F.col("a").cast(_WIDE) * cover_per_cent)
    )
    spelt = kept.select("key", F.posexplode("key").alias("at", "code")).join(frequent.select("code", "lang", "word"), "code")
    spelt = spelt.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rows = kept.join(spelt, "key").join(sizes, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first the best of each share of a lang, then the best of these
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).cast("int")
    shared = rows.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= top)
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts
), words AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 5)) AS k FROM words))
), counted AS (
  SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), split AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counted WHERE k > 1
), halves AS (
  SELECT lang, phrase, f AS a, i AS cut, array_to_string(w[1:i], ' ') AS first_part, array_to_string(w[i + 1:], ' ') AS second_part
  FROM (SELECT lang, phrase, f, w, unnest(range(1, k)) AS i FROM split)
), cuts AS (
  SELECT s.lang, s.phrase, s.a, s.cut, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * s.a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM halves s
  JOIN counted l ON l.lang = s.lang AND l.phrase = s.first_part
  JOIN counted r ON r.lang = s.lang AND r.phrase = s.second_part
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, f
  FROM (SELECT lang, w, k, f, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT lang, w, k, f, unnest(range(2, k)) AS n FROM split))
), covered AS (
  SELECT lang, phrase, max(f) AS longer FROM inner_phrases GROUP BY ALL
), ranked AS (
  SELECT s.lang, CAST(row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS BIGINT) AS rank, s.phrase, s.a, s.l, s.r, z.n, s.score
  FROM scored s LEFT JOIN covered c USING (lang, phrase) JOIN sizes z ON z.lang = s.lang
  WHERE c.longer IS NULL OR CAST(100 AS HUGEINT) * c.longer < CAST(80 AS HUGEINT) * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
