"""How filters interact: what every order of them removes, by wide packed counters.

A document fails a set of filters, its mask. For every mask one big integer per figure is laid out whose fields
are the outcomes of all steps of all filter orders (5 filters: 120 orders of 5 steps, 600 fields). A part's figures are
the sum of these integers, each times the number of its documents, and are read off the fields at the end. A
field has 64 bits and a count fits in 63, so no sum carries into the next field.

Spark counts documents per (part, mask, labels) first: at most 128 rows of a part, however large, meet in a task.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "ABCDE"
#: The filter that fails copies is not a condition on one text; it is the last letter.
COPY = LETTERS[-1]
FIELD_BYTES = 8

FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = T.StructType(
    [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in FIGURES]
)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (bit i: filter i fails), ``good``, ``toxic``, ``n``.

    Null texts are empty, a null lang is the part ''. A text fails as a copy if any smaller doc_id has it; rows that
    repeat an id are not copies of each other, and a null id neither is a copy nor makes one. A document is good or toxic if
    any of its label rows says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_filters(text).values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("own"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    group = ["digest", "part", "own", "good", "toxic"]
    by_id = rows.join(marks, "doc_id", "left").select("doc_id", "digest", "part", "own", *flags).groupBy("doc_id", *group).agg(F.count(F.lit(1)).alias("n"))
    # of a text in a part: all rows, those without an id, and the smallest id with its rows
    texts = by_id.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    # at most one row per (part, labels) of a text is in this window
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    split = texts.withColumn("originals", F.col("without_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = split.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), F.col("originals").alias("n")),
        F.struct((F.col("own") + (1 << LETTERS.index(COPY))).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )).alias("x"))
    return both.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def steps(letters: str = LETTERS) -> list[tuple[str, int]]:
    """(order, step from 1) of every field, in the order of the fields."""
    return [("".join(o), s) for o in permutations(letters) for s in range(1, len(letters) + 1)]


def packed_outcomes(letters: str = LETTERS) -> dict[str, list[int]]:
    """Per figure, for every mask, the big integer with 1 in the fields of the steps at which a document of that mask counts."""
    own, earlier = [], []
    for order, step in steps(letters):
        own.append(1 << letters.index(order[step - 1]))
        earlier.append(sum(1 << letters.index(c) for c in order[: step - 1]))
    own, earlier = np.array(own), np.array(earlier)
    wide = lambda hit: int.from_bytes(hit.astype(f"<u{FIELD_BYTES}").tobytes(), "little")
    out = {"kept": [], "removed": [], "redundant": [], "unique_fails": []}
    for mask in range(1 << len(letters)):
        fails, gone = (mask & own) != 0, (mask & earlier) != 0
        out["kept"].append(wide(~fails & ~gone))
        out["removed"].append(wide(fails & ~gone))
        out["redundant"].append(wide(fails & gone))
        out["unique_fails"].append(wide(mask == own))
    return out


def unpack(total: int, fields: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(fields * FIELD_BYTES, "little"), f"<u{FIELD_BYTES}").astype(np.int64)


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the figures of every step of every order, from :func:`mask_counts`.
    An empty table gives no rows."""
    fields, wide = steps(letters), packed_outcomes(letters)
    at_filter = np.array([letters.index(order[step - 1]) for order, step in fields])

    def read(table: pa.Table) -> pa.Table:
        sums = dict.fromkeys(FIGURES[:-1], 0)
        for row in table.select(["mask", "good", "toxic", "n"]).to_pylist():
            for figure, by_mask in wide.items():
                sums[figure] += row["n"] * by_mask[row["mask"]]
            for figure, counts_here in (("good_lost", row["good"]), ("toxic_lost", row["toxic"])):
                if counts_here:
                    sums[figure] += row["n"] * wide["removed"][row["mask"]]
        out = {figure: unpack(total, len(fields)) for figure, total in sums.items()}
        by_filter = np.array([out["removed"][at_filter == i].sum() for i in range(len(letters))])
        out["shapley"] = by_filter[at_filter]
        part = table.column("part")[0].as_py()
        head = {"part": pa.array([part] * len(fields)), "filter_order": pa.array([o for o, _ in fields]), "step": pa.array([s for _, s in fields], pa.int32())}
        return pa.table(head | {c: pa.array(out[c], pa.int64()) for c in FIGURES})

    return counts.groupBy("part").applyInArrow(read, AUDIT)


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), masks AS (
  SELECT part, doc_id,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words
), marked AS (
  SELECT m.part, m.mask, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM masks m LEFT JOIN (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
  ) l ON m.doc_id = l.doc_id
), counted AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM marked GROUP BY ALL
), filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS own, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS earlier FROM orders, range(1, 6) r(s)
), figures AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM figures
"""
