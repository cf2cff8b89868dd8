"""Exact dedup by a tree-merge of sorted digest runs. DataFrame functions only.

Every input partition belongs to one of ``runs`` digest runs. A run holds one row per digest: the
best document seen (most code points, then smallest id) and the number of documents. Rounds then
merge ``fan_in`` neighbouring runs at a time until one is left, so a text's survivor is settled again
at every level, and a group of copies, however large, ships at most one row per task and level.
Each level is spread over (run, digest): no task sees a whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """``others``, ``__id``, ``__digest`` (SHA-256 of the text without blanks), ``__check`` and ``__points``.

    ``__check`` is a second, independent hash with the length: equal digests are merged only if it
    agrees, which verifies them without shipping texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    return docs.select(
        *others,
        F.col(id_col).alias("__id"),
        F.unhex(F.sha2(bare, 256)).alias("__digest"),
        F.xxhash64(bare, F.octet_length(bare)).alias("__check"),
        F.length(text).cast("long").alias("__points"),
    )


def merge_runs(digests: DataFrame, runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per text: ``__digest``, ``__check``, ``__best`` (points, inverted id), ``__size``."""
    if runs < 1 or fan_in < 2:
        raise ValueError("runs must be at least 1 and fan_in at least 2")
    key = ["__digest", "__check"]
    # ~id orders ids downwards and, unlike -id, cannot overflow
    best = F.struct(F.col("__points").alias("points"), F.bitwise_not(F.col("__id").cast("long")).alias("inverse"))
    level = (
        digests.withColumn("__run", F.pmod(F.spark_partition_id(), F.lit(runs)))
        .groupBy("__run", *key)
        .agg(F.max(best).alias("__best"), F.count(F.lit(1)).alias("__size"))
    )
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.groupBy(F.floor(F.col("__run") / fan_in).cast("int").alias("__run"), *key).agg(
            F.max("__best").alias("__best"), F.sum("__size").alias("__size")
        )
    return level.drop("__run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """Which document of each group of equal texts stays. One row per input row.

    Texts are equal when they are identical without blanks. Columns: the id, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.
    Null texts count as empty. Of texts of one length a null id loses against any id; rows that repeat an id share its
    result, but a shorter writing under the same id is not kept. Other columns are not touched or read.
    """
    digests = text_digests(docs, id_col, text_col)
    # A join on the digest; a hot digest is split by adaptive execution, its other side is one row
    joined = digests.join(merge_runs(digests, runs, fan_in), ["__digest", "__check"])
    keep = F.bitwise_not(F.col("__best.inverse"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__id").eqNullSafe(keep) & (F.col("__points") == F.col("__best.points"))).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of ``docs`` for each group of equal texts: a row of the id that :func:`exact_dedup` keeps.

    Of rows that repeat an id and a text, the longest writing stays, then the smallest text and the smallest
    hash of the other columns. Rows are cut to one per (text, id) before and after the only shuffle of
    texts, so a row that was ingested very often is no hot key.
    """
    digests = text_digests(docs, id_col, text_col, "*")
    key = ["__digest", "__check", "__number", "__none"]
    # a null id as two values, so that windows and join share one partitioning
    number = (F.coalesce(F.col("__id").cast("long"), F.lit(0)).alias("__number"), F.col("__id").isNull().alias("__none"))
    rest = [F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != text_col]
    order = Window.partitionBy(*key).orderBy(F.col("__points").desc(), text_col, F.xxhash64(F.lit(0), *rest))
    rows = digests.select("*", *number).withColumn("__rank", F.row_number().over(order)).filter("__rank = 1")
    best = merge_runs(text_digests(docs, id_col, text_col)).select("__digest", "__check", F.bitwise_not(F.col("__best.inverse")).alias("__id"))
    return rows.join(best.select("__digest", "__check", *number), key, "left_semi").select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents
), k AS (
  SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY s) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM k
"""
