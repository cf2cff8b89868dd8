"""From raw documents to packed token sequences: five stages, each one operator.

``STAGES`` lists (name, function); a function takes the session, its predecessor's result as ``docs`` and the
folder of the given tables. All but the last return the columns of ``docs``. ``run`` writes every
stage's result to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import exact_dedup, near_dup, packing, suffix_dedup, toxicity
from gavel.llm.links import keep
from gavel.llm.queries import tokenizer_file

#: Bytes of a repeated passage: somewhat less than 50 words take.
PASSAGE_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; learnt from the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter("toxic_score < 0.5").drop("toxic_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for blanks."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    Where ids are repeated or missing, rows are told apart by a number of their own, so that rows of one id are
    compared with each other as well and one row of a group stays.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        return _one_per_component(docs, "doc_id")
    # written once: the numbers would differ if they were computed again
    number = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    numbered = keep(docs.withColumn("__row", number), "numbered")
    return _one_per_component(numbered, "__row").drop("__row")


def _one_per_component(docs: DataFrame, id_col: str) -> DataFrame:
    verdict = near_dup.near_duplicates(docs, words=5, per_cent=80, chunks=16, id_col=id_col)
    kept = verdict.filter("kept").select(F.col(id_col).alias("__kept"))
    return docs.join(kept, F.col(id_col) == F.col("__kept"), "left_semi")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand more than once in the corpus; ``n_chars`` follows the
    text. Characters of which a part is repeated go with it; no document is dropped."""
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens: one row per piece, with its ids."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_passages),
    ("packing", pack),
]

#: A learnt model decides the first stage, so SQL cannot say the result.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
