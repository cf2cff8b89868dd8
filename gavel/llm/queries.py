"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import ann, bpe, chat, collocations, exact_dedup, filter_audit, html_text, near_dup, packing, substring_dedup, suffix_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The public byte-level vocabulary that op9 and op10 use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op3_hamming_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, per_cent=85)


def op4_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_host_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["conv_id", "turn", "role", "text"]
    turns = _table(spark, sf_dir, "conversations").select(*cols).unionByName(chat.fixed_conversation(spark))
    return chat.turn_digests(chat.read_back(chat.prefix_targets(turns)))


def op8_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_file())
    both = bpe.decode(ids, tokenizer_file())
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_block_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"))


def op12_subtree_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_toxicity": op1_compression_toxicity,
    "op2_prefix_forest": op2_prefix_forest,
    "op3_hamming_near_dup": op3_hamming_near_dup,
    "op4_tree_merge_dedup": op4_tree_merge_dedup,
    "op5_host_path_text": op5_host_path_text,
    "op6_difference_cover_dedup": op6_difference_cover_dedup,
    "op7_prefix_target_chat": op7_prefix_target_chat,
    "op8_block_anchor_dedup": op8_block_anchor_dedup,
    "op9_multi_length_packing": op9_multi_length_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_block_top_products": op11_block_top_products,
    "op12_subtree_collocations": op12_subtree_collocations,
    "op13_filter_orders": op13_filter_orders,
}

ORACLES: dict[str, str] = {
    "op3_hamming_near_dup": near_dup.ORACLE_SQL,
    "op4_tree_merge_dedup": exact_dedup.ORACLE_SQL,
    "op6_difference_cover_dedup": suffix_dedup.ORACLE_SQL,
    "op7_prefix_target_chat": chat.ORACLE_SQL,
    "op8_block_anchor_dedup": substring_dedup.ORACLE_SQL,
    "op11_block_top_products": topk.ORACLE_SQL,
    "op12_subtree_collocations": collocations.ORACLE_SQL,
    "op13_filter_orders": filter_audit.ORACLE_SQL,
}
