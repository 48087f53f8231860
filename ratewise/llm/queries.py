"""The queries ``opN_<name>``: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.llm import (bit_sliced, chat, hard_negatives, importance_resampling, line_blocks, mixing, near_duplicates, packing, permutation_index, pii,
                          sum_of_squares, toxicity_chain, url_reputation)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and the verdict of every document."""
    return toxicity_chain.judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth vector."""
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return line_blocks.extract_main_text(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, mixed to equal parts of the sources present."""
    return (mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
            .select("doc_id", "source", "mix_copy", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are moved on first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, placed as they are read."""
    return sum_of_squares.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_chat_snapshot_collapse, op2_url_reputation, op3_toxicity_chain, op4_minhash_hamming_join, op5_pii_spans, op6_permutation_index,
    op7_bit_sliced_topk, op8_line_block_text, op9_best_fit_packing, op10_poisson_mixing, op11_importance_resampling,
    op12_hard_negatives, op13_sum_of_squares_packing)}
