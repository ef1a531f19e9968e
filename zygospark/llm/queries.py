"""Queries of the corpus operators: name -> query, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospark.llm.collocations import collocations
from zygospark.llm.conversation_repair import repair_conversations
from zygospark.llm.decontaminate import contamination
from zygospark.llm.line_dedup import dedup_lines
from zygospark.llm.minhash_dedup import near_duplicates
from zygospark.llm.mixing import MIX_COUNTS_SQL, mix_counts
from zygospark.llm.oracle_sql import COLLOCATIONS, CONTAMINATION, CONVERSATIONS, NEAR_DUPLICATES, QUALITY, REMOVED_REPEATS, TOP_PRODUCTS
from zygospark.llm.quality import judge
from zygospark.llm.substring_dedup import remove_repeats
from zygospark.llm.suffix_tree_lm import score_texts
from zygospark.llm.token_files import count_tokens
from zygospark.llm.topk_search import exact_top_k
from zygospark.llm.toxicity import score_toxicity
from zygospark.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


def op3_suffix_tree_lm(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"))


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages"))


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents"), with_text=False)


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return judge(table(spark, sf, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_lines(table(spark, sf, "documents"), with_text=False)


def op10_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix_counts(table(spark, sf, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_conversations(table(spark, sf, "conversations"))


def op13_exact_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_url_filter": op4_url_filter,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_exact_topk_search": op13_exact_topk_search,
}
#: Tokenizers, classifiers and language models have no SQL form, fuzzy lines are too slow in SQL; tests/llm holds these against brute force.
ORACLES: dict[str, str] = {
    "op2_minhash_dedup": NEAR_DUPLICATES,
    "op5_substring_dedup": REMOVED_REPEATS,
    "op7_quality_rules": QUALITY,
    "op8_benchmark_decontamination": CONTAMINATION,
    "op10_mix_sources": MIX_COUNTS_SQL,
    "op11_phrase_collocations": COLLOCATIONS,
    "op12_conversation_repair": CONVERSATIONS,
    "op13_exact_topk_search": TOP_PRODUCTS,
}
