"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from auctionlens.llm import (
    bag_search, divergence, html_extract, lm_score, mixing, neardup, packing, pii, quality, retrieval_packing, rules, spans, topk,
)
from auctionlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    """The operator on a whole table."""
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_bloom_lm": on("documents", lm_score.score_documents),
        "op2_best_fit_packing": on("documents", packing.pack_documents),
        "op3_html_main_text": on("pages", html_extract.extract),
        "op4_pairwise_quality": op4,
        "op5_poisson_mixing": on("documents", mixing.query),
        "op6_pii_surrogates": on("documents", pii.query),
        "op7_threshold_topk": on("embeddings", topk.top_k),
        "op8_quality_rules": on("documents", rules.query),
        "op9_minhash_odd_sketch": on("documents", neardup.near_duplicates),
        "op10_sentence_spans": on("documents", spans.query),
        "op11_bag_search": op11,
        "op12_retrieval_packing": on("documents", retrieval_packing.pack_documents),
        "op13_source_divergence": on("documents", divergence.divergence),
        "pipeline": corpus_pipeline.run,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op5_poisson_mixing": mixing.SQL,
        "op7_threshold_topk": topk.SQL,
        "op8_quality_rules": rules.SQL,
        "op11_bag_search": bag_search.SQL,
        "op13_source_divergence": divergence.SQL,
    }
