"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import chat, divergence, infill, url_rules
from quillon.llm.embed_dedup import near_duplicates
from quillon.llm.langid import predict_languages
from quillon.llm.media import media_digests, media_table
from quillon.llm.mixing import mixing_rates
from quillon.llm.ngram_join import jaccard_components
from quillon.llm.packing import pack_documents
from quillon.llm.secrets import secret_digests
from quillon.llm.tokenio import read_documents, write_token_files
from quillon.llm.toxicity import toxicity_scores
from quillon.session import load, stage


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(load(spark, sf_dir, "documents"))


def op2_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_documents(files)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(load(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(stage(media_table(load(spark, sf_dir, "documents"))))


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(load(spark, sf_dir, "conversations"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(load(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(load(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mixing_rates": op2_mixing_rates,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_lossless_webp": op8_lossless_webp,
    "op9_chat_perspectives": op9_chat_perspectives,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_url_filter": op12_url_filter,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op9_chat_perspectives": chat.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_url_filter": url_rules.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it builds on this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
