"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.llm import decontam, embeddings, html, jaccard, language, linededup, mixing, tokens, toxicity, urls
from strandex.llm.runtime import read

#: (verdict, host and path) of the URL query.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _remainder(column: str, n: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules label a part of the urls; trees fitted on these judge the others."""
    pages = read(spark, sf_dir, "pages")
    _, label = urls.rule_for(urls.host(F.col("url")), urls.path(F.col("url")), URL_RULES)
    labelled = pages.select("url", (label == "block").alias("block"))
    return urls.judge(pages.select("page_id", "url"), URL_RULES, urls.fit_trees(labelled)).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scorer = toxicity.fit_toxicity(docs, labels.where(_remainder("doc_id", 4) != 2))
    return toxicity.score_texts(docs, scorer).select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where(_remainder("doc_id", 5) != 0))
    return language.identify(docs, model).select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_jaccard, op2_url_filter, op3_decontamination, op4_line_dedup, op5_mix_sources, op6_html_extraction, op7_token_counts, op8_embedding_dedup, op9_toxicity, op10_language_id)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": linededup.SQL, "op5_mix_sources": mixing.SQL}
