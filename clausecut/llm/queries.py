"""The queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausecut.llm import exact_dedup, html_extract, line_dedup, lm_scoring, mixing, ngram_join, packing, pii, quality, secrets, sql, token_counts, turn_trie, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("class_id")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.nodes(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_html_extract, op3_line_dedup, op4_pii, op5_best_fit_packing, op6_quality_rules, op7_lm_scoring, op8_secrets, op9_mixing, op10_exact_dedup, op11_token_counts, op12_embedding_whitening, op13_conversation_trie, quality_ablations)}
SQL = {"op1_ngram_jaccard": sql.LINKS, "op3_line_dedup": sql.LINES, "op4_pii": sql.PII, "op6_quality_rules": sql.QUALITY, "quality_ablations": sql.ABLATIONS, "op8_secrets": sql.SECRETS, "op9_mixing": sql.MIX, "op10_exact_dedup": sql.EXACT, "op13_conversation_trie": sql.TRIE}
