"""One thin query for each operator: (spark, sf_dir) to its whole result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import table


def tokenizer_file(name: str) -> str:
    """A vocabulary file; ``SHEAF_TOKENIZERS`` names the folder where the installed package is absent."""
    if folder := os.environ.get("SHEAF_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    from sheaf.llm.html_wrapper import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and n_lines_removed of every document."""
    from sheaf.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, parity and round_trip of every whole text."""
    from sheaf.llm.sentencepiece_codec import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, tokenizer_file("piece_bpe_32k.model")).drop("text")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    from sheaf.llm.lm_scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, p_keep and kept of every document."""
    from sheaf.llm.source_mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p_keep", 6).alias("p_keep"), "kept")


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    from sheaf.llm.parity_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed and kept of every document, and quality, the posterior."""
    from sheaf.llm.quality_rules import judge

    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the document's evidence, the site's and path's rates, the posterior and kept."""
    from sheaf.llm.quality_classifier import classify

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), keep=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", "evidence", "site_rate", "path_rate", "posterior", "kept")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 20 nearest of every row whose vec_id is divisible by 20."""
    from sheaf.llm.cross_polytope import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the files that were written."""
    from sheaf.llm.token_files import token_file_digest

    return token_file_digest(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, toward the texts of benchmark."""
    from sheaf.llm.importance_resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; n_words and n_switches, where the language of words changes."""
    from sheaf.llm.language_crf import identify_languages

    out = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, faults, cost, audit and digest of every conversation, damaged and repaired."""
    from sheaf.llm.conversation_repair import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


ALL = [op1_html_wrapper, op2_line_dedup, op3_sentencepiece, op4_lm_scoring, op5_source_mixing, op6_parity_join, op7_quality_rules, op8_quality_classifier, op9_nearest_neighbours, op10_token_files, op11_importance_resampling, op12_language_crf, op13_conversation_repair]


def _sql() -> dict[str, str]:
    from sheaf.llm import conversation_repair, importance_resampling, source_mixing

    return {"op5_source_mixing": source_mixing.oracle_sql(), "op11_importance_resampling": importance_resampling.oracle_sql(), "op13_conversation_repair": conversation_repair.oracle_sql()}


SQL = _sql()
