"""The registered queries of this subpackage: thin calls with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import sql, url_filters
from framewright.llm.chat import format_chats
from framewright.llm.common import read
from framewright.llm.decontaminate import find_leaks
from framewright.llm.html_text import extract
from framewright.llm.lexical_search import rank
from framewright.llm.licenses import scan, summarize
from framewright.llm.line_dedup import dedup_lines
from framewright.llm.minhash import near_duplicates
from framewright.llm.mixing import mix
from framewright.llm.quality_rules import judge
from framewright.llm.token_counts import count_tokens
from framewright.llm.token_ids import token_ids
from framewright.llm.vector_codes import compress, label_errors


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summarize(scan(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress(read(spark, sf_dir, "embeddings"))
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_near_duplicates, op4_decontamination, op5_source_mixing, op6_url_filters, op7_quality_rules, op8_token_ids, op9_html_extraction, op10_chat_formatting, op11_line_dedup, op12_ranked_search, op13_vector_codes)}
ORACLES: dict[str, str] = {
    "op1_license_scan": sql.license_scan(),
    "op3_near_duplicates": sql.NEAR_DUPLICATES,
    "op9_html_extraction": sql.HTML_EXTRACTION,
    "op10_chat_formatting": sql.CHAT_FORMATTING,
    "op11_line_dedup": sql.LINE_DEDUP,
    "op12_ranked_search": sql.RANKED_SEARCH,
    "op13_vector_codes": sql.vector_codes(),
}
