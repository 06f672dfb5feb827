"""The queries of this package, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valograph.llm import oracles
from valograph.llm.chat import formatted
from valograph.llm.decontam import contaminated
from valograph.llm.divergence import divergence
from valograph.llm.html import main_text
from valograph.llm.lines import without_repeated_lines
from valograph.llm.lm import scored
from valograph.llm.packing import packed, pieces
from valograph.llm.quality import BASE, judged
from valograph.llm.search import ranked
from valograph.llm.shared import documents, written
from valograph.llm.simhash import hexadecimal, near_duplicates
from valograph.llm.substring import repeats
from valograph.llm.tokenfiles import read_tokens, write_tokens
from valograph.llm.tokens import public_path
from valograph.llm.warc import read_warc, write_warc


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and whether the base rules and the certified cutoffs keep it."""
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    return judged(docs, documents(spark, folder, "labels"), with_text=False).select("doc_id", *BASE, "kept")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words that remain after windows of 50 words that start in an earlier document are removed."""
    return repeats(documents(spark, folder))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2,048 tokens."""
    cut = pieces(documents(spark, folder), public_path("byte_bpe_50k.json"), special=True)
    digests = written(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packed(digests).select("doc_id", F.col("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a test item, exact or edited, with the item and the alignment's score."""
    return contaminated(documents(spark, folder), documents(spark, folder, "benchmark")).select("doc_id", "item_id", "score")


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation with its roles repaired at least cost, rendered for training."""
    return formatted(documents(spark, folder, "conversations"))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_text(documents(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as they come back from the archives written for them."""
    read = read_warc(write_warc(documents(spark, folder, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose fingerprints are linked by differences of three bits or fewer."""
    docs = documents(spark, folder).select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hexadecimal("simhash").alias("fingerprint"), "component_id")


def op10_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as they come back from the token files written for them."""
    manifest = write_tokens(documents(spark, folder), public_path("word_bpe_49k.json"), special=True)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document under the unigram base and the hierarchical Pitman-Yor model."""
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored(documents(spark, folder)).select(*columns)


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language differ in their terms, and the terms each uses more than its language."""
    return divergence(documents(spark, folder))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every test item."""
    return ranked(documents(spark, folder), documents(spark, folder, "benchmark"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that one with a smaller id holds."""
    kept = without_repeated_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select("own.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_token_id_output": op10_token_id_output,
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_line_dedup": op13_line_dedup,
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_html_extraction": op6_html_extraction,
    "op7_warc": op7_warc,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_lm_scoring": op9_lm_scoring,
}
ORACLE: dict[str, str] = {"op11_source_divergence": oracles.DIVERGENCE, "op12_ranked_search": oracles.SEARCH, "op13_line_dedup": oracles.LINES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
