"""The queries opN_<name> and their SQL. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import conversation_repair, conversation_trie, decontaminate, exact_dedup, html_text, licenses, mixing, nearest, ngram_join, quality, token_output, toxicity, url_filter
from .common import table

#: A vocabulary of the public_tokenizers package, found there by each worker; never copied here.
TOKENIZER = "word_bpe_49k.json"

#: The URL rules of the contract (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def source_weights(docs: DataFrame) -> Column:
    """Target weights of the mixing query: 1 plus the source's number mod 4; 1 for a source without a number."""
    digits = F.regexp_extract(docs["source"], "[0-9]{1,2}$", 0)  # the last two decide
    return F.when(digits != "", digits.cast("int") % 4 + 1).otherwise(1)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10).drop("spans")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held_out=2, threshold=0.7)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, source_weights(docs), block_chars=100_000)
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "mix_block", "mix_slot", "mix_release", "mix_deadline")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held_out=1, threshold=0.7)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), donor=c - c % 5, head=F.crc32(c.cast("string").cast("binary")) % 9)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.structure_repair(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_output": op3_token_output,
    "op4_ngram_join": op4_ngram_join,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_mixing": op8_mixing,
    "op9_nearest": op9_nearest,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.SQL,
    "op5_url_filter": url_filter.SQL,
    "op8_mixing": mixing.SQL,
    "op11_prefix_trie": conversation_trie.SQL,
    "op12_structure_repair": conversation_repair.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
