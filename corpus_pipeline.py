"""The training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage before it wrote. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import decontaminate, mixing, ngram_join, token_output, toxicity
from sparkloom.llm.common import discard, materialize, table
from sparkloom.llm.queries import TOKENIZER, source_weights

#: Documents of this score or more are rejected as toxic.
TOXIC = 0.7
#: Words of a benchmark passage that must coincide.
NGRAM = 10
BLOCK_CHARS = 100_000
END_ID = 2
#: Words that a worker remembers of the tokenizer: it keeps them while it serves other stages, whose memory they take.
MEMO_WORDS = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside its held-out fold, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.remove(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each component of the n-gram join, and all without links; rows are judged by their own texts."""
    return ngram_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any passage of the benchmark, with or without ids."""
    return decontaminate.remove_rows(docs, table(spark, sf_dir, "benchmark"), NGRAM)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix: files by number, then rows, read in that order."""
    return mixing.mixed(docs, source_weights(docs), BLOCK_CHARS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of the documents in the order in which docs is laid out, and what reading it back says of each."""
    # a part's number may outgrow its five digits, so names do not order files
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    placed = docs.select("doc_id", "text", part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return token_output.token_output(placed, TOKENIZER, END_ID, place=["part", "file", "row"], memo_words=MEMO_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage has read goes once the next is written."""
    docs = given = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if before is not given:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
