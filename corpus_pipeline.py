"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; `run` writes
the result of each as Parquet in the shared folder and reads it again. All but the last return the columns of
`documents`; the last returns doc_id, start, n_tokens and ids_crc32 of the token archive it wrote.

Defined cases: a null or empty text is one blank line to the quality stage and stays or goes by its score; null texts are copies
of nothing, empty ones of each other; they hold no benchmark passage, weigh nothing in the mixture and
stay; their tokens are the end id. Rows with a null id are rows of their own; of rows repeated with one id one stays.
Very long texts are worked through whole by each stage. Empty tables stay empty; without labels, all documents are
good; further columns are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timelore.llm import decontaminate, mixing, near_dup, quality_crf, token_codes
from timelore.llm.common import materialise, table
from timelore.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good; it learns from the labelled rows outside the held-out fold."""
    return quality_crf.keep_good(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    return near_dup.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked weights of sources, languages and topics."""
    return mixing.mixed(docs)


def token_archive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, written as directly addressable codes and read back."""
    return token_codes.encode_and_read(docs, tokenizer_path(), forget=True)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixture", mixed_documents),
    ("tokens", token_archive),
]

#: SQL can express neither the line field nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = materialise(stage(spark, out, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, out, sf_dir)
