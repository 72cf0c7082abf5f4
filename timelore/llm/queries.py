"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelore.llm import ann, decontaminate, mixing, near_dup, packing, periodic, quality_crf, suffix_dedup, token_codes, toxicity, url_tree, warc, whitening
from timelore.llm.common import table
from timelore.llm.oracle import ORACLE_SQL

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mixing.sample_mixture(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("probability", 6).alias("probability"))


def op9_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_tree.judge(table(spark, sf_dir, "pages"), labels)


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.detect(table(spark, sf_dir, "documents"), periodic.periodic_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc_archive": op3_warc_archive,
    "op4_token_codes": op4_token_codes,
    "op5_decontaminate": op5_decontaminate,
    "op6_near_dup": op6_near_dup,
    "op7_multi_index": op7_multi_index,
    "op8_mixture": op8_mixture,
    "op9_url_tree": op9_url_tree,
    "op10_quality_crf": op10_quality_crf,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_path"]
