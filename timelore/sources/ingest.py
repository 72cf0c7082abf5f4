"""Sources and sinks: media inventory, fingerprints, vectors from blobs, descriptions, evidence, exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelore.functions.columns import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, trimmed
from timelore.sources.mediafiles import EDGE_BYTES, MediaFiles

DESCRIPTION = "summary string, visible_details array<string>, uncertainty array<string>"


def scanned_files(spark: SparkSession, root: str) -> DataFrame:
    """What lies below a folder: media files, skipped files and what can't be read (`sources.mediafiles`)."""
    spark.dataSource.register(MediaFiles)
    return spark.read.format("media_files").load(root)


def media_inventory(spark: SparkSession, root: str) -> DataFrame:
    """The media files below a folder, with their fingerprints."""
    return scanned_files(spark, root).filter("skipped is null and error is null").drop("skipped", "error")


def inventory_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row: media files, skipped ones and errors."""
    plain = F.col("skipped").isNull() & F.col("error").isNull()
    return scanned_files(spark, root).agg(F.count_if(plain).alias("media"), F.count("skipped").alias("skipped"), F.count("error").alias("errors"))


def supported_extensions() -> list[str]:
    return sorted({*VIDEO_EXTENSIONS, *IMAGE_EXTENSIONS})


def fingerprint(size: Column, mtime: Column | None, content: Column) -> Column:
    """SHA-256 of size (and time), the first and, beyond EDGE_BYTES, the last EDGE_BYTES of the content."""
    head = F.concat_ws("|", size.cast("string"), *([mtime.cast("string")] if mtime is not None else [])).cast("binary")
    tail = F.when(size > EDGE_BYTES, F.substring(content, -EDGE_BYTES, EDGE_BYTES)).otherwise(F.lit(b""))
    return F.sha2(F.concat(head, F.substring(content, 1, EDGE_BYTES), tail), 256)


def decode_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, rejects) of (segment_id, blob, dimension): little-endian floats whose number is the dimension."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.frombuffer(x, "<f4").tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], ["segment_id", "vector"])

    sound = F.col("blob").isNotNull() & (F.octet_length("blob") % 4 == 0) & (F.octet_length("blob") == F.col("dimension") * 4) & (F.col("dimension") > 0)
    good = rows.filter(F.coalesce(sound, F.lit(False))).select("segment_id", "blob").mapInArrow(decode, "segment_id long, vector array<float>")
    return good, rows.filter(~F.coalesce(sound, F.lit(False)))


def parse_descriptions(rows: DataFrame, column: str = "body") -> DataFrame:
    """`rows` with summary, visible_details, uncertainty from JSON, or from its outermost braces; rows without any are left out."""
    whole = F.from_json(column, DESCRIPTION)
    inner = F.from_json(F.regexp_extract(column, r"(?s)\{.*\}", 0), DESCRIPTION)
    good = lambda d: d["summary"].isNotNull() & d["visible_details"].isNotNull() & d["uncertainty"].isNotNull()
    d = F.when(good(whole), whole).when(good(inner), inner)
    return rows.withColumn("_d", d).filter("_d is not null").select(*rows.columns, "_d.*")


def visual_texts(descriptions: DataFrame) -> DataFrame:
    """(segment_id, n, text): the summary and details that aren't blank, numbered; uncertainty is never searched."""
    texts = F.filter(F.transform(F.concat(F.array("summary"), "visible_details"), trimmed), lambda x: x.isNotNull() & (x != ""))
    return descriptions.select("segment_id", F.posexplode(texts).alias("n", "text"))


def evidence_index(transcripts: DataFrame, ocr: DataFrame, visual: DataFrame) -> DataFrame:
    """One searchable row for each text of the three sources: segment_id, evidence_type, n, text."""
    parts = [d.select("segment_id", F.lit(k).alias("evidence_type"), F.col("n").cast("long").alias("n"), "text") for k, d in (("transcript", transcripts), ("ocr", ocr), ("visual", visual))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def commit_evidence(state: DataFrame, batch: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next state, rejects): rows of a segment replace its old ones; empty spans are dropped, changed sources rejected.

    batch: segment_id, evidence_type, n, text, start_ms, end_ms, fingerprint; current: segment_id, fingerprint.
    """
    rows = batch.join(current.select("segment_id", F.col("fingerprint").alias("_f")), "segment_id", "left")
    ok = F.coalesce(F.col("fingerprint") == F.col("_f"), F.lit(False))
    good = rows.filter(ok).select(*batch.columns)
    named = good.filter(F.col("end_ms") > F.col("start_ms")).withColumn("evidence_id", F.concat_ws(":", F.col("segment_id").cast("string"), "evidence_type", F.col("n").cast("string")))
    kept = state.join(good.select("segment_id"), "segment_id", "left_anti")
    return kept.unionByName(named.drop("fingerprint").select(*state.columns)), rows.filter(~ok).select(*batch.columns)


def commit_index_output(batch: dict[str, DataFrame], current: DataFrame) -> dict[str, DataFrame]:
    """What an indexed segment leaves: evidence, frames, vectors and run rows to replace the segment's old ones, and the rejected segments.

    batch: `vectors` (segment_id, fingerprint, vector; one for each segment), `transcript`, `ocr` (segment_id, n,
    text, start_ms, end_ms) and `frame` (segment_id, n, time_ms). A segment is rejected whole if its vector is empty
    or its source isn't the current one (current: segment_id, fingerprint). Sentences without length are dropped.
    Rows get ids `segment:kind:n`; each segment gets a run of each of the four kinds.
    """
    rows = batch["vectors"].join(current.select("segment_id", F.col("fingerprint").alias("_f")), "segment_id", "left")
    reason = F.when(F.coalesce(F.size("vector"), F.lit(0)) <= 0, "empty vector").when(~F.coalesce(F.col("fingerprint") == F.col("_f"), F.lit(False)), "changed source")
    judged = rows.withColumn("reason", reason)
    good = judged.filter("reason is null").select("segment_id", "vector")

    def named(kind: str) -> DataFrame:
        name = F.concat_ws(":", F.col("segment_id").cast("string"), F.lit(kind), F.col("n").cast("string"))
        return batch[kind].join(good.select("segment_id"), "segment_id", "left_semi").withColumn("id", name)

    spoken = named("transcript").filter("end_ms > start_ms").withColumn("evidence_type", F.lit("transcript"))
    kinds = F.explode(F.array(*map(F.lit, ("transcript", "ocr", "frame", "embedding"))))
    run = F.concat_ws(":", F.col("segment_id").cast("string"), F.lit("run"), "kind")
    return {
        "evidence": spoken.unionByName(named("ocr").withColumn("evidence_type", F.lit("ocr"))), "frames": named("frame"), "vectors": good,
        "runs": good.select("segment_id", kinds.alias("kind")).withColumn("run_id", run), "rejects": judged.filter("reason is not null").select("segment_id", "reason"),
    }


def embedding_texts(evidence: DataFrame) -> DataFrame:
    """(segment_id, text) for the embedder: spoken sentences, then visible texts, in order."""
    def joined(kind: str, by: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("evidence_type") == kind, F.struct("start_ms", "n", "text"))))
        return F.array_join(F.transform(found, lambda x: x["text"]), by)

    return evidence.groupBy("segment_id").agg(F.concat(F.lit("Spoken content: "), joined("transcript", " "), F.lit("\nVisible text: "), joined("ocr", " | ")).alias("text"))


def describer_lines(evidence: DataFrame) -> DataFrame:
    """(segment_id, text) for the describer: `[KIND from–to] text` lines in time order."""
    seconds = lambda c: F.format_string("%.3fs", F.col(c) / 1000)
    kind = F.when(F.col("evidence_type") == "transcript", "ASR").otherwise(F.upper("evidence_type"))
    line = F.concat(F.lit("["), kind, F.lit(" "), seconds("start_ms"), F.lit("–"), seconds("end_ms"), F.lit("] "), "text")
    rows = evidence.filter(F.col("evidence_type") != "visual").withColumn("line", line)
    return rows.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "n", "line"))), lambda x: x["line"]), "\n").alias("text"))
