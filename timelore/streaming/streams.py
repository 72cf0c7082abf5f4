"""Structured Streaming twins of batch operators. Inputs are streaming DataFrames with an event time `ts`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timelore.functions.columns import visible_ready
from timelore.sources import shared
from timelore.sources.ingest import commit_evidence


def silence_sessions(windows: DataFrame, threshold_db: float = -42.0, gap_ms: int = 100, least_ms: int = 500, late: str = "10 seconds") -> DataFrame:
    """Stretches of quiet windows of an asset, closed by a gap; rows later than the watermark are dropped. windows: ts, asset_id, level_db.

    The length is taken from aggregates: a filter on the session's own bounds would be moved below the
    aggregation, where every row still is a session.
    """
    quiet = windows.filter(F.col("level_db") <= threshold_db).withWatermark("ts", late)
    runs = quiet.groupBy("asset_id", F.session_window("ts", f"{gap_ms} milliseconds").alias("w"))
    out = runs.agg(F.count("*").alias("windows"), (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts")) + gap_ms).alias("ms")).filter(F.col("ms") >= least_ms)
    return out.select("asset_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "windows")


def energy(samples: DataFrame, width: str = "100 milliseconds", late: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Level per asset and fixed (or sliding) window. samples: ts, asset_id, value in -1..1."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    level = 20 * F.log10(F.greatest(rms, F.lit(1e-9)))
    return samples.withWatermark("ts", late).groupBy("asset_id", w.alias("w")).agg(level.alias("level_db")).select("asset_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "level_db")


def evidence_sink(load: Callable[[], DataFrame], save: Callable[[DataFrame, DataFrame, int], None], current: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: `load` gives the last snapshot, `save(next, rejects, epoch)` writes the new one."""

    def write(batch: DataFrame, epoch: int) -> None:
        state, rejects = commit_evidence(load(), batch, current)
        save(state, rejects, epoch)

    return write


class EvidenceSnapshots:
    """A foreachBatch sink that keeps snapshots of the evidence, each epoch once.

    An epoch's snapshot and rejects go to folders of their own; its manifest is written last, and names the epoch it was
    made from. A batch that is replayed after its manifest was written changes nothing; one that failed before is written
    anew from the same snapshot. So no snapshot overwrites what it reads, and every epoch counts once.
    """

    def __init__(self, path: str, initial: DataFrame, current: DataFrame):
        self.path, self.current = path.rstrip("/"), current
        self.spark, self.schema = initial.sparkSession, initial.schema
        if not self.epochs():
            initial.write.mode("overwrite").parquet(f"{self.path}/state/-1")
            self._commit(-1)

    def epochs(self) -> list[int]:
        names = shared.names(self.spark, f"{self.path}/manifest")
        return sorted(int(n) for n in names if n.lstrip("-").isdigit() and shared.exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS"))

    def _commit(self, epoch: int) -> None:
        self.spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{epoch}")

    def snapshot(self, epoch: int | None = None) -> DataFrame:
        """The state after an epoch, or after the last one."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/state/{self.epochs()[-1] if epoch is None else epoch}")

    def rejects(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rejects/{epoch}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        done = self.epochs()
        if epoch in done:
            return
        state, rejects = commit_evidence(self.snapshot(max(e for e in done if e < epoch)), batch, self.current)
        state.write.mode("overwrite").parquet(f"{self.path}/state/{epoch}")
        rejects.write.mode("overwrite").parquet(f"{self.path}/rejects/{epoch}")
        self._commit(epoch)


def deduplicated(batch: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (segment, run, kind, n) once within the watermark."""
    return batch.withWatermark("ts", late).dropDuplicatesWithinWatermark(["segment_id", "run_id", "evidence_type", "n"])


def job_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(job_id, event_id, accepted, status, attempt): an event counts only if it starts a job anew, or the job runs with its attempt.

    events: ts, event_id, job_id, attempt, new_status. State is a status and an attempt for each job; jobs
    that have finished leave the state when the watermark has passed them by an hour.
    """
    schema = "job_id string, event_id long, accepted boolean, status string, attempt int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, attempt = state.get if state.exists else ("pending", -1)
        parts = [[b[c].to_numpy() for c in ("ts", "event_id", "attempt", "new_status")] for b in batches]  # a job's events of one micro-batch
        at, events, attempts, new = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((events, at))
        events = events[order]
        out = []
        for now, to in zip(attempts[order].tolist(), new[order], strict=True):
            starts = to == "running" and status != "running" and now > attempt
            ok = starts or (status == "running" and now == attempt)
            if ok:
                status, attempt = to, int(now)
            out.append((ok, status, attempt))
        accepted, states, tries = zip(*out, strict=True)
        state.update((status, attempt))
        if status != "running":
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3_600_000)
        yield pd.DataFrame({"job_id": key[0], "event_id": events, "accepted": accepted, "status": states, "attempt": tries})

    return events.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(step, schema, "status string, attempt int", "append", GroupStateTimeout.EventTimeTimeout)


def visible_evidence(evidence: DataFrame, assets: DataFrame) -> DataFrame:
    """Streamed evidence of assets that can be served (a static snapshot)."""
    return evidence.join(assets.filter(visible_ready()).select("asset_id"), "asset_id")


def lane_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window, kind and status; for update mode."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind", "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "status", "n")


def ocr_sessions(detections: DataFrame, gap: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Equal texts of a segment within the gap as one observation, without the box test. detections: ts, segment_id, text, confidence."""
    runs = detections.withWatermark("ts", late).groupBy("segment_id", "text", F.session_window("ts", gap).alias("w"))
    return runs.agg(F.max("confidence").alias("confidence"), F.count("*").alias("n")).select("segment_id", "text", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "confidence", "n")
