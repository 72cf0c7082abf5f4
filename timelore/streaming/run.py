"""Runs a streaming query over all that its source has, and gives what it wrote as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from timelore.sources.shared import shared_dir


def saved(stream: DataFrame, save: Callable[[DataFrame, int], None], mode: str = "append", state: str | None = None) -> None:
    """Gives all rows that are there now to `save`, batch by batch; `state` keeps how far it came."""
    state = state or f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}/state"
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The result of the streaming query over all rows that are there now.

    mode: "append" adds each batch; "complete" replaces the result by each batch's, so that open windows count too.
    Each epoch is written to a folder of its own, so that a batch replayed after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = stream.schema

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch if mode == 'append' else 0}")

    saved(stream, save, mode, f"{path}/state")
    return spark.read.schema(schema).parquet(f"{path}/out").select(*schema.names)
