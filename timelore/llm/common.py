"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelore.sources.shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as `spark.checkpoint.dir` names it.

    Where none is set, a local session (tests) gets one in the temporary folder; a cluster is an error, as its
    executors don't share the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='timelore-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/timelore/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(*written: DataFrame) -> None:
    """Delete what `materialise` has written, once no plan reads it any more."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(df.written_to)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of ids and numbers that may go to every executor (tens of MB).
FEW_ROWS = 1 << 20


def meet(large: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """`large` joined with `small`, a written table of a few numbers in each row.

    It goes to every executor if it is counted to have at most FEW_ROWS rows; else both sides are sorted and
    merged, in which Spark splits partitions that a frequent key makes large.
    """
    few = small.count() <= FEW_ROWS
    return large.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(path: str) -> str:
    return os.fspath(path).removeprefix("file://")
