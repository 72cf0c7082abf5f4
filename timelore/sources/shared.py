"""The folder that all executors share, and tables written there between the steps of a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids and numbers that may go to every executor (tens of MB).
FEW_ROWS = 1 << 20
#: Rows that the driver may hold.
LOCAL_ROWS = 4_096


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as `spark.checkpoint.dir` names it.

    Where none is set, a local session (tests) gets one in the temporary folder; a cluster is an error, as its
    executors don't share the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
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
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` worked out once: as a local table if it has at most LOCAL_ROWS rows, else written to the shared folder."""
    rows = df.limit(LOCAL_ROWS + 1).toArrow()
    if rows.num_rows > LOCAL_ROWS:
        return materialise(df, name)
    out = df.sparkSession.createDataFrame(rows, df.schema)
    out.local_rows = rows.to_pylist()
    return out


def meet(large: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """`large` joined with `small`, a written or settled table of a few numbers or short texts in each row.

    It goes to every executor if it is counted, or known by `most`, to have at most FEW_ROWS rows; else both sides are
    sorted and merged, in which Spark splits partitions that a frequent key makes large.
    """
    few = hasattr(small, "local_rows") or (small.count() if most is None else most) <= FEW_ROWS
    return large.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all that jobs of this library have written to the shared folder: intermediate tables, indexes, states of drained
    streams. No DataFrame that reads them may be in use any more."""
    for part in ("timelore", "streams"):
        remove(spark, f"{shared_dir(spark)}/{part}")
