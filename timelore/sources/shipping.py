"""Makes the package importable on executors: Python workers don't share the driver's sys.path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import timelore

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    base = os.path.dirname(os.path.abspath(timelore.__file__))
    if os.path.isdir(base):  # else the package itself came from such a file
        path = os.path.join(tempfile.mkdtemp(), "timelore.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(base):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("timelore", os.path.relpath(full, base)))
        context.addPyFile(path)
    _shipped.add(context.applicationId)
