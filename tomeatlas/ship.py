"""Sends the library to the executors, so that a session can start from any folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

from tomeatlas.plans.scratch import scratch_path

PACKAGES = ("tomeatlas", "workload")
_sent: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Add the library's source as a zip file to the session's Python path, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    shared = scratch_path(spark, "library") + "/tomeatlas_library.zip"  # executors that start later fetch it as well
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "tomeatlas_library.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for package in PACKAGES:
                for at, _, names in os.walk(os.path.join(root, package)):
                    for name in sorted(names):
                        if name.endswith(".py"):
                            file = os.path.join(at, name)
                            z.write(file, os.path.relpath(file, root))
        Path = spark._jvm.org.apache.hadoop.fs.Path
        place = Path(shared)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(Path(path), place)
    context.addPyFile(shared)


def shipped(fn: Callable, root: str) -> Callable:
    """The query ``fn``, run after the library has been sent."""

    @wraps(fn)
    def run(spark: SparkSession, folder: str):
        ship(spark, root)
        return fn(spark, folder)

    return run
