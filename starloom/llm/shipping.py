"""Making the package known to Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

import starloom


def ship(spark: SparkSession) -> None:
    """In local mode, hand the package to workers that would not find it by their path; once per session.

    On a cluster it is installed or given by ``--py-files``, as any package.
    """
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        return
    folder = os.path.dirname(os.path.abspath(starloom.__file__))
    if not any(os.path.basename(str(f).rstrip("/")) == os.path.basename(folder) for f in context.listFiles):
        context.addFile(folder, recursive=True)
