"""The package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, so that they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="package-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, os.path.basename(top)), "zip", os.path.dirname(top), os.path.basename(top)))
        _shipped.add(sc.applicationId)
