"""Tables in the shared folder, and small facts about a run."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mirrortab.operators.ordering import shared_folder


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4()}"


def saved(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what follows depends on files only."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table of :func:`saved` that nothing reads any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        df._saved_path = None


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """Each row as one struct ``row`` beside ``named`` columns, so that no name of ``df`` can clash with an operator's."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named.items()])


def by_verdict(df: DataFrame, key: str, text: str, found: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``df``, packed, with what ``found`` (_key, _digest, ...) has for their key and xxhash64 of the text; null keys match null ones."""
    met = packed(df, _k=df[f"`{key}`"], _d=F.xxhash64(df[f"`{text}`"]))
    return met.join(found, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_d") == F.col("_digest")), how)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, so that they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="package-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, os.path.basename(top)), "zip", os.path.dirname(top), os.path.basename(top)))
        _shipped.add(sc.applicationId)
