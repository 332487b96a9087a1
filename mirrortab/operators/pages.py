"""Pages far down a sorted table: the table sorted once, and an index of which file holds which rows.

``offset`` gathers all rows before a page. Here the rows are written in order, in files of a known size, with one index row per
file; a page looks up the one or two files that it lies in and reads those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mirrortab.functions.values import missing_to_null, ref
from mirrortab.operators.ordering import shared_folder
from mirrortab.operators.view import PAGE_SIZES, sorted_rows

ROWS_PER_FILE = 1_000_000
PLACE = "_place"


@dataclass
class Pages:
    """A table in one order under ``path``: ``rows`` holds its sorted files, ``files`` the index."""

    spark: SparkSession
    path: str
    total: int

    @classmethod
    def build(cls, df: DataFrame, sort: str, direction: str = "asc", key: Sequence[str] = (), path: str | None = None,
              rows_per_file: int = ROWS_PER_FILE) -> Pages:
        """Sort and write ``df``. Missing values come last either way, ties follow ``key``; equal rows under it in any order, but a fixed one."""
        if sort not in df.columns:
            raise ValueError(f"no column {sort}")
        spark = df.sparkSession
        path = path or f"{shared_folder(spark)}/pages-{uuid.uuid4()}"
        ordered = sorted_rows(df, sort, direction, key).select(*[missing_to_null(df, c).alias(c) for c in df.columns],
                                                               F.monotonically_increasing_id().alias(PLACE))
        ordered.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
        # One row per file; its rows are consecutive places of one partition.
        files = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        files.withColumn("before", before).write.parquet(f"{path}/files")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Pages:
        """What :meth:`build` has written."""
        return cls(spark, path, spark.read.parquet(f"{path}/files").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """The rows of one page, in order; none behind the last one."""
        if number < 1 or not PAGE_SIZES[0] <= size <= PAGE_SIZES[1]:
            raise ValueError(f"page starts at 1 and holds {PAGE_SIZES[0]} to {PAGE_SIZES[1]} rows")
        start, stop = (number - 1) * size, number * size
        index = self.spark.read.parquet(f"{self.path}/files")
        held = index.where((F.col("before") < stop) & (F.col("before") + F.col("rows") > start)).collect()
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        if not held:
            return self.spark.createDataFrame([], schema).drop(PLACE)
        spans = [(f["first"] + max(0, start - f["before"]), f["first"] + min(f["rows"], stop - f["before"]) - 1) for f in held]
        rows = self.spark.read.schema(schema).parquet(*[f["file"] for f in held])
        return rows.where(reduce(or_, [F.col(PLACE).between(a, b) for a, b in spans])).orderBy(PLACE).drop(PLACE)
