"""Run log: append-only Parquet tables, newest row per id counts.

Each append is one small file, the tail. Past ``TAIL_FILES`` of them a snapshot gathers all rows in a few files and names the tail
files that it covers; a reader takes the last whole snapshot and the tail files it does not name. Nothing is locked: an append that
lands while a snapshot is written is not named and stays in the tail, a snapshot that was not finished does not count, and of two
written at once one counts and the other is a mere copy. Files go only once a later snapshot holds their rows as well, so a reader
has from one compaction to the next but one to finish.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mirrortab.functions.values import ref
from mirrortab.sources.tables import new_id

LISTED = 20
TAIL_FILES = 64
SNAPSHOT_FILES = 8

SCHEMAS = {
    "datasets": "id string, name string, num_rows bigint, num_columns bigint, "
                "columns array<struct<column: string, dtype: string, missing_count: bigint, unique_count: bigint, "
                "category: string>>, "
                "sensitive_columns array<string>, approved_columns array<string>, preprocessed_path string, "
                "is_demo boolean, status string, written_at timestamp",
    "generations": "id string, dataset_id string, num_requested bigint, num_generated bigint, model_used string, "
                   "requirements array<struct<feature: string, operator: string, value: string, target: double>>, "
                   "cohort_report array<struct<label: string, requested_pct: double, generated_pct: double, "
                   "diff_pct: double, status: string>>, output_path string, source_path string, seconds double, "
                   "progress int, message string, error string, unread_cells array<struct<column: string, cells: bigint>>, "
                   "status string, written_at timestamp",
    "validations": "id string, generation_id string, dataset_id string, overall struct<distribution_similarity: double, "
                   "correlation_preservation: double, ks_pass_rate: double, ks_tested_columns: bigint, "
                   "ks_passed_columns: bigint, ks_skipped_columns: bigint, overall_quality: double>, "
                   "report_path string, written_at timestamp",
    "privacy_checks": "id string, generation_id string, dataset_id string, exact_duplicates bigint, "
                      "near_duplicates bigint, risk_level string, report_path string, written_at timestamp",
}


def append(spark: SparkSession, root: str, table: str, record: Mapping) -> dict:
    """Add one row; missing fields are null, id and time are filled in."""
    schema = spark.createDataFrame([], SCHEMAS[table]).schema
    full = {"id": new_id(), "written_at": dt.datetime.now(dt.timezone.utc), **record}
    unknown = set(full) - set(schema.names)
    if unknown:
        raise ValueError(f"{table} has no fields {sorted(unknown)}")
    spark.createDataFrame([tuple(full.get(n) for n in schema.names)], schema) \
        .coalesce(1).write.mode("append").parquet(f"{root}/{table}")
    if len(_files(spark, f"{root}/{table}")) > TAIL_FILES:
        compact(spark, root, table)
    return full


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reaches; none if there is no such folder."""
    files, place = _at(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def _files(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in _names(spark, folder) if n.startswith("part-")]


def _snapshots(spark: SparkSession, root: str, table: str) -> list[str]:
    """Paths of the whole snapshots, the one that counts last; the list of covered files is written last."""
    folder = f"{root}/{table}.snapshots"
    return [f"{folder}/{n}" for n in _names(spark, folder) if "_SUCCESS" in _names(spark, f"{folder}/{n}/covered")]


def _covered(spark: SparkSession, snapshot: str) -> set[str]:
    return {r["name"] for r in spark.read.schema("name string").parquet(f"{snapshot}/covered").collect()}


def _state(spark: SparkSession, root: str, table: str) -> tuple[str | None, list[str]]:
    """(the snapshot that counts, tail files beyond it). The tail is listed first: what vanishes afterwards is in the snapshot."""
    tail = _files(spark, f"{root}/{table}")
    whole = _snapshots(spark, root, table)
    covered = _covered(spark, whole[-1]) if whole else set()
    return whole[-1] if whole else None, [n for n in tail if n not in covered]


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows of a run table; empty before the first one is written."""
    return _rows(spark, root, table, *_state(spark, root, table))


def _rows(spark: SparkSession, root: str, table: str, snapshot: str | None, tail: Sequence[str]) -> DataFrame:
    reader, paths = spark.read.schema(SCHEMAS[table]), [f"{root}/{table}/{n}" for n in tail]
    if snapshot is not None:
        paths = [f"{snapshot}/rows", *paths]
    return reader.parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])


def compact(spark: SparkSession, root: str, table: str) -> None:
    """Write a snapshot of all rows, then delete what the snapshot before it made superfluous."""
    base, tail = _state(spark, root, table)
    older = _snapshots(spark, root, table)
    number = int(base.rsplit("/", 1)[-1].split("-")[0]) + 1 if base else 1
    path = f"{root}/{table}.snapshots/{number:012d}-{uuid.uuid4()}"
    _rows(spark, root, table, base, tail).coalesce(SNAPSHOT_FILES).write.parquet(f"{path}/rows")
    gone = _covered(spark, base) if base else set()
    # Files of the base are still there for readers that began with the snapshot before it.
    there = set(_files(spark, f"{root}/{table}"))
    names = sorted((gone & there) | set(tail))
    spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{path}/covered")
    for name in sorted(gone & there):
        files, place = _at(spark, f"{root}/{table}/{name}")
        files.delete(place, False)
    for old in older:
        if old != base:
            files, place = _at(spark, old)
            files.delete(place, True)


def latest(rows: DataFrame, key: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """Newest row per key. An aggregation, so a key with very many rows is combined before the shuffle."""
    row = F.struct(*[ref(c) for c in rows.columns])
    top = rows.groupBy(*[ref(k).alias(f"_key{i}") for i, k in enumerate(key)]) \
        .agg(F.max_by(row, F.struct(*newest)).alias("_row"))
    return top.select("_row.*")


def report_for(rows: DataFrame, generation_id: str) -> DataFrame:
    """The newest report of one generation, if there is one."""
    return latest(rows.where(F.col("generation_id") == generation_id), ["generation_id"], [F.col("written_at")])


def newest_runs(rows: DataFrame, order_by: Sequence[Column], where: Column | None = None, k: int = LISTED) -> DataFrame:
    """The first ``k`` rows in the given order."""
    return (rows if where is None else rows.where(where)).orderBy(*order_by).limit(k)


def states(rows: DataFrame, newest: Sequence[Column] | None = None) -> DataFrame:
    """Where every generation stands: its newest row, with defaults for what is not known yet."""
    top = latest(rows, ["id"], newest or [F.col("written_at")])
    known = {"progress": F.lit(0), "message": F.lit(""), "cohort_report": F.array()}
    return top.withColumns({c: F.coalesce(ref(c), known[c].cast(top.schema[c].dataType)) for c in known if c in top.columns})


def status(rows: DataFrame, run_id: str) -> dict | None:
    """Where one generation stands; None for an unknown one."""
    found = states(rows.where(F.col("id") == run_id)).first()
    return None if found is None else found.asDict(recursive=True)


def parsed(c: Column, schema: str) -> Column:
    """Report text of older logs as columns; null where it does not parse."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def as_text(record: Mapping) -> str:
    return json.dumps(record, default=str, sort_keys=True)
