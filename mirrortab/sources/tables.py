"""Reading input tables, gates on them, and landing them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from mirrortab.functions.values import na_words_to_null, number_from_text, ref
from mirrortab.operators.view import chosen_columns
from mirrortab.sources.splitting import read_csv

MIN_ROWS_UPLOAD = 10
MIN_ROWS_MODEL = 50
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
FORMATS = ("csv", "parquet", "json", "orc")


class GateError(ValueError):
    """An input table was rejected."""


def new_id() -> str:
    return str(uuid.uuid4())


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None) -> DataFrame:
    """Read a table; CSV has a header. Without a schema the types follow from the content."""
    if fmt not in FORMATS:
        raise GateError(f"unsupported format: {fmt}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt != "csv":
        return reader.format(fmt).load(path)
    # Cells may hold line ends and doubled quotes; a file is split among tasks all the same.
    rows = na_words_to_null(read_csv(spark, path, CSV, schema))
    return rows if schema is not None else typed(rows)


def typed(df: DataFrame) -> DataFrame:
    """Give all-text columns a type: boolean, bigint or double where every known value reads as one.

    Whole numbers of which one does not fit into a bigint stay text, because doubles would merge them. One aggregation over the table decides for all columns; missing-value spellings are already null.
    """
    aggs = []
    for i, c in enumerate(df.columns):
        x = ref(c)
        aggs += [F.count(x).alias(f"n{i}"), F.count(number_from_text(x)).alias(f"f{i}"),
                 F.count(F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), 1)).alias(f"i{i}"),
                 F.count(F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x).try_cast("bigint"))).alias(f"g{i}"),
                 F.count(F.when(F.lower(x).isin("true", "false"), 1)).alias(f"b{i}")]
    row = df.agg(*aggs).first()

    def cast(i: int, c: str) -> Column:
        x, n = ref(c), row[f"n{i}"]
        if n and row[f"b{i}"] == n:
            return (F.lower(x) == "true").alias(c)
        if n and row[f"i{i}"] == n:
            return F.trim(x).try_cast("bigint").alias(c) if row[f"g{i}"] == n else x
        return number_from_text(x).alias(c) if n and row[f"f{i}"] == n else x

    return df.select([cast(i, c) for i, c in enumerate(df.columns)])


def gate_facts(df: DataFrame, min_rows: int = MIN_ROWS_UPLOAD) -> DataFrame:
    """(rule, passed): the table is not empty, has columns, and has enough rows. Reads only that many."""
    seen = df.limit(min_rows).agg(F.count(F.lit(1)).alias("n"))
    cells = [F.lit("not_empty"), F.col("n") > 0, F.lit("has_columns"), F.lit(len(df.columns) > 0),
             F.lit("enough_rows"), F.col("n") >= min_rows]
    return seen.select(F.stack(F.lit(3), *cells).alias("rule", "passed"))


def gate(df: DataFrame, min_rows: int = MIN_ROWS_UPLOAD) -> DataFrame:
    """The table itself, or GateError naming the first rule it breaks."""
    for r in gate_facts(df, min_rows).collect():
        if not r["passed"]:
            raise GateError(f"table rejected: {r['rule']} (at least {min_rows} rows needed)")
    return df


def land(df: DataFrame, root: str, stage: str = "raw", table_id: str | None = None) -> tuple[str, str]:
    """Write a table under a new id; (id, path)."""
    table_id = table_id or new_id()
    path = f"{root}/{stage}/{table_id}"
    df.write.mode("overwrite").parquet(path)
    return table_id, path


def read_landed(spark: SparkSession, root: str, stage: str, table_id: str) -> DataFrame:
    """Read a landed table back; Spark raises AnalysisException when it is absent."""
    return spark.read.parquet(f"{root}/{stage}/{table_id}")


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write CSV with a header; unknown column names are skipped, the caller's order is kept."""
    chosen_columns(df, columns).write.mode("overwrite").options(**CSV).option("escapeQuotes", True).csv(path)
