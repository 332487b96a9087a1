"""Registry of queries and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mirrortab.operators.prepare import dates_to_ordinals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows on the same tables."""
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Long generated methods are not compiled by the JVM; past this size Spark splits them instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The two sides of a comparison: shipments before and after a day, together the whole table.
SPLIT_DAY = "1998-07-01"
SOURCE_SQL = f"SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT_DAY}'"
SYNTH_SQL = f"SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT_DAY}'"
# The same, cut so that one side is more than twice the other.
EARLY_DAY = "1996-07-01"
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["l_returnflag", "l_linestatus"]


def sides(spark: SparkSession, folder: str, day: str = SPLIT_DAY) -> tuple[DataFrame, DataFrame]:
    li = table(spark, folder, "lineitem")
    cut = F.lit(day).cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


def ready_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    a, b = sides(spark, folder)
    keep = [*MEASURES, *FLAGS, "l_shipdate"]
    return dates_to_ordinals(a.select(*keep)), dates_to_ordinals(b.select(*keep))


ORDINAL_SQL = "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + 719163 AS BIGINT)"


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with missing values in a number, a flag and a date."""
    li = table(spark, folder, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax",
        F.when(F.col("l_discount") != 0.05, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus",
        F.when(F.col("l_tax") != 0.03, F.col("l_shipdate")).alias("l_shipdate"))


GAPPY_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_linenumber <> 4 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount, l_tax,
       CASE WHEN l_discount <> 0.05 THEN l_returnflag END AS l_returnflag, l_linestatus,
       CASE WHEN l_tax <> 0.03 THEN l_shipdate END AS l_shipdate
FROM lineitem"""


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Events as patient visits; visit_no is the unique row order."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("visit_no"), F.col("user_id").alias("patient_id"), F.col("ts").alias("visit_date"),
        F.col("event_type").alias("visit_type"), F.col("value").alias("pain_score"))


VISITS_SQL = ("SELECT event_id AS visit_no, user_id AS patient_id, ts AS visit_date, event_type AS visit_type, "
              "value AS pain_score FROM events")


def text_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents of two groups of origins, together the whole table."""
    docs = table(spark, folder, "documents")
    return docs.where(F.col("source") < "src2"), docs.where(F.col("source") >= "src2")


def part_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parts of two groups of types, together the whole table."""
    part = table(spark, folder, "part")
    return part.where(F.col("p_type") < "M"), part.where(F.col("p_type") >= "M")


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Doubles rounded, so that two engines agree on them."""
    return df.select([F.round(F.col(f.name), special.get(f.name, digits)).alias(f.name)
                      if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
