"""Column profiles, longitudinal structure, cohort profiles, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mirrortab import rules
from mirrortab.functions.values import missing_to_null, ref
from mirrortab.operators.classify import (DIRECT, LINKAGE, TEMPORAL, class_of_name, column_kinds, first_values,
                                          infer_types)
from mirrortab.operators.frequency import counts_by_column, frequencies, number_cells

SAMPLES = 5


def profile(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """One row per column: type, missing values, distinct values, first samples, sensitivity."""
    types = infer_types(df)
    samples = (first_values(df, df.columns, SAMPLES, order_by).groupBy("column")
               .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_s"))
               .select("column", F.transform("_s", lambda s: s["value"]).alias("sample_values")))
    out = types.join(F.broadcast(counts_by_column(df, df.columns)), "column", "left").join(F.broadcast(samples), "column", "left")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    return out.select(
        "position", "column", "dtype",
        F.coalesce("missing_count", zero).alias("missing_count"),
        F.coalesce(F.round(F.col("missing_count") / F.col("total") * 100, 2), F.lit(0.0)).alias("missing_pct"),
        F.coalesce("unique_count", zero).alias("unique_count"),
        F.coalesce("sample_values", none).alias("sample_values"),
        (class_of_name(F.col("column")) == DIRECT).alias("is_sensitive"))


def longitudinal_info(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """One row: is the table longitudinal, by which key and time column, and how many rows per subject.

    ``classes`` maps column to class; the first linkage key and the first temporal column are used.
    """
    keys = [c for c in df.columns if classes.get(c) == LINKAGE]
    times = [c for c in df.columns if classes.get(c) == TEMPORAL]
    zero = F.lit(0).cast("bigint")
    if not keys:
        return df.agg(F.count(F.lit(1)).alias("total_observations")).select(
            F.lit(False).alias("is_longitudinal"), F.lit("cross_sectional").alias("dataset_type"),
            F.lit(None).cast("string").alias("linkage_key"), F.lit(None).cast("string").alias("temporal_column"),
            zero.alias("unique_subjects"), "total_observations", F.lit(0.0).alias("avg_obs_per_subject"),
            zero.alias("max_obs_per_subject"), zero.alias("repeated_subjects"))
    per_subject = df.groupBy(ref(keys[0]).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("key").isNotNull()
    sums = per_subject.agg(
        F.coalesce(F.sum("n"), zero).alias("total_observations"),
        F.count("key").alias("unique_subjects"),
        F.coalesce(F.round(F.avg(F.when(known, F.col("n"))), 2), F.lit(0.0)).alias("avg_obs_per_subject"),
        F.coalesce(F.max(F.when(known, F.col("n"))), zero).alias("max_obs_per_subject"),
        F.count(F.when(known & (F.col("n") > 1), 1)).alias("repeated_subjects"))
    repeats = F.col("repeated_subjects") > 0
    time = F.lit(times[0] if times else None).cast("string")
    return sums.select(
        repeats.alias("is_longitudinal"),
        F.when(repeats, "longitudinal").otherwise("cross_sectional").alias("dataset_type"),
        F.lit(keys[0]).alias("linkage_key"), F.when(repeats, time).alias("temporal_column"),
        "unique_subjects", "total_observations", "avg_obs_per_subject", "max_obs_per_subject", "repeated_subjects")


def dataset_summary(df: DataFrame, order_by: Sequence[str], classes: dict[str, str]) -> DataFrame:
    """(position, column, dtype, missing_count, unique_count, category, longitudinal facts): the upload view."""
    info = longitudinal_info(df, classes).first()
    category = F.create_map(*[F.lit(x) for item in classes.items() for x in item])
    return profile(df, order_by).select(
        "position", "column", "dtype", "missing_count", "unique_count",
        category[F.col("column")].alias("category"),
        F.lit(info["total_observations"]).cast("bigint").alias("total_observations"),
        F.lit(info["dataset_type"]).alias("dataset_type"),
        F.lit(info["linkage_key"]).cast("string").alias("linkage_key"),
        F.lit(info["unique_subjects"]).cast("bigint").alias("unique_subjects"))


def cohort_profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, unique_count) of numeric columns."""
    seen = frequencies(df, columns, numeric=True)
    value = F.col("value")
    return seen.groupBy("column").agg(
        F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(value * F.col("n")) / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("unique_count"))


def ordinal_rank(value: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for item in rules.ORDINAL_RANKS.items() for x in item])
    return F.coalesce(F.try_element_at(ranks, F.lower(F.trim(value))), F.lit(rules.ORDINAL_UNKNOWN_RANK))


def cohort_profile_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, rank): the distinct values of each column, as rows.

    Rows and not an array, so that a column with very many values stays distributed. Sorting by
    (rank, value) gives the suggested answer-scale order, sorting by value the plain one.
    """
    seen = frequencies(df, columns).where(F.col("value").isNotNull())
    return seen.select("column", "value", "n", ordinal_rank(F.col("value")).alias("rank"))


def ordinal_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, ordinal_order) for columns of kind ordinal, whose values a scale of six bounds."""
    ranked = cohort_profile_values(df, columns).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("_s"))
    return ranked.select("column", F.transform("_s", lambda s: s["value"]).alias("ordinal_order"))


def cohort_profile(df: DataFrame, order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(column, dtype, kind, min, max, mean, unique_count) for every modelling column."""
    kinds = column_kinds(df.select([ref(c) for c in columns]))
    kinds = kinds.where(F.col("column").isin(list(columns)))
    numbers = [f.name for f in df.schema.fields if f.name in columns and f.dataType.typeName() in
               ("byte", "short", "integer", "long", "float", "double", "decimal")]
    facts = counts_by_column(df, columns).select("column", "unique_count")
    out = kinds.join(F.broadcast(facts), "column", "left")
    if numbers:
        spans = cohort_profile_numeric(df, numbers).select("column", "min", "max", "mean")
        out = out.join(F.broadcast(spans), "column", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean")])
    return out.select("column", "dtype", "kind", "min", "max", "mean",
                      F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(column, bin, low, high, count): equal-width bins, last edge inclusive, empty bins included."""
    cells = number_cells(df, columns)
    span = cells.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    edges = span.select("column", "lo", F.when(width == 0, 1.0).otherwise(width).alias("width"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counted = (cells.join(F.broadcast(edges), "column").groupBy("column", at.alias("bin"))
               .agg(F.count(F.lit(1)).alias("count")))
    every = edges.select("column", "lo", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(name, value): count per category, null as Unknown."""
    name = F.coalesce(missing_to_null(df, column).cast("string"), F.lit("Unknown"))
    return df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("value"))
