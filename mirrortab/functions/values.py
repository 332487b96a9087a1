"""Column expressions that coerce and clean single values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mirrortab import rules

NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Day number of 1970-01-01 when 0001-01-01 is day 1.
EPOCH_ORDINAL = 719163


def ref(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def number_from_text(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_SHAPE), F.trim(c).try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a double; booleans become 0/1, unreadable text, NaN and moments become null."""
    dtype, c = type_of(df, name), ref(name)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return nan_to_null(c.cast("double"))
    if is_number(dtype):
        return c.cast("double")
    if is_text(dtype):
        return number_from_text(c)
    return F.lit(None).cast("double")


def missing_to_null(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null; other types unchanged."""
    c = ref(name)
    return nan_to_null(c) if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)) else c


def finite_or(c: Column, fallback: Column) -> Column:
    """``c`` where it is a finite number, else ``fallback``."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(c.isNull() | bad, fallback).otherwise(c)


def moment_from_text(c: Column) -> Column:
    """Timestamp read from the recognised date spellings; null for anything else."""
    trimmed = F.trim(c)
    parsed = [F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(pattern)))
              for shape, pattern in rules.DATE_SHAPES]
    return F.coalesce(*parsed)


def day_ordinal(c: Column) -> Column:
    return (F.unix_date(c.cast("date")) + F.lit(EPOCH_ORDINAL)).cast("bigint")


def date_from_ordinal(c: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (c - F.lit(EPOCH_ORDINAL)).cast("int"))


def truth_of_text(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin(rules.TRUE_WORDS), True).when(word.isin(rules.FALSE_WORDS), False)


def normalised_name(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def na_words_to_null(df: DataFrame) -> DataFrame:
    """Text cells that spell a missing value become null, as a CSV reader would read them."""
    return df.select([
        F.when(~ref(f.name).isin(rules.MISSING_WORDS), ref(f.name)).alias(f.name)
        if is_text(f.dataType) else ref(f.name) for f in df.schema.fields])


def doubles(values: Sequence[float]) -> Column:
    """A literal array of doubles.

    One text literal that the optimizer folds, not one expression per number: plans with thousands of
    literals take seconds to analyse.
    """
    text = ",".join("Infinity" if v == float("inf") else repr(float(v)) for v in values)
    return F.split(F.lit(text), ",").cast("array<double>")
