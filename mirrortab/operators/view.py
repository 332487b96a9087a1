"""Looking at a table: search, sort, pages, chosen columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from mirrortab.functions.values import is_number, missing_to_null, ref

PAGE_SIZES = (10, 500)


def search(df: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Rows where any cell matches the pattern, without regard to case; nulls never match."""
    text = re.escape(pattern) if literal else pattern
    hits = [F.coalesce(ref(c).cast("string").rlike(f"(?i){text}"), F.lit(False)) for c in df.columns]
    return df.where(reduce(or_, hits))


def sorted_rows(df: DataFrame, column: str | None, direction: str = "asc", key: Sequence[str] = ()) -> DataFrame:
    """Rows by one column, nulls last either way, ties by ``key``; an unknown column changes nothing."""
    if column is None or column not in df.columns:
        return df
    c = missing_to_null(df, column)
    first = c.desc_nulls_last() if direction.lower() == "desc" else c.asc_nulls_last()
    return df.orderBy(first, *[ref(k) for k in key])


def page(df: DataFrame, number: int = 1, size: int = 50, sort: str | None = None, direction: str = "asc",
         key: Sequence[str] = (), pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of one page, one-row table with the number of matching rows)."""
    if number < 1 or not PAGE_SIZES[0] <= size <= PAGE_SIZES[1]:
        raise ValueError(f"page starts at 1 and holds {PAGE_SIZES[0]} to {PAGE_SIZES[1]} rows")
    found = search(df, pattern) if pattern else df
    ordered = sorted_rows(found, sort, direction, key) if sort in df.columns else \
        (found.orderBy(*[ref(k) for k in key]) if key else found)
    rows = ordered.offset((number - 1) * size).limit(size)
    return rows.select([missing_to_null(df, c).alias(c) for c in df.columns]), \
        found.agg(F.count(F.lit(1)).alias("total_rows"))


def chosen_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The named columns in the caller's order; unknown names are skipped."""
    return df.select([ref(c) for c in columns if c in df.columns]) if columns else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]
