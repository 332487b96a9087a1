"""Cleaning: duplicates, missing values, booleans and dates held as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from mirrortab import rules
from mirrortab.functions.values import (as_number, is_number, is_text, missing_to_null, moment_from_text, ref,
                                        truth_of_text, type_of)
from mirrortab.operators.classify import date_shares, infer_types, text_columns
from mirrortab.operators.frequency import medians, modes
from mirrortab.operators.ordering import cut_lineage
from mirrortab.operators.scans import Levels, carried, with_cells

DATE_SHARE = 0.9


def rename_columns(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in (mapping or {}).items() if k in df.columns})


def drop_duplicates(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per distinct row, nulls equal; with ``order_by`` (not compared) the first one is kept."""
    if order_by is None:
        return df.dropDuplicates()
    content = [ref(c) for c in df.columns if c != order_by]
    return df.groupBy(*content).agg(F.min(ref(order_by)).alias(order_by)).select([ref(c) for c in df.columns])


def missing_handled(df: DataFrame) -> DataFrame:
    """(column, missing) for the columns that have missing values; one pass."""
    counts = df.agg(*[F.count(missing_to_null(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
                    F.count(F.lit(1)).alias("n"))
    cells = [x for i, c in enumerate(df.columns) for x in (F.lit(c), F.col("n") - F.col(f"n{i}"))]
    return (counts.select(F.stack(F.lit(len(df.columns)), *cells).alias("column", "missing"))
            .where(F.col("missing") > 0))


def _replaced(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select([new.get(c, ref(c)).alias(c) for c in df.columns])


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers become the exact median; such a column turns into doubles."""
    found = medians(df, columns)
    return _replaced(df, {c: F.coalesce(as_number(df, c), F.lit(found[c])) for c in columns if c in found})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the most frequent value (smallest among ties), ``Unknown`` if there is none."""
    if not columns:
        return df
    found = {r["column"]: r["value"] for r in modes(df, columns).collect()}
    new = {}
    for c in columns:
        dtype = type_of(df, c)
        value = found.get(c, "Unknown" if is_text(dtype) else None)
        new[c] = F.coalesce(ref(c), F.lit(value).cast(dtype))
    return _replaced(df, new)


def fill_along(df: DataFrame, columns: Sequence[str], order_by: str, levels: Levels | None = None) -> DataFrame:
    """Missing values take the previous known one in row order, the next one at the start.

    ``order_by`` is unique per row. The order is cut into cells (:mod:`scans`); windows run inside a cell, and one row per
    cell carries the last and next known values across.
    """
    if not columns:
        return df
    levels = levels or Levels.for_rows(df.count())
    place = order_number(df, order_by)
    placed = with_cells(df, place.cast("double"), "_cell", levels)
    known, kinds = [], {}
    for i, c in enumerate(columns):
        when_known = F.when(missing_to_null(df, c).isNotNull(), place)
        known += [F.max_by(ref(c), when_known).alias(f"_before{i}"), F.min_by(ref(c), when_known).alias(f"_after{i}")]
        kinds |= {f"_before{i}": "last", f"_after{i}": "next"}
    carry = carried(placed.groupBy("_cell").agg(*known), "_cell", kinds, levels)

    # Looking ahead is looking back in descending order: a frame that ends at the last row would be
    # evaluated anew for every row.
    def known_before(order: Column) -> WindowSpec:
        return Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    back, ahead = known_before(ref(order_by).asc()), known_before(ref(order_by).desc())
    # One level has at most a thousand cells; more are joined on the partitioning that the windows need anyway.
    filled = placed.join(F.broadcast(carry) if levels.levels == 1 else carry, "_cell")
    new = {c: F.coalesce(F.last(missing_to_null(df, c), ignorenulls=True).over(back), F.col(f"_before{i}"),
                         F.last(missing_to_null(df, c), ignorenulls=True).over(ahead), F.col(f"_after{i}"))
           for i, c in enumerate(columns)}
    return filled.select([new.get(c, ref(c)).alias(c) for c in df.columns])


def order_number(df: DataFrame, name: str) -> Column:
    """Order column as a number: as it is, or microseconds for dates and timestamps."""
    dtype = type_of(df, name)
    return ref(name) if is_number(dtype) else F.unix_micros(ref(name).cast("timestamp"))


def boolean_like(df: DataFrame) -> list[str]:
    """Text columns that hold nothing but yes/no words; one pass."""
    texts = text_columns(df)
    if not texts:
        return []
    words = [*rules.TRUE_WORDS, *rules.FALSE_WORDS, "nan"]
    row = df.agg(*[F.min(F.coalesce(F.lower(ref(c)), F.lit("nan")).isin(words)).alias(f"b{i}")
                   for i, c in enumerate(texts)]).first()
    return [c for i, c in enumerate(texts) if row[f"b{i}"]]


def cast_booleans(df: DataFrame) -> DataFrame:
    return _replaced(df, {c: truth_of_text(ref(c)) for c in boolean_like(df)})


def cast_dates(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Text columns that read as dates in more than nine known values of ten become timestamps; the rest of their cells become null."""
    return cast_dates_counted(df, order_by)[0]


def cast_dates_counted(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cast_dates`, and the number of cells that did not read as dates and became null, for each column that has any."""
    texts = [c for c in text_columns(df) if c not in order_by]
    if not texts:
        return df, {}
    likely = {r["column"]: r["unread"] for r in date_shares(df, texts).where(F.col("share") > DATE_SHARE).collect()}
    return _replaced(df, {c: moment_from_text(ref(c)) for c in likely}), {c: n for c, n in likely.items() if n}


def impute(df: DataFrame, order_by: str, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Fill every column that has missing values by its type; (filled, missing counts)."""
    columns = [c for c in df.columns if c != order_by] if columns is None else list(columns)
    counts = {r["column"]: r["missing"] for r in missing_handled(df.select([ref(c) for c in columns])).collect()}
    with_gaps = [c for c in columns if c in counts]
    if not with_gaps:
        return df, counts
    picked = df.select([ref(c) for c in dict.fromkeys([*with_gaps, order_by])])
    types = {r["column"]: r["dtype"] for r in infer_types(picked).collect()}
    numbers = [c for c in with_gaps if types[c] in ("integer", "float")]
    moments = [c for c in with_gaps if types[c] == "datetime"]
    others = [c for c in with_gaps if c not in numbers and c not in moments]
    filled = fill_mode(fill_median(df, numbers), others)
    return fill_along(filled, moments, order_by), counts


def preprocess(df: DataFrame, approved: Sequence[str], order_by: str,
               mapping: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Project, rename, deduplicate, impute, read booleans and dates; (cleaned, one-row summary).

    ``order_by`` is a unique row order; it is left out of the result unless it is approved itself.
    The deduplicated table is written once and serves the statistics passes and the rewrite.
    """
    if order_by in approved:
        raise ValueError("give the row order as a column of its own, next to the approved ones")
    names = [(mapping or {}).get(c, c) for c in approved]
    projected = rename_columns(df.select([ref(c) for c in [*approved, order_by]]), mapping)
    rows_before = df.count()
    distinct = cut_lineage(drop_duplicates(projected, order_by))
    rows_after = distinct.count()
    filled, counts = impute(distinct, order_by, names)
    cleaned, unread = cast_dates_counted(cast_booleans(filled), [order_by])
    excluded = [c for c in df.columns if c not in approved and c != order_by]
    summary = df.sparkSession.createDataFrame(
        [(rows_before, rows_after, rows_before - rows_after, [(c, counts[c]) for c in names if c in counts],
          [(c, unread[c]) for c in names if c in unread], names, excluded)],
        "rows_before bigint, rows_after bigint, duplicates_removed bigint, "
        "missing_handled array<struct<column: string, missing: bigint>>, "
        "unread_dates array<struct<column: string, cells: bigint>>, "
        "columns_included array<string>, columns_excluded array<string>")
    return cleaned.select([ref(c) for c in names]), summary
