"""From a cleaned table to one a generator can be fitted on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from mirrortab.functions.values import (as_number, date_from_ordinal, day_ordinal, is_moment, missing_to_null,
                                        moment_from_text, ref)
from mirrortab.operators.classify import DIRECT, LINKAGE, classes_of_schema, date_shares, text_columns
from mirrortab.operators.ordering import dense_index, skew_join

ORDINAL_SHARE = 0.9
NUMERIC_SHARE = 0.9
PSEUDONYM = "timeline_id"


def columns_of_class(df: DataFrame, *categories: str) -> list[str]:
    classes = classes_of_schema(df)
    return [c for c in df.columns if classes[c] in categories]


def strip_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*columns_of_class(df, DIRECT))


def pseudonyms(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """(key, timeline_id): 1, 2, ... in the order in which the key values first appear."""
    first = (df.where(ref(key).isNotNull()).groupBy(ref(key))
             .agg(F.min(F.struct(*[ref(c) for c in order_by])).alias("_first")))
    return dense_index(first, ["_first"], PSEUDONYM, start=1).drop("_first")


def pseudonymise(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Replace the key column by its pseudonym; null keys keep a null pseudonym."""
    spread = F.struct(*[ref(c) for c in order_by])
    return skew_join(df, pseudonyms(df, key, order_by), key, spread, how="left").drop(key)


def dates_to_ordinals(df: DataFrame) -> DataFrame:
    """Every date or timestamp column is replaced by ``<name>_ordinal``, appended at the end."""
    moments = [f.name for f in df.schema.fields if is_moment(f.dataType)]
    return df.select("*", *[day_ordinal(ref(c)).alias(f"{c}_ordinal") for c in moments]).drop(*moments)


def date_strings_to_ordinals(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Text columns that read as dates in at least nine known values of ten become day ordinals in place; their other cells become null."""
    return date_strings_counted(df, order_by)[0]


def date_strings_counted(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`date_strings_to_ordinals`, and the number of known cells that became null, for each column that has any."""
    texts = [c for c in text_columns(df) if c not in order_by]
    if not texts:
        return df, {}
    likely = {r["column"]: r["unread"] for r in date_shares(df, texts).where(F.col("share") >= ORDINAL_SHARE).collect()}
    out = df.select([day_ordinal(moment_from_text(ref(c))).alias(c) if c in likely else ref(c) for c in df.columns])
    return out, {c: n for c, n in likely.items() if n}


def readable_shares(df: DataFrame) -> tuple[dict[str, float], dict[str, int], list[str]]:
    """(share of rows that read as numbers per text column, known cells that do not, columns without any value) in one pass."""
    texts = text_columns(df)
    numbers = [as_number(df, c) for c in texts]
    row = df.agg(*[F.avg(x.isNotNull().cast("double")).alias(f"t{i}") for i, x in enumerate(numbers)],
                 *[F.count(F.when(x.isNull(), missing_to_null(df, c))).alias(f"u{i}") for i, (c, x) in enumerate(zip(texts, numbers))],
                 *[F.count(missing_to_null(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    shares = {c: row[f"t{i}"] or 0.0 for i, c in enumerate(texts)}
    return shares, {c: row[f"u{i}"] for i, c in enumerate(texts)}, [c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0]


def numeric_strings(df: DataFrame) -> DataFrame:
    """Text columns that read as numbers in at least nine rows of ten become doubles."""
    shares, _, _ = readable_shares(df)
    return df.select([as_number(df, c).alias(c) if shares.get(c, 0.0) >= NUMERIC_SHARE else ref(c)
                      for c in df.columns])


def drop_all_null(df: DataFrame) -> DataFrame:
    _, _, empty = readable_shares(df)
    return df.drop(*empty)


def model_ready(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Identifiers and keys gone, dates as day ordinals, numeric text as numbers, empty columns gone.

    ``order_by`` gives the row order for the look at first values; those columns are kept or dropped
    like any other.
    """
    return model_ready_counted(df, order_by)[0]


def model_ready_counted(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`model_ready`, and the number of known cells that became null, for each column that has any."""
    keys = columns_of_class(df, DIRECT, LINKAGE)
    hidden = {c: f"_order{i}" for i, c in enumerate(order_by)}
    ordered = df.select([ref(c) for c in df.columns if c not in keys]
                        + [ref(c).alias(h) for c, h in hidden.items()])
    moments = [f.name for f in ordered.schema.fields if is_moment(f.dataType) and f.name not in hidden.values()]
    dated = ordered.select("*", *[day_ordinal(ref(c)).alias(f"{c}_ordinal") for c in moments]).drop(*moments)
    ordinal, lost = date_strings_counted(dated, list(hidden.values()))
    body = ordinal.drop(*hidden.values())
    shares, unread, empty = readable_shares(body)
    numbers = [c for c, share in shares.items() if share >= NUMERIC_SHARE]
    out = body.select([as_number(body, c).alias(c) if c in numbers else ref(c) for c in body.columns if c not in empty])
    return out, lost | {c: unread[c] for c in numbers if unread[c]}


def ordinals_to_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Day ordinals back to dates; ``<name>_ordinal`` becomes ``<name>``."""
    return df.select([date_from_ordinal(ref(c)).alias(c.removesuffix("_ordinal")) if c in columns else ref(c)
                      for c in df.columns])
