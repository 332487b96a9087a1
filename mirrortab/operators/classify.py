"""Privacy classes of columns, logical types, and schema comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mirrortab import rules
from mirrortab.functions.values import is_moment, is_text, moment_from_text, normalised_name, ref
from mirrortab.operators.frequency import frequencies
from mirrortab.operators.ordering import head_rows

LINKAGE, TEMPORAL, HEALTH = "longitudinal_key", "temporal", "sensitive_health"
DIRECT, QUASI, CLINICAL = "direct_identifier", "quasi_identifier", "clinical"
MAIL_DISTINCT_SHARE = 0.8
TYPE_SHARE = 0.8
HEAD = 1000


def class_of_name(name: Column, mail_like: Column | None = None) -> Column:
    """Class of a column name; the first rule that matches wins."""
    n = normalised_name(name)
    ladder = (F.when(n.isin(rules.LINKAGE_KEY_NAMES) | n.rlike(rules.LINKAGE_KEY_PATTERN), LINKAGE)
              .when(n.isin(rules.TEMPORAL_NAMES) | n.rlike(rules.TEMPORAL_PATTERN), TEMPORAL)
              .when(n.isin(rules.HEALTH_NAMES), HEALTH)
              .when(n.isin(rules.DIRECT_ID_NAMES), DIRECT)
              .when(n.isin(rules.QUASI_ID_NAMES), QUASI)
              .when(n.rlike(rules.DIRECT_ID_PATTERN), DIRECT))
    if mail_like is not None:
        ladder = ladder.when(mail_like, DIRECT)
    return ladder.otherwise(CLINICAL)


def columns_table(df: DataFrame) -> DataFrame:
    """(position, column, dtype): the schema as a table."""
    rows = [(i, f.name, logical_type(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def first_values(df: DataFrame, columns: Sequence[str], k: int, order_by: Sequence[str]) -> DataFrame:
    """(column, place, value): the first ``k`` non-null values of each column as text, in row order.

    The leading rows usually hold them all; a column that is too sparse there gets its own top-k scan.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, place int, value string")
    order = [ref(c) for c in order_by]

    def head_of(part: DataFrame, names: Sequence[str]) -> DataFrame:
        tops = []
        for name in names:
            top = (part.where(ref(name).isNotNull()).orderBy(*order).limit(k)
                   .agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)],
                                                             ref(name).cast("string").alias("_v")))).alias("_t")))
            tops.append(top.select(F.lit(name).alias("column"), F.posexplode("_t").alias("place", "_s"))
                        .select("column", "place", F.col("_s._v").alias("value")))
        out = tops[0]
        for t in tops[1:]:
            out = out.unionByName(t)
        return out

    keep = list(dict.fromkeys([*order_by, *columns]))
    near = head_rows(df.select([ref(c) for c in keep]), order_by, HEAD)
    filled = near.agg(*[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("n")).first()
    whole = filled["n"] < HEAD
    dense = [c for i, c in enumerate(columns) if whole or filled[f"n{i}"] >= k]
    sparse = [c for c in columns if c not in dense]
    parts = ([_head_table(near, dense, k, order_by)] if dense else []) + ([head_of(df, sparse)] if sparse else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _head_table(near: DataFrame, columns: Sequence[str], k: int, order_by: Sequence[str]) -> DataFrame:
    """First values out of at most ``HEAD`` rows: bounded, so gathered per column."""
    key = F.struct(*[ref(c).alias(f"_k{i}") for i, c in enumerate(order_by)])
    cells = [x for c in columns for x in (F.lit(c), ref(c).cast("string"))]
    long = (near.select(key.alias("_key"), F.stack(F.lit(len(columns)), *cells).alias("column", "value"))
            .where(F.col("value").isNotNull()))
    tops = long.groupBy("column").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("_key", "value"))), 1, k).alias("_t"))
    return (tops.select("column", F.posexplode("_t").alias("place", "_s"))
            .select("column", "place", F.col("_s.value").alias("value")))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def mail_like(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, mail_like) for text columns: mostly distinct values, and an @ in any of them."""
    columns = text_columns(df) if columns is None else columns
    seen = frequencies(df.select([ref(c) for c in columns]), columns).where(F.col("value").isNotNull())
    facts = seen.groupBy("column").agg((F.count(F.lit(1)) / F.sum("n")).alias("share"),
                                       F.max(F.contains("value", F.lit("@"))).alias("marked"))
    return facts.select("column", ((F.col("share") > MAIL_DISTINCT_SHARE) & F.col("marked")).alias("mail_like"))


def classify(df: DataFrame, contents: bool = True) -> DataFrame:
    """(position, column, category, excluded_from_modeling).

    With ``contents`` all values of still-unclassified text columns are tested for mail addresses.
    """
    table = columns_table(df)
    by_name = table.withColumn("category", class_of_name(F.col("column")))
    if contents:
        names = {r["column"] for r in by_name.where(F.col("category") == CLINICAL).select("column").collect()}
        open_columns = [c for c in text_columns(df) if c in names]
        if open_columns:
            mail = F.broadcast(mail_like(df, open_columns))
            hit = F.coalesce(F.col("mail_like"), F.lit(False))
            by_name = (table.join(mail, "column", "left")
                       .withColumn("category", class_of_name(F.col("column"), hit)))
    return by_name.select("position", "column", "category",
                          F.col("category").isin(DIRECT, LINKAGE).alias("excluded_from_modeling"))


def sensitive_columns(classes: DataFrame) -> DataFrame:
    return classes.where(F.col("category") == DIRECT).select("column")


def classes_of_schema(df: DataFrame) -> dict[str, str]:
    """Column name to class by name alone: metadata only, no pass over the rows."""
    return {r["column"]: r["category"] for r in
            columns_table(df).select("column", class_of_name(F.col("column")).alias("category")).collect()}


def logical_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "float"
    return "datetime" if is_moment(dtype) else "categorical"


def date_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share, unread): how many of all non-null texts read as dates, and the number that do not; one pass, a null share
    for a column without any."""
    reads = [F.when(ref(c).isNotNull(), moment_from_text(ref(c)).isNotNull().cast("double")) for c in columns]
    wide = df.agg(*[f.alias(f"{n}{i}") for i, x in enumerate(reads) for n, f in (("d", F.avg(x)), ("u", F.count(F.when(x == 0, 1))))])
    cells = [x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"d{i}"), F.col(f"u{i}"))]
    return wide.select(F.stack(F.lit(len(columns)), *cells).alias("column", "share", "unread"))


def infer_types(df: DataFrame) -> DataFrame:
    """(position, column, dtype); text whose values mostly read as dates counts as datetime."""
    texts = text_columns(df)
    if not texts:
        return columns_table(df)
    dates = F.broadcast(date_shares(df, texts))
    dtype = F.when(F.col("share") > TYPE_SHARE, "datetime").otherwise(F.col("dtype"))
    return columns_table(df).join(dates, "column", "left").select("position", "column", dtype.alias("dtype"))


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, dtype, kind): numerical, binary, ordinal or categorical."""
    types = infer_types(df).drop("position")
    others = [f.name for f in df.schema.fields if logical_type(f.dataType) not in ("integer", "float")]
    if not others:
        return types.select("column", "dtype", F.lit("numerical").alias("kind"))
    seen = frequencies(df, others).where(F.col("value").isNotNull())
    word = F.lower(F.trim("value"))
    per_column = seen.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"),
        *[F.min(word.isin(scale)).alias(f"scale{i}") for i, scale in enumerate(rules.ORDINAL_SCALES)])
    ordinal = F.greatest(*[F.col(f"scale{i}") for i in range(len(rules.ORDINAL_SCALES))])
    kind = (F.when(F.col("dtype").isin("integer", "float"), "numerical")
            .when(F.col("distinct") == 2, "binary").when(ordinal, "ordinal").otherwise("categorical"))
    return types.join(per_column, "column", "left").select("column", "dtype", kind.alias("kind"))


def model_types(kinds: DataFrame) -> DataFrame:
    """(column, model_type): how the generator models each column."""
    model = (F.when(F.col("dtype") == "boolean", "boolean").when(F.col("dtype") == "datetime", "datetime")
             .when(F.col("kind") == "numerical", "numerical").otherwise("categorical"))
    return kinds.select("column", model.alias("model_type"))


def approved_columns(columns: Sequence[str], wanted: Sequence[str], excluded: Sequence[str]) -> tuple[list[str], list[str]]:
    """(columns to keep, removed identifiers sorted); raises when nothing or something unknown is left."""
    kept = [c for c in wanted if c not in excluded]
    if not kept:
        raise ValueError("no approved column is left after identifiers are removed")
    unknown = sorted(set(kept) - set(columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return kept, sorted(set(wanted) & set(excluded))


def find_column(df: DataFrame, name: str | None) -> str | None:
    """Column by exact name, else by name without regard to case."""
    if name is None or name in df.columns:
        return name
    return {c.lower(): c for c in df.columns}.get(name.lower())


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column, status, left_type, right_type) with status common, missing or extra."""
    a = columns_table(left).select("column", F.col("dtype").alias("left_type"))
    b = columns_table(right).select("column", F.col("dtype").alias("right_type"))
    status = (F.when(F.col("right_type").isNull(), "missing").when(F.col("left_type").isNull(), "extra")
              .otherwise("common"))
    return a.join(b, "column", "full").select("column", status.alias("status"), "left_type", "right_type")


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]
