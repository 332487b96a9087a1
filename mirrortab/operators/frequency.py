"""Long frequency tables, and what follows from them: distinct counts, modes, exact quantiles, ECDFs.

Every per-column statistic starts from (column, value, count). The first aggregation combines on
the map side, so a value that fills a third of the table costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mirrortab.functions.values import as_number, doubles, missing_to_null
from mirrortab.operators.ordering import BUCKETS, bucket_bounds, bucket_of, cut_lineage
from mirrortab.operators.scans import Levels, carried, refined


def _stacked(df: DataFrame, values: Mapping[str, Column], extra: Sequence[Column] = ()) -> DataFrame:
    """One row per cell: (column, value, extra...)."""
    cells = [c for name, value in values.items() for c in (F.lit(name), value)]
    return df.select(F.stack(F.lit(len(values)), *cells).alias("column", "value"), *extra)


def number_cells(df: DataFrame, columns: Sequence[str], *extra: Column) -> DataFrame:
    cells = _stacked(df, {c: as_number(df, c) for c in columns}, extra)
    return cells.where(F.col("value").isNotNull())


def text_cells(df: DataFrame, columns: Sequence[str], *extra: Column) -> DataFrame:
    return _stacked(df, {c: missing_to_null(df, c).cast("string") for c in columns}, extra)


def frequencies(df: DataFrame, columns: Sequence[str], numeric: bool = False) -> DataFrame:
    """(column, value, n) of one table; null is a value unless ``numeric``."""
    cells = number_cells(df, columns) if numeric else text_cells(df, columns)
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def counts_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, total, missing_count, unique_count), exact.

    Each column is grouped by itself, on its own type, and the results are united. A columnar table is
    still read once in all, a value that fills the column collapses before the shuffle, and no row is
    blown up into one row per cell.
    """
    out = None
    for c in columns:
        seen = df.select(missing_to_null(df, c).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        part = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
                        F.count("value").alias("unique_count")).select(F.lit(c).alias("column"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def pair_frequencies(source: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                     numeric: bool = False) -> DataFrame:
    """(column, value, n_source, n_synth) of two tables in one shuffle."""
    cells = number_cells if numeric else text_cells
    both = (cells(source, columns, F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(cells(synthetic, columns, F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return both.groupBy("column", "value").agg(F.sum("a").alias("n_source"), F.sum("b").alias("n_synth"))


def value_bounds(tables: Sequence[DataFrame], columns: Sequence[str]) -> tuple[dict[str, list[float]], int]:
    """(up to 1,023 rising numbers per column that cut its distinct values into about even buckets, rows of all tables).

    One pass. Only values whose hash falls in one cell of 64 are looked at: a column with few distinct
    values may give none and then stays in one bucket, which is small.
    """
    names = [f"x{i}" for i in range(len(columns))]
    picked = None
    for df in tables:
        part = df.select([as_number(df, c).alias(n) for c, n in zip(columns, names)])
        picked = part if picked is None else picked.unionByName(part)
    row = picked.agg(*[bucket_bounds(F.when(F.pmod(F.xxhash64(n), F.lit(64)) == 0, F.col(n))).alias(n)
                       for n in names], F.count(F.lit(1)).alias("rows")).first()
    return {c: sorted(set(row[n] or [])) for c, n in zip(columns, names)}, row["rows"]


def ranked_values(tables: Mapping[str, DataFrame], columns: Sequence[str], levels: Levels | None = None) -> DataFrame:
    """One row per distinct (column, value), with for each table, by its name n:

    ``n`` how often it occurs, ``n_upto`` how many values are not above it, ``n_total`` how many values
    the column has, ``n_sum`` their sum. The running count is taken inside a bucket of values and shifted
    by what the earlier buckets hold, so a column spreads over many tasks. Buckets follow the rows: up to 1,024 a column
    on one level, whose sums are broadcast, and buckets of buckets beyond that (:mod:`scans`).
    """
    bounds, rows = value_bounds(list(tables.values()), columns)
    levels = levels or Levels.for_rows(rows, least=BUCKETS)
    every = BUCKETS // levels.fan
    bounds = {c: found[every - 1::every] for c, found in bounds.items()}
    both = None
    for name, df in tables.items():
        cells = [x for i, c in enumerate(columns) for x in (F.lit(i), as_number(df, c))]
        part = (df.select(F.stack(F.lit(len(columns)), *cells).alias("at", "value"),
                          *[F.lit(1 if n == name else 0).alias(n) for n in tables])
                .where(F.col("value").isNotNull()))
        both = part if both is None else both.unionByName(part)
    counted = both.groupBy("at", "value").agg(*[F.sum(n).alias(n) for n in tables])
    # One number for (column, bucket): short keys to shuffle, and a sort that its prefix decides.
    cuts = levels.fan - 1
    limits = [b for c in columns for b in [*bounds[c], *[float("inf")] * cuts][:cuts]]
    cell = F.shiftleft(F.col("at").cast("bigint"), levels.bits) + bucket_of(F.col("value"), doubles(limits), F.col("at") * cuts, levels.fan)
    freq = counted.select(cell.alias("cell"), "value", *tables)
    if levels.levels > 1:
        freq = cut_lineage(refined(cut_lineage(freq), "value", "cell", levels))
    here = [x for n in tables for x in (F.sum(n).alias(f"{n}_before"), F.sum(n).alias(f"{n}_total"), F.sum(F.col("value") * F.col(n)).alias(f"{n}_sum"))]
    kinds = {f"{n}_{k}": kind for n in tables for k, kind in (("before", "sum"), ("total", "total"), ("sum", "total"))}
    name_of = F.element_at(F.array(*[F.lit(c) for c in columns]), F.shiftright("cell", levels.bits * levels.levels).cast("int") + 1)
    shift = carried(freq.groupBy("cell").agg(*here), "cell", kinds, levels).withColumn("column", name_of)
    inside = Window.partitionBy("cell").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = freq.select("*", *[F.sum(n).over(inside).alias(f"{n}_within") for n in tables])
    # A left join, although every cell is there: an inner one would test the cell for null on every raw
    # row, and the two uses of ``freq`` would no longer share one shuffle.
    return upto.join(F.broadcast(shift) if levels.levels == 1 else shift, "cell", "left").select(
        "column", "value", *tables, *[(F.col(f"{n}_within") + F.col(f"{n}_before")).alias(f"{n}_upto") for n in tables],
        *[f"{n}_total" for n in tables], *[f"{n}_sum" for n in tables])


def quantile_of(share: float, count: str, value: str = "value") -> Column:
    """Aggregate for the linearly interpolated quantile, over rows of :func:`ranked_values`."""
    upto, total = F.col(f"{count}_upto"), F.col(f"{count}_total")
    place = (total - 1) * F.lit(float(share))
    low = F.min(F.when((F.col(count) > 0) & (upto > F.floor(place)), F.col(value)))
    high = F.min(F.when((F.col(count) > 0) & (upto > F.ceil(place)), F.col(value)))
    part = F.max(place - F.floor(place))
    return low + (high - low) * part


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, share, value), exact, without holding a column in one task."""
    ranked = ranked_values({"n": df}, columns)
    wide = ranked.groupBy("column").agg(
        F.array(*[F.struct(F.lit(float(s)).alias("share"), quantile_of(s, "n").alias("value"))
                  for s in shares]).alias("q"))
    return wide.select("column", F.inline("q"))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; one number each comes to the driver."""
    if not columns:
        return {}
    return {r["column"]: r["value"] for r in exact_quantiles(df, columns, [0.5]).collect()}


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the most frequent non-null text, smallest first among ties."""
    seen = frequencies(df, columns).where(F.col("value").isNotNull())
    return seen.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
