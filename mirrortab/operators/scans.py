"""Running values over an order of any length, by cells of cells.

An order is cut into cells of about even numbers of rows, each of those again where there are more cells than one level can
hold, and so on: a cell is a number whose highest bits are its place on the first level. What a cell needs from the cells before
it is scanned inside the cells of one parent, then among the parents, and so on up. No task sees more than the rows of a cell or
the cells of a parent, and no number of cells is a limit.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from mirrortab.functions.values import doubles
from mirrortab.operators.ordering import ROWS_PER_BUCKET, add_bucket, bucket_bounds, bucket_of, cut_lineage

LEAST_CELLS = 64
MOST_BITS = 10


@dataclass(frozen=True)
class Levels:
    """``levels`` levels of 2^``bits`` cells in each parent."""

    bits: int
    levels: int

    @classmethod
    def for_rows(cls, rows: int, rows_per_cell: int = ROWS_PER_BUCKET, most_bits: int = MOST_BITS, least: int = LEAST_CELLS) -> Levels:
        """As few levels as give cells of at most ``rows_per_cell`` rows, of even width."""
        need = max(1, (max(least, -(-rows // rows_per_cell)) - 1).bit_length())
        levels = -(-need // most_bits)
        return cls(-(-need // levels), levels)

    @property
    def fan(self) -> int:
        return 1 << self.bits


def with_cells(df: DataFrame, value: Column, name: str, levels: Levels) -> DataFrame:
    """Add the cell of each row, a long that rises with ``value``, a double. Equal values share a cell; nulls are in the first one.

    A level takes one aggregation of the values and, below the first, a join with one row per cell of the level above.
    """
    bounds = df.agg(bucket_bounds(value, levels.fan).alias("b")).first()["b"]
    padded = [*sorted(set(bounds or [])), *[float("inf")] * levels.fan][:levels.fan - 1]
    out = add_bucket(df.withColumn(f"{name}_at", value), F.col(f"{name}_at"), doubles(padded), name, levels.fan).withColumn(name, F.col(name).cast("bigint"))
    return refined(out, f"{name}_at", name, levels).drop(f"{name}_at")


def refined(df: DataFrame, value: str, cell: str, levels: Levels) -> DataFrame:
    """Cut the cells of the first level, a long, again for every level below it; each takes bounds from the values in its cells."""
    out = df
    for _ in range(levels.levels - 1):
        inner = out.groupBy(cell).agg(F.array_distinct(bucket_bounds(F.col(value), levels.fan)).alias("_bounds"))
        full = F.slice(F.concat("_bounds", F.array_repeat(F.lit(float("inf")), levels.fan)), 1, levels.fan - 1)
        met = out.join(inner.select(cell, F.when(F.col("_bounds").isNotNull(), full).alias("_bounds")), cell)
        out = met.withColumn(cell, F.shiftleft(cell, levels.bits) + bucket_of(F.col(value), F.col("_bounds"), F.lit(0), levels.fan)).drop("_bounds")
    return out


def _before(kind: str, c: str, parent: Column, cell: str) -> Column:
    if kind == "total":
        return F.sum(c).over(Window.partitionBy(parent))
    order = F.desc(cell) if kind == "next" else F.asc(cell)
    earlier = Window.partitionBy(parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(earlier), F.lit(0)) if kind == "sum" else F.last(c, ignorenulls=True).over(earlier)


def _whole(kind: str, c: str, cell: str) -> Column:
    known = F.when(F.col(c).isNotNull(), F.col(cell))
    return F.sum(c) if kind in ("sum", "total") else F.max_by(c, known) if kind == "last" else F.min_by(c, known)


def carried(ends: DataFrame, cell: str, kinds: Mapping[str, str], levels: Levels) -> DataFrame:
    """(cell, and each column of ``kinds``): what the cells before a cell hold, from one row per cell.

    Kinds: ``last``, the last known value before; ``next``, the first known value behind; ``sum``, the sum before; ``total``, the sum
    of all. Higher bits than the first level's may tell separate orders apart, which share nothing.
    """
    ends = ends.select(cell, *kinds)
    return _carried(ends if levels.levels == 1 else cut_lineage(ends), cell, kinds, levels, levels.levels)


def _carried(ends: DataFrame, cell: str, kinds: Mapping[str, str], levels: Levels, depth: int) -> DataFrame:
    parent = F.shiftright(cell, levels.bits)
    here = ends.select(cell, *[_before(kind, c, parent, cell).alias(c) for c, kind in kinds.items()])
    if depth == 1:
        return here
    tops = ends.groupBy(parent.alias("_parent")).agg(*[_whole(kind, c, cell).alias(c) for c, kind in kinds.items()])
    above = _carried(tops.withColumnRenamed("_parent", cell), cell, kinds, levels, depth - 1) \
        .select(F.col(cell).alias("_parent"), *[F.col(c).alias(f"_above_{c}") for c in kinds])
    joined = {"sum": lambda c: F.col(c) + F.col(f"_above_{c}"), "total": lambda c: F.col(f"_above_{c}")}
    return here.withColumn("_parent", parent).join(above, "_parent").select(
        cell, *[joined.get(kind, lambda c: F.coalesce(F.col(c), F.col(f"_above_{c}")))(c).alias(c) for c, kind in kinds.items()])
