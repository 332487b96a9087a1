"""Nearest source rows of synthetic ones over whole tables, by grids of growing cells.

Equal points are one point with a count, and are settled by an equi-join. The rest is looked up within a radius that begins where cells
hold few source points and grows to the threshold; what has a source point within a radius has its nearest one there and is done. So a
dense region is settled in small cells, and large cells are only searched for points that have nothing close.

A cell has twice the radius as its side in up to ``GRID_DIMENSIONS`` of the dimensions, those with most occupied cells. Everything within
the radius of a point lies in its own cell or in the next one on the nearer side, so a point is copied twice per grid dimension, and
the join is one by equality. Dimensions whose different values are further apart than the threshold join the key as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mirrortab.operators.ordering import cut_lineage, skew_join

GRID_DIMENSIONS = 3
#: Source points that a cell of the first radius holds on average, at most.
POINTS_PER_CELL = 64
#: The first radius is the threshold over two to this power at least.
HALVINGS = 8
#: A radius is this many times the one before.
GROWTH = 4.0
#: Cells are wider than twice the radius by this share, so that rounding puts nothing into a cell that is not searched.
MARGIN = 1e-9


def apart(a: str, b: str) -> Column:
    """Euclidean distance of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def _cell(x: Column, side: float) -> Column:
    return F.floor(x / F.lit(side)).cast("double")


def _key(same: Sequence[Column], cells: Sequence[Column]) -> Column:
    return F.xxhash64(*(same or [F.lit(0)]), *cells)


def _grid(source: DataFrame, free: Sequence[int], radius: float) -> list[int]:
    """The free dimensions with most occupied cells."""
    if not free:
        return []
    side = 2 * radius
    spread = source.agg(*[F.approx_count_distinct(_cell(F.col("features")[i], side)).alias(f"d{i}") for i in free]).first()
    return [i for i in sorted(free, key=lambda i: (-spread[f"d{i}"], i)) if spread[f"d{i}"] > 1][:GRID_DIMENSIONS]


def _radii(source: DataFrame, same: Sequence[int], grid: Sequence[int], threshold: float) -> list[float]:
    """Rising radii, from one with few source points a cell to the threshold; one pass for all candidates."""
    f = F.col("features")
    counts = [F.approx_count_distinct(_key([f[i] for i in same], [_cell(f[i], 2 * threshold / 2**j) for i in grid])).alias(f"c{j}")
              for j in range(HALVINGS + 1)]
    row = source.agg(F.count(F.lit(1)).alias("points"), *counts).first()
    first = next((j for j in range(HALVINGS + 1) if row["points"] <= POINTS_PER_CELL * row[f"c{j}"]), HALVINGS) if grid else 0
    radii = [threshold / 2**first]
    while radii[-1] < threshold:
        radii.append(min(threshold, radii[-1] * GROWTH))
    return radii


def _within(points: DataFrame, source: DataFrame, radius: float, same: Sequence[int], grid: Sequence[int]) -> DataFrame:
    """(features, rows, nearest, distance) of the points with a source point nearer than ``radius``."""
    side = 2 * radius * (1 + MARGIN)
    f = F.col("features")
    there = source.select(_key([f[i] for i in same], [_cell(f[i], side) for i in grid]).alias("cell"), f.alias("theirs"), "nearest")
    here = points
    for i in grid:
        low = _cell(f[i], side)
        other = F.when(f[i] - low * side < side / 2, low - 1).otherwise(low + 1)
        here = here.select("*", F.explode(F.array(low, other)).alias(f"_c{i}"))
    here = here.select(_key([f[i] for i in same], [F.col(f"_c{i}") for i in grid]).alias("cell"), "features", "rows")
    met = skew_join(here, there, "cell", F.xxhash64("features"), rows=points.count() * 2 ** len(grid)).withColumn("distance", apart("features", "theirs"))
    best = met.where(F.col("distance") < radius).groupBy("features", "rows").agg(F.min(F.struct("distance", "nearest")).alias("best"))
    return best.select("features", "rows", F.col("best.nearest").alias("nearest"), F.col("best.distance").alias("distance"))


def near_points(encoded: DataFrame, threshold: float, steps: Sequence[float | None] = ()) -> DataFrame:
    """(features, rows, nearest, distance): the distinct synthetic points with a source row nearer than ``threshold``.

    ``encoded`` has (side, idx, features), side 0 the source. rows counts the synthetic rows at the point, nearest is the idx of the nearest source
    row, the smallest of several. ``steps`` gives, where known, the smallest gap between different values of a dimension. No
    pair below the threshold is left out. Every point is compared with the source points of eight cells at most; only where many synthetic
    points lie just beside a dense cluster of source points, and none of them in it, do pairs grow faster than rows.
    """
    source = cut_lineage(encoded.where("side = 0").groupBy("features").agg(F.min("idx").alias("nearest")))
    points = cut_lineage(encoded.where("side = 1").groupBy("features").agg(F.count(F.lit(1)).alias("rows")))
    found = points.join(source, "features").select("features", "rows", "nearest", F.lit(0.0).alias("distance"))
    size = len((source.select("features").first() or [[]])[0])
    if not size or threshold <= 0:
        return found.where(F.lit(threshold > 0))
    known = [steps[i] if i < len(steps) else None for i in range(size)]
    same = [i for i in range(size) if known[i] is not None and known[i] >= threshold]
    grid = _grid(source, [i for i in range(size) if i not in same], threshold)
    rest = points.join(source, "features", "left_anti")
    for radius in _radii(source, same, grid, threshold):
        rest = cut_lineage(rest)
        here = _within(rest, source, radius, same, grid)
        if radius < threshold:
            here = cut_lineage(here)
            rest = rest.join(here, "features", "left_anti")
        found = found.unionByName(here)
    return found


def near_rows(encoded: DataFrame, points: DataFrame) -> DataFrame:
    """(synth_idx, nearest_source_idx, distance) of the synthetic rows at the points of :func:`near_points`."""
    rows = encoded.where("side = 1").select(F.col("idx").alias("synth_idx"), "features")
    met = skew_join(rows, points.select("features", "nearest", "distance"), "features", F.col("synth_idx"))
    return met.select("synth_idx", F.col("nearest").alias("nearest_source_idx"), "distance")
