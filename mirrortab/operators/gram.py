"""Pairwise moments of many columns in one scan, by matrix products over blocks of rows.

A task turns each Arrow batch into a matrix and a mask of known cells. Counts, means, squared deviations and products of all pairs of columns,
each over the rows where both are known, are four matrix products, taken around the means of the batch. Moments of two sets of rows merge
exactly in form (counts add, the difference of the means enters the deviations), so nothing is cancelled away,
whatever the size of the numbers. Tasks send one row per column; the rows of a column meet in one task, which merges
them as they come.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mirrortab.operators.package import ship

#: Numbers that a task holds of all pairs; tables with more pairs are scanned once per block of columns that stays below.
HELD_NUMBERS = 12_000_000
#: What is known of a pair (i, j): rows with both, means of i and of j there, squared deviations of i and of j, products of deviations.
MOMENTS = ("n", "mx", "my", "sx", "sy", "c")
#: A share of the squares, and of the mean, below which a deviation is rounding.
ROUNDING = 1e-12
SCHEMA = "side int, i int, " + ", ".join(f"{m} array<double>" for m in MOMENTS)


def column_blocks(columns: int, held: int = HELD_NUMBERS) -> list[tuple[int, int]]:
    """(first, end) of the blocks of columns that are each paired with all columns in one scan."""
    step = max(1, held // max(1, len(MOMENTS) * columns))
    return [(a, min(a + step, columns)) for a in range(0, columns, step)]


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments (first axis) of the rows of both."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    both = a[0] * share
    return np.array([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both])


def _moments(x: np.ndarray, first: int, end: int) -> np.ndarray:
    """Moments of columns ``first`` to ``end`` with all columns; missing cells are NaN."""
    known = ~np.isnan(x)
    m = known.astype(float)
    counts = m.sum(axis=0)
    # A column without a known cell keeps 0 as its mean; pairs with it have no rows and count for nothing when merging.
    centre = np.divide(np.where(known, x, 0.0).sum(axis=0), counts, out=np.zeros(x.shape[1]), where=counts > 0)
    low = np.where(known, x, np.inf).min(axis=0)
    centre = np.where(low == np.where(known, x, -np.inf).max(axis=0), low, centre)
    z = np.where(known, x - centre, 0.0)
    a, ma, rows = z[:, first:end], m[:, first:end], slice(first, end)
    n = ma.T @ m
    sum_x, sum_y = a.T @ m, ma.T @ z
    per = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    ex, ey = sum_x * per, sum_y * per
    return np.array([n, centre[rows, None] + ex, centre[None, :] + ey, _less((a * a).T @ m, sum_x * ex), _less(ma.T @ (z * z), sum_y * ey), a.T @ z - sum_x * ey])


def _less(squares: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The difference, 0 where it is rounding only."""
    return np.where(squares - mean <= ROUNDING * squares, 0.0, squares - mean)


def pair_moments(df: DataFrame, columns: Sequence[Column], side: Column | None = None, held: int = HELD_NUMBERS) -> DataFrame:
    """(side, i, n, mx, my, sx, sy, c): for each column i the moments with every column j, as arrays over j.

    NaN and null cells are missing. One scan as long as the moments of all pairs fit into ``held`` numbers.
    """
    size = len(columns)
    body = df.select((F.lit(0) if side is None else side).cast("int").alias("side"),
                     F.array(*[c.cast("double") for c in columns]).alias("x"))
    ship(df.sparkSession)

    def local(first: int, end: int):
        def run(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("x").flatten().fill_null(np.nan)).astype(float).reshape(batch.num_rows, size)
                sides = np.asarray(batch.column("side"))
                with np.errstate(invalid="ignore", over="ignore"):
                    for s in np.unique(sides).tolist():
                        found = _moments(x[sides == s], first, end)
                        held[s] = _merged(held[s], found) if s in held else found
            for s, m in held.items():
                yield _rows([(s, first + k, m[:, k]) for k in range(end - first)])
        return run

    def together(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.asarray(batch.column(m).flatten()).reshape(batch.num_rows, size) for m in MOMENTS]
            with np.errstate(invalid="ignore", over="ignore"):
                for k, key in enumerate(zip(batch.column("side").to_pylist(), batch.column("i").to_pylist())):
                    found = np.array([p[k] for p in parts])
                    held[key] = _merged(held[key], found) if key in held else found
        yield _rows([(*key, m) for key, m in held.items()])

    out = None
    for first, end in column_blocks(size, held):
        part = body.mapInArrow(local(first, end), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.repartition("side", "i").mapInArrow(together, SCHEMA)


def _rows(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    size = found[0][2].shape[1] if found else 0
    cuts = pa.array(np.arange(len(found) + 1, dtype=np.int32) * size)
    arrays = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([m[k] for *_, m in found]) if found else np.zeros(0))) for k in range(len(MOMENTS))]
    return pa.RecordBatch.from_arrays([pa.array([s for s, *_ in found], pa.int32()), pa.array([i for _, i, _ in found], pa.int32()), *arrays],
                                      names=["side", "i", *MOMENTS])


def pair_correlations(moments: DataFrame) -> DataFrame:
    """(side, i, j, r) of the pairs i < j; r is null where a column is constant, or the pair has fewer than two rows."""
    def spread(m: Column, squares: str, mean: str) -> Column:
        least = m["n"] * F.pow(m[mean] * F.lit(ROUNDING), F.lit(2.0))
        return F.when((m[squares] > least) | F.isnan(m[squares]), F.sqrt(m[squares]))

    pairs = moments.select("side", "i", F.inline(F.transform(F.arrays_zip(*MOMENTS), lambda m, j: F.struct(
        j.alias("j"), m["n"].alias("n"), F.try_divide(m["c"], spread(m, "sx", "mx") * spread(m, "sy", "my")).alias("r")))))
    return pairs.where("i < j").select("side", "i", "j", F.when(F.col("n") >= 2, F.col("r")).alias("r"))


def raw_correlation(moments: DataFrame, size: int) -> np.ndarray:
    """Matrix of sum(x y) / sqrt(sum(x x) sum(y y)), as for numbers that are centred already; 0 where undefined, 1 on the diagonal.

    The driver gets one row per column.
    """
    matrix = np.eye(size)
    for r in moments.collect():
        n, mx, my, sx, sy, c = (np.array(r[m], float) for m in MOMENTS)
        scale = np.sqrt((sx + n * mx * mx) * (sy + n * my * my))
        row = np.clip(np.divide(c + n * mx * my, scale, out=np.zeros(size), where=scale > 0), -1, 1)
        row[r["i"]] = 1.0
        matrix[r["i"]] = row
    return (matrix + matrix.T) / 2
