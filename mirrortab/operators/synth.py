"""A Gaussian copula fitted and sampled with DataFrames.

Fitting is three aggregations: marginals, category frequencies, correlations of normal scores. What they
return is small and bounded (a grid per numeric column, at most ``MAX_CATEGORIES`` shares per text column,
one correlation matrix). Sampling is one map over ``spark.range``: row i depends on i alone. The shares of a text
column with more values than that stay a table: source rows meet their share, and sampled shares their value, by a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mirrortab.functions.draws import hash_index, normal, uniform
from mirrortab.functions.maths import normal_cdf, normal_quantile
from mirrortab.functions.values import as_number, doubles, is_number, missing_to_null, ref, type_of
from mirrortab.operators.frequency import exact_quantiles, frequencies
from mirrortab.operators.gram import pair_moments, raw_correlation
from mirrortab.operators.ordering import add_bucket, cut_lineage, dense_index

GRID = 256
MAX_CATEGORIES = 1000
MAX_LABEL_BYTES = 1_000_000
MAX_DECIMALS = 12
MODELS = ("gaussian_copula", "independent", "bootstrap")
DEFAULT_MODEL = "gaussian_copula"
# Smallest and largest request, rows needed to fit, pool sizing.
MIN_ROWS_OUT = 100
MIN_ROWS_IN = 50
POOL_FACTOR = 3
EDGE = 1e-6
#: Smallest eigenvalue of a correlation matrix that is used.
LEAST_EIGENVALUE = 1e-8


def pool_size(n, factor: int = POOL_FACTOR):
    """Rows to draw from for ``n`` rows in requested proportions; pools are never written, so their size costs little."""
    return factor * n


@dataclass
class Marginal:
    """One column of the model. ``kind`` is number, label (shares in ``upto``) or table (shares in ``shares``)."""

    name: str
    dtype: T.DataType
    kind: str
    null_share: float = 0.0
    grid: list[float] = field(default_factory=list)
    decimals: int | None = None
    labels: list[str] = field(default_factory=list)
    upto: list[float] = field(default_factory=list)
    shares: DataFrame | None = None
    size: int = 0


@dataclass
class Model:
    """What :func:`fit` learns; ``used`` says which model the data allowed."""

    used: str
    marginals: list[Marginal]
    mixing: np.ndarray
    source: DataFrame
    seed: int = 42

    @property
    def columns(self) -> list[str]:
        return [m.name for m in self.marginals]


def copula_marginals(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, share, value): exact quantiles of the numeric columns on a grid."""
    return exact_quantiles(df, columns, shares)


def _modelled(df: DataFrame, name: str) -> bool:
    return is_number(type_of(df, name))


def decimals_of(x: Column) -> Column:
    """How many decimals a number has, one more than ``MAX_DECIMALS`` for any more than that."""
    ladder = None
    for d in range(MAX_DECIMALS + 1):
        scaled = x * float(10 ** d)
        fits = F.abs(scaled - F.rint(scaled)) <= F.greatest(F.lit(1.0), F.abs(scaled)) * 1e-12
        ladder = F.when(fits, d) if ladder is None else ladder.when(fits, d)
    return F.when(x.isNotNull(), ladder.otherwise(MAX_DECIMALS + 1))


def fit_marginals(df: DataFrame) -> tuple[list[Marginal], int]:
    numbers = [c for c in df.columns if _modelled(df, c)]
    texts = [c for c in df.columns if c not in numbers]
    shares = doubles([i / GRID for i in range(GRID + 1)])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(missing_to_null(df, c)).alias(f"n{i}"))
        if c in numbers:
            x = as_number(df, c)
            aggs.append(F.percentile_approx(x, shares, F.lit(10 * GRID)).alias(f"q{i}"))
            aggs.append(F.max(decimals_of(x)).alias(f"d{i}"))
    row = df.agg(*aggs).first()
    rows = row["rows"]
    labels, tables = _label_shares(df, texts)
    out = []
    for i, c in enumerate(df.columns):
        missing = 1.0 - row[f"n{i}"] / rows if rows else 0.0
        if c in numbers:
            places = row[f"d{i}"]
            out.append(Marginal(c, type_of(df, c), "number", missing, list(row[f"q{i}"] or []),
                                places if places is not None and places <= MAX_DECIMALS else None))
        elif c in labels:
            names, counts = zip(*labels[c]) if labels[c] else ((), ())
            upto = list(np.cumsum(counts) / max(1, sum(counts)))
            out.append(Marginal(c, type_of(df, c), "label", missing, labels=list(names), upto=upto))
        else:
            out.append(Marginal(c, type_of(df, c), "table", missing, shares=tables[c][0], size=tables[c][1]))
    return out, rows


def _label_shares(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, list[tuple[str, int]]], dict[str, tuple[DataFrame, int]]]:
    """Sorted (label, count) of the columns with at most ``MAX_CATEGORIES`` labels and ``MAX_LABEL_BYTES`` in all;
    for the others the table of :func:`share_table` and its rows."""
    if not columns:
        return {}, {}
    seen = cut_lineage(frequencies(df, columns))
    sizes = {r["column"]: r for r in seen.groupBy("column").agg(
        F.count("value").alias("k"), F.sum(F.octet_length("value")).alias("bytes")).collect()}
    few = [c for c in columns if c not in sizes
           or (sizes[c]["k"] <= MAX_CATEGORIES and (sizes[c]["bytes"] or 0) <= MAX_LABEL_BYTES)]
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in few}
    for r in seen.where(F.col("column").isin(few) & F.col("value").isNotNull()).orderBy("column", "value").collect():
        out[r["column"]].append((r["value"], r["n"]))
    known = seen.where(F.col("value").isNotNull())
    return out, {c: (share_table(known.where(F.col("column") == c)), sizes[c]["k"]) for c in columns if c not in few}


def share_table(seen: DataFrame) -> DataFrame:
    """(value, lower, upper) of (value, n): the values in order cut [0, 1) into intervals as wide as their shares.

    A range-partitioned sort, running counts within each partition, and one offset per partition.
    """
    ordered = cut_lineage(seen.select("value", "n").orderBy("value").withColumn("_place", F.monotonically_increasing_id())
                          .withColumn("_part", F.shiftrightunsigned("_place", 33)))
    parts = ordered.groupBy("_part").agg(F.sum("n").alias("_n"))
    offsets = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    total = parts.agg(F.sum("_n")).first()[0]
    run = F.sum("n").over(Window.partitionBy("_part").orderBy("_place")) + F.col("_before")
    placed = ordered.join(F.broadcast(offsets), "_part").withColumn("_run", run)
    return cut_lineage(placed.select("value", ((F.col("_run") - F.col("n")) / total).alias("lower"), (F.col("_run") / total).alias("upper")))


def _value_at(rows: DataFrame, m: Marginal, share: str, name: str) -> DataFrame:
    """Add the value whose interval holds the share: an equi-join on as many even cells as there are values."""
    cells = m.size
    near = m.shares.select(F.col("value").alias(name), F.col("lower").alias("_low"), F.col("upper").alias("_high"), F.explode(F.sequence(
        F.floor(F.col("lower") * cells), F.least(F.floor(F.col("upper") * cells), F.lit(cells - 1).cast("bigint")))).alias("_cell"))
    at = F.least(F.col(share), F.lit(1 - 1e-12))
    placed = rows.withColumn("_at", at).withColumn("_cell", F.floor(F.col("_at") * cells))
    return (placed.join(near, "_cell").where((F.col("_low") <= F.col("_at")) & (F.col("_at") < F.col("_high")))
            .drop("_cell", "_at", "_low", "_high"))


def _padded(bounds: Sequence[float], fill: float) -> tuple[Column, int]:
    """Bounds as a literal array whose length suits :func:`add_bucket`."""
    size = 1
    while size - 1 < len(bounds):
        size *= 2
    size = max(size, 2)
    return doubles([*bounds, *[fill] * (size - 1 - len(bounds))]), size


def normal_scores(df: DataFrame, marginals: Sequence[Marginal]) -> DataFrame:
    """One column of normal scores per modelled column; ties share the middle of their interval."""
    numbers = [(i, m) for i, m in enumerate(marginals) if m.kind == "number" and len(set(m.grid)) > 1]
    labels = [(i, m) for i, m in enumerate(marginals) if m.kind == "label" and m.labels]
    tables = [(i, m) for i, m in enumerate(marginals) if m.kind == "table"]
    out = df.select([as_number(df, m.name).alias(f"x{i}") for i, m in numbers]
                    + [ref(m.name).cast("string").alias(f"x{i}") for i, m in [*labels, *tables]])
    for i, m in tables:
        middles = m.shares.select(F.col("value").alias(f"x{i}"), ((F.col("lower") + F.col("upper")) / 2).alias(f"m{i}"))
        out = out.join(middles, f"x{i}", "left")
    if numbers:
        points = {i: sorted(set(m.grid)) for i, m in numbers}
        out = Bucketizer(splitsArray=[[float("-inf"), *points[i], float("inf")] for i, _ in numbers],
                         inputCols=[f"x{i}" for i, _ in numbers], outputCols=[f"b{i}" for i, _ in numbers],
                         handleInvalid="keep").transform(out)
    shares = []
    for i, m in numbers:
        known, x = points[i], F.col(f"x{i}")
        upto = np.searchsorted(m.grid, known, side="right")
        before = np.searchsorted(m.grid, known, side="left")
        # Bucket b holds known[b-1] <= x < known[b]; the grid point itself covers [before, upto).
        b = F.greatest(F.lit(1), F.least(F.col(f"b{i}").cast("int"), F.lit(len(known)))) - 1
        at, first, last = doubles(known)[b], doubles(before)[b], doubles(upto)[b]
        above = doubles([*known[1:], known[-1]])[b]
        tied = (first + last - 1) / (2.0 * GRID)
        between = (last - 1 + F.coalesce(F.try_divide(x - at, above - at), F.lit(0.0))) / float(GRID)
        shares.append(F.when(x.isNotNull(), F.when(x <= at, tied).otherwise(between)).alias(f"u{i}"))
    for i, m in labels:
        middles = [(a + b) / 2 for a, b in zip([0.0, *m.upto[:-1]], m.upto)]
        table = F.create_map(*[z for name, u in zip(m.labels, middles) for z in (F.lit(name), F.lit(float(u)))])
        shares.append(F.try_element_at(table, F.col(f"x{i}")).alias(f"u{i}"))
    shares += [F.col(f"m{i}").alias(f"u{i}") for i, _ in tables]
    out = out.select(*shares)
    # greatest and least skip nulls, so a missing value is kept missing by hand.
    inner = out.select([F.when(F.col(c).isNotNull(), F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col(c)))).alias(c)
                        for c in out.columns])
    return inner.select([normal_quantile(F.col(c)).alias(f"z{c[1:]}") for c in inner.columns])


def score_correlation(scores: DataFrame, size: int) -> np.ndarray:
    """Correlation matrix of the normal scores from one scan; 0 where undefined. Scores are centred and scaled already."""
    places = [int(c[1:]) for c in scores.columns]
    matrix = np.eye(size)
    if len(places) > 1:
        found = raw_correlation(pair_moments(scores, [F.col(c) for c in scores.columns]), len(places))
        matrix[np.ix_(places, places)] = found
    return matrix


def nearest_correlation(matrix: np.ndarray, floor: float = LEAST_EIGENVALUE) -> np.ndarray:
    """The matrix itself where it is positive definite, else the one with its negative eigenvalues raised to ``floor`` and the diagonal scaled back to 1.

    Correlations that are taken pair by pair over different rows need not fit together.
    """
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    if values[0] >= floor:
        return matrix
    raised = (vectors * np.maximum(values, floor)) @ vectors.T
    scale = np.sqrt(np.diag(raised))
    return raised / np.outer(scale, scale)


def mixing_matrix(correlation: np.ndarray) -> np.ndarray | None:
    """Cholesky factor of the nearest correlation matrix; None where the matrix holds numbers that are not finite."""
    if not np.isfinite(correlation).all():
        return None
    return np.linalg.cholesky(nearest_correlation(correlation))


def fit(df: DataFrame, model: str = DEFAULT_MODEL, seed: int = 42) -> Model:
    """Fit the named model; falls back to independent columns, then to drawn source rows."""
    model = model.lower() if model.lower() in MODELS else DEFAULT_MODEL
    marginals, rows = fit_marginals(df)
    size = len(marginals)
    if rows == 0 or size == 0:
        raise ValueError("nothing to fit")
    if model == "bootstrap":
        return Model("bootstrap", marginals, np.eye(size), df, seed)
    mixing = np.eye(size)
    if model == "gaussian_copula":
        found = mixing_matrix(score_correlation(normal_scores(df, marginals), size))
        model, mixing = ("independent", mixing) if found is None else (model, found)
    return Model(model, marginals, mixing, df, seed)


def _value_of(m: Marginal, u: Column) -> Column | None:
    """Inverse marginal of a numeric column at ``u``."""
    if not m.grid:
        return None
    grid = doubles(m.grid)
    at = F.least(F.floor(u * GRID).cast("int"), F.lit(GRID - 1))
    left, right = grid[at], grid[at + 1]
    value = left + (right - left) * (u * GRID - at)
    if isinstance(m.dtype, T.IntegralType):
        return F.round(value).cast(m.dtype)
    return (F.round(value, m.decimals) if m.decimals is not None else value).cast(m.dtype)


def rows_for(model: Model, ids: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Add synthetic columns to a table of row numbers; the same number always gives the same row."""
    wanted = [m for m in model.marginals if columns is None or m.name in columns]
    if model.used == "bootstrap":
        return _fetched(model, ids, key, wanted, "row")
    i, base = ref(key), [ref(c) for c in ids.columns]
    order = {m.name: j for j, m in enumerate(model.marginals)}
    drawn = wanted
    # Only the independent normals that the wanted columns mix are drawn.
    needed = sorted({k for m in drawn for k in range(order[m.name] + 1) if model.mixing[order[m.name], k] != 0.0})
    out = ids.select(*base, *[normal(model.seed, f"z{k}", i).alias(f"_z{k}") for k in needed])
    mixed = []
    for m in drawn:
        j = order[m.name]
        terms = [F.lit(float(model.mixing[j, k])) * F.col(f"_z{k}") for k in range(j + 1) if model.mixing[j, k] != 0.0]
        mixed.append(sum(terms[1:], terms[0]).alias(f"_x{j}"))
    out = out.select(*base, *mixed)
    out = out.select(*base, *[normal_cdf(F.col(f"_x{order[m.name]}")).alias(f"_u{order[m.name]}") for m in drawn])
    final = {}
    for m in drawn:
        j = order[m.name]
        if m.kind == "number":
            value = _value_of(m, F.col(f"_u{j}"))
        elif m.kind == "table":
            out = _value_at(out, m, f"_u{j}", f"_t{j}")
            value = F.col(f"_t{j}").cast(m.dtype)
        else:
            value = None
            if m.labels:
                bounds, size = _padded(m.upto[:-1], 2.0)
                out = add_bucket(out, F.col(f"_u{j}"), bounds, f"_b{j}", size)
                value = F.array(*[F.lit(name) for name in m.labels])[F.col(f"_b{j}")].cast(m.dtype)
        value = F.lit(None).cast(m.dtype) if value is None else value
        if m.null_share > 0:
            value = F.when(uniform(model.seed, f"null{j}", i) >= m.null_share, value)
        final[m.name] = value
    return out.select(*base, *[final[m.name].alias(m.name) for m in wanted])


def _fetched(model: Model, ids: DataFrame, key: str, wanted: Sequence[Marginal], tag: str) -> DataFrame:
    """Columns taken from one drawn source row per result row, by an equi-join on its number."""
    names = [m.name for m in wanted]
    numbered = dense_index(model.source.select([ref(c) for c in names]), [ref(c) for c in names], "_at")
    rows = numbered.count()
    at = hash_index(model.seed, f"fetch/{tag}", ref(key), F.lit(rows))
    return ids.withColumn("_at", at).join(numbered, "_at").drop("_at")


def sample(model: Model, n: int) -> DataFrame:
    """``n`` synthetic rows, numbered by ``_row``."""
    ids = model.source.sparkSession.range(n).select(F.col("id").alias("_row"))
    return rows_for(model, ids, "_row")


def with_subject_ids(rows: DataFrame, number: str = "_row", name: str = "synt_id") -> DataFrame:
    """First column SYN-000001, SYN-000002, ... from a 0-based row number."""
    label = F.format_string("SYN-%06d", ref(number) + 1)
    return rows.select(label.alias(name), *[ref(c) for c in rows.columns if c != number])


