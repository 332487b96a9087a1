"""Whitening of embeddings with a covariance over distinct vectors.

Entries become whole numbers, floor(scale * entry); a constant added to all of them would change none of the results. Identical vectors of them are grouped first, so a vector that
fills a third of the table is one row with a count from then on; the fit takes each with weight one, or with its count. Sums are exact.
The covariance is a sum of matrix products of centred blocks, one partial matrix per task. Every distinct vector is whitened once
and joined back to its rows.

A vector travels as its code: the numbers as little-endian integers of the smallest width that holds all of
them, with that width in front. Equal codes are equal vectors, no hash is involved, and the code of a unit vector takes a byte an entry.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import forget, saved

SCALE = 64
COMPONENTS = 16
#: Rows of one block of a matrix product.
BLOCK = 4096
#: Entries beyond this are taken as this, so that all of them are long integers.
LARGEST = 2**62
#: Vectors with more than this share of the rows are joined by broadcast, so there are at most ``1 / HOT_SHARE`` of them.
HOT_SHARE = 0.001
_LONG = 2**63 - 1


def coded(vectors: np.ndarray, scale: int = SCALE) -> list[bytes]:
    """The code of each row of a matrix of finite numbers."""
    with np.errstate(over="ignore"):
        numbers = np.clip(np.floor(vectors * scale), -LARGEST, LARGEST).astype(np.int64)
    low, high = numbers.min(axis=1), numbers.max(axis=1)
    width = np.full(len(numbers), 8)
    for bits in (32, 16, 8):
        width[(low >= -(1 << bits - 1)) & (high < 1 << bits - 1)] = bits // 8
    out: list[bytes] = [b""] * len(numbers)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw, size = numbers[at].astype(f"<i{w}").tobytes(), w * numbers.shape[1]
        head = bytes([w])
        for k, i in enumerate(at.tolist()):
            out[i] = head + raw[k * size:(k + 1) * size]
    return out


def decoded(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole numbers) of the codes, one matrix per length of code and width."""
    kinds = defaultdict(list)
    for i, c in enumerate(codes):
        kinds[c[0], len(c)].append(i)
    for (w, size), at in kinds.items():
        raw = np.frombuffer(b"".join([codes[i] for i in at]), np.uint8).reshape(len(at), size)
        yield np.array(at), np.ascontiguousarray(raw[:, 1:]).view(f"<i{w}").astype(np.int64)


def _rows_and_codes(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows of a batch whose vector is known, finite and not empty, and their codes."""
    lists = batch.column("vector")
    values = lists.flatten()
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    numbers = np.asarray(values.fill_null(np.nan)).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    good = (lengths > 0) & (bad[begins + lengths] == bad[begins])
    rows, codes = [], []
    for size in np.unique(lengths[good]).tolist():
        at = np.flatnonzero(good & (lengths == size))
        for k in range(0, len(at), BLOCK):
            part = at[k:k + BLOCK]
            rows.append(part)
            codes += coded(numbers[begins[part][:, None] + np.arange(size)], scale)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), codes


def codes_of(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, code) of the rows whose vector is known, finite and not empty."""
    def run(batches):
        for batch in batches:
            at, codes = _rows_and_codes(batch, scale)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(codes, pa.binary())], names=["key", "code"])

    kind = df.schema[key].dataType.simpleString()
    body = df.select(df[f"`{key}`"].alias("key"), df[f"`{vector}`"].cast("array<double>").alias("vector"))
    return body.mapInArrow(run, f"key {kind}, code binary")


@dataclass
class Centre:
    """Vectors of one length: their weight, the number of distinct ones and the exact sum per dimension."""
    weight: int
    distinct: int
    sums: list[int]


def centres(distinct: DataFrame, counted: bool) -> dict[int, Centre]:
    """The centre of the vectors of each length. Sums are exact: halves of 32 bits are added apart."""
    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            weights = np.asarray(batch.column("weight")) if counted else np.ones(batch.num_rows, np.int64)
            for at, x in decoded(batch.column("code").to_pylist()):
                size, w = x.shape[1], weights[at]
                held = totals.setdefault(size, [0, 0, [0] * size])
                held[0] += int(w.sum())
                held[1] += len(at)
                # A count below 2**31 times a half of 32 bits, and at most BLOCK of them, stays a long.
                for k in range(0, len(at), BLOCK):
                    part, v = x[k:k + BLOCK], w[k:k + BLOCK, None]
                    if int(v.max()) < 2**18:
                        high, low = ((part >> 32) * v).sum(axis=0), ((part & 0xFFFFFFFF) * v).sum(axis=0)
                        added = [(h << 32) + s for h, s in zip(high.tolist(), low.tolist())]
                    else:
                        added = (part.astype(object) * v).sum(axis=0).tolist()
                    held[2] = [a + b for a, b in zip(held[2], added)]
        for size, (w, n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([w] * size, pa.int64()),
                 pa.array([n] * size, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))],
                names=["size", "dim", "weight", "n", "sum"])

    parts = distinct.select("code", "weight").mapInArrow(run, "size int, dim int, weight bigint, n bigint, sum decimal(38,0)")
    out: dict[int, Centre] = {}
    totals = parts.groupBy("size", "dim").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    for r in totals.orderBy("size", "dim").collect():
        out.setdefault(r["size"], Centre(r["weight"], r["n"], [])).sums.append(int(r["sum"]))
    return out


def centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    """x - sums / weight; the difference is taken exactly before it is rounded."""
    limit = max(int(np.abs(x).max(initial=0)) * centre.weight, max(map(abs, centre.sums)))
    if limit < 2**61:
        return (x * centre.weight - np.array(centre.sums, np.int64)) / centre.weight
    return np.array([[float(Decimal(a * centre.weight - s) / centre.weight) for a, s in zip(row, centre.sums)] for row in x.tolist()])


def deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """Sum over the dimensions of (weight * x - sums)**2 as exact decimals; null beyond 38 digits."""
    limit = max(int(np.abs(x).max(initial=0)) * centre.weight, max(map(abs, centre.sums)))
    if limit < 2**61:
        apart = x * centre.weight - np.array(centre.sums, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] <= _LONG:
            return pa.array((apart * apart).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        rows = apart.tolist()
    else:
        rows = [[a * centre.weight - s for a, s in zip(row, centre.sums)] for row in x.tolist()]
    exact = (sum(a * a for a in row) for row in rows)
    return pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))


def gram(blocks: DataFrame, products: Callable) -> dict[int, np.ndarray]:
    """Sum of the matrices that ``products`` yields as (size, matrix) for each batch.

    A task adds up its own matrices, one per size, and sends them as rows; the rows of one number meet in one task,
    which adds them as they come, so that no task holds more than its share of one matrix. The driver gets a matrix per size.
    """
    def local(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, m in products(batch):
                held[size] = held[size] + m if size in held else m
        for size, m in held.items():
            yield _matrix_rows((size, i, r) for i, r in enumerate(m))

    def merged(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, i, r in zip(*[c.to_pylist() for c in batch.columns]):
                row = np.frombuffer(r, "<f8")
                held[size, i] = held[size, i] + row if (size, i) in held else row
        yield _matrix_rows((*k, r) for k, r in held.items())

    schema = "size int, i int, r binary"
    out: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    for r in blocks.mapInArrow(local, schema).repartition("size", "i").mapInArrow(merged, schema).collect():
        out[r["size"]][r["i"]] = np.frombuffer(bytes(r["r"]), "<f8")
    return {size: np.array([rows[i] for i in range(len(rows))]) for size, rows in out.items()}


def _matrix_rows(rows) -> pa.RecordBatch:
    columns = list(zip(*[(s, i, np.ascontiguousarray(r, "<f8").tobytes()) for s, i, r in rows])) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["size", "i", "r"])


@dataclass
class Fit:
    """Centre, falling eigenvalues with unit eigenvectors as columns, and the trace of the covariance, for one length of vector."""
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def kept(self, components: int) -> int:
        """Components, up to so many, with variance beyond rounding."""
        floor = max(self.values[0], 0.0) * len(self.values) * np.finfo(float).eps
        return int((self.values[:components] > floor).sum())

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        k = self.kept(components)
        return centred(x, self.centre) @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def fitted(distinct: DataFrame, counted: bool) -> dict[int, Fit]:
    """A fit per length of vector, over (code, weight) of distinct vectors."""
    about = centres(distinct, counted)

    def products(batch):
        weights = np.asarray(batch.column("weight")).astype(float)
        for at, x in decoded(batch.column("code").to_pylist()):
            for k in range(0, len(at), BLOCK):
                c = centred(x[k:k + BLOCK], about[x.shape[1]])
                yield x.shape[1], (c.T * weights[at[k:k + BLOCK]] if counted else c.T) @ c

    out = {}
    for size, m in gram(distinct.select("code", "weight"), products).items():
        m = (m + m.T) / (2 * about[size].weight)
        values, vectors = np.linalg.eigh(m)
        out[size] = Fit(about[size], values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(m)))
    return out


def _identity_errors(white: DataFrame, fits: dict[int, Fit], components: int, counted: bool) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, per length of vector.

    The first pass gives their means, the second the products of what is left without them.
    """
    kept = {size: f.kept(components) for size, f in fits.items()}

    def split(batch):
        weights = np.asarray(batch.column("weight")).astype(float) if counted else np.ones(batch.num_rows)
        sizes, w = np.asarray(batch.column("size")), batch.column("w")
        flat, lengths = np.asarray(w.flatten()), np.asarray(w.value_lengths()).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            if kept[size]:
                yield size, flat[begins[at][:, None] + np.arange(kept[size])], weights[at]

    part = white.select("size", "weight", "w")
    sums = gram(part, lambda batch: ((size, (m * w[:, None]).sum(axis=0, keepdims=True)) for size, m, w in split(batch)))
    means = {size: s[0] / fits[size].centre.weight for size, s in sums.items()}
    found = gram(part, lambda batch: ((size, ((m - means[size]).T * w) @ (m - means[size])) for size, m, w in split(batch)))
    return {size: float(np.abs(m / fits[size].centre.weight - np.eye(len(m))).max()) for size, m in found.items()}


def whitened(df: DataFrame, key: str, vector: str, components: int = COMPONENTS, counted: bool = False, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row and component.

    n is the number of distinct vectors (with ``counted``, of rows), deviation an exact decimal (null beyond 38 digits), whitened the
    centred vector's projection on the component over the root of its eigenvalue.

    Rows whose vector is null, empty or holds a null or a number that is not finite are left out. Repeated rows and null keys each get
    their rows. Vectors of different lengths are populations of their own, each with a fit; the driver holds one square matrix
    per length. A component without variance beyond rounding has whitened null, and explained null where the whole variance is zero;
    identity_error is over the others, null if there are none. A vector has no more components than entries. Where
    eigenvalues are equal, any orthonormal basis of their space may be returned, the same for all rows. Numbers beyond
    2**62 after scaling count as that. An empty table gives an empty one; other columns are not read.
    """
    spark = df.sparkSession
    rows = codes_of(df, key, vector, scale)
    distinct = saved(rows.groupBy("code").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    fits = fitted(distinct, counted)

    def project(batches):
        for batch in batches:
            codes, weights = batch.column("code").to_pylist(), batch.column("weight")
            for at, x in decoded(codes):
                fit = fits[x.shape[1]]
                for k in range(0, len(at), BLOCK):
                    part, places = x[k:k + BLOCK], pa.array(at[k:k + BLOCK])
                    w = fit.project(part, components)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("code").take(places), weights.take(places), pa.array([x.shape[1]] * len(w), pa.int32()), deviations(part, fit.centre), lists],
                        names=["code", "weight", "size", "deviation", "w"])

    white = saved(distinct.select("code", "weight").mapInArrow(project, "code binary, weight bigint, size int, deviation decimal(38,0), w array<double>"), "white")
    forget(distinct)
    errors = _identity_errors(white, fits, components, counted)
    total = white.agg(F.sum("weight").alias("n")).first()["n"] or 0
    # Few vectors can hold many rows each: those are sent to all, so that no task gets a third of the rows.
    is_hot = F.col("weight") > max(1.0, total * HOT_SHARE)
    hot = F.broadcast(white.where(is_hot).select("code", "size", "deviation", "w"))
    common = rows.join(hot, "code")
    rest = rows.join(F.broadcast(white.where(is_hot).select("code")), "code", "left_anti").join(white.where(~is_hot).select("code", "size", "deviation", "w"), "code")
    facts = [(size, c + 1, f.centre.weight if counted else f.centre.distinct, float(max(f.values[c], 0.0) / f.trace) if f.trace > 0 else None, errors.get(size))
             for size, f in fits.items() for c in range(min(components, size))]
    per_component = spark.createDataFrame(facts, "size int, component int, n bigint, explained double, identity_error double")
    per_size = per_component.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("component", "n", "explained", "identity_error"))).alias("facts"))
    each = (common.unionByName(rest).join(F.broadcast(per_size), "size")
            .select("key", "deviation", "w", F.explode("facts").alias("fact")))
    return each.select(F.col("key").alias(key), F.col("fact.component").alias("component"), F.col("fact.n").alias("n"), "deviation",
                       F.try_element_at("w", F.col("fact.component")).alias("whitened"),
                       F.col("fact.explained").alias("explained"), F.col("fact.identity_error").alias("identity_error"))


@query("op11_whitening")
def op11_whitening(spark, folder):
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component; a deviation that no long holds is null."""
    out = whitened(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
