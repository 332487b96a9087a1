"""Pairwise moments against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.operators import gram, synth, validate as vd


def table(spark, x):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names


def by_hand(x, i, j):
    ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[ok, i], x[ok, j]
    if len(a) < 2 or (a == a[0]).all() or (b == b[0]).all():
        return None
    return float(np.corrcoef(a, b)[0, 1])


def data(rows=400, size=6, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(rows, size)) @ r.normal(size=(size, size)) + 1e9 * r.normal(size=size)
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 2] = 0.1
    x[:, 4] = np.where(np.isnan(x[:, 0]), r.normal(size=rows), 0.3)  # constant wherever column 0 is known
    return x


@pytest.mark.parametrize("held", [gram.HELD_NUMBERS, 60])
def test_moments_of_pairs(spark, held):
    x = data()
    df, names = table(spark, x)
    df = df.repartition(5)
    m = gram.pair_moments(df, [F.col(n) for n in names], held=held)
    got = {(r["i"], r["j"]): r["r"] for r in gram.pair_correlations(m).collect()}
    assert set(got) == {(i, j) for i in range(6) for j in range(i + 1, 6)}
    for (i, j), r in got.items():
        want = by_hand(x, i, j) if (i, j) != (0, 4) else None
        assert (r is None) == (want is None) and (r is None or abs(r - want) < 1e-5), (i, j)
    for r in m.collect():
        known = ~np.isnan(x[:, r["i"]])
        assert [int(n) for n in r["n"]] == [int((known & ~np.isnan(x[:, j])).sum()) for j in range(6)]
    assert gram.pair_moments(df.limit(0), [F.col(n) for n in names]).count() == 0


def test_many_columns_are_one_scan(spark, tmp_path):
    names = [f"c{i}" for i in range(300)]
    spark.range(500).select(*[F.rand(i).alias(n) for i, n in enumerate(names)]).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = vd.correlations(df, df.withColumns({n: F.col(n) + F.rand(7) for n in names[:3]}), names)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # One scan a side, whatever the number of pairs.
    assert plan.count("Relation [") == 2 and plan.count("MapInArrow") == 2
    rows = found.collect()
    assert len(rows) == 300 * 299 // 2 and sorted(r["pair"] for r in rows) == list(range(len(rows)))
    r = next(r for r in rows if (r["col_a"], r["col_b"]) == ("c5", "c200"))
    assert r["source_correlation"] == pytest.approx(df.corr("c5", "c200"), abs=1e-4)
    assert gram.column_blocks(300) == [(0, 300)] and gram.column_blocks(5, 60) == [(0, 2), (2, 4), (4, 5)]


def test_uncentred_correlation(spark):
    x = np.random.default_rng(3).normal(size=(300, 3)) + 0.2
    x[:50, 1] = np.nan
    df, names = table(spark, x)
    got = gram.raw_correlation(gram.pair_moments(df, [F.col(n) for n in names]), 3)
    for i in range(3):
        for j in range(3):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[ok, i], x[ok, j]
            assert got[i, j] == pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def test_an_indefinite_matrix_is_mended():
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    assert np.linalg.eigvalsh(bad)[0] < 0
    good = synth.nearest_correlation(bad)
    assert np.linalg.eigvalsh(good)[0] > 0 and np.allclose(np.diag(good), 1) and np.abs(good - bad).max() < 0.45
    factor = synth.mixing_matrix(bad)
    assert np.allclose(factor @ factor.T, good)
    fine = np.array([[1.0, 0.3], [0.3, 1.0]])
    assert (synth.nearest_correlation(fine) == fine).all()
    assert synth.mixing_matrix(np.array([[1.0, np.nan], [np.nan, 1.0]])) is None


def test_fit_with_gaps_that_do_not_overlap(spark):
    """Pairs known in different rows contradict each other; the model is still a copula."""
    r = np.random.default_rng(4)
    z = r.normal(size=(600, 1))
    x = np.hstack([z, z, z]) + 0.1 * r.normal(size=(600, 3))
    x[:200, 2], x[200:400, 0], x[400:, 1] = np.nan, np.nan, np.nan
    x[400:, 2] *= -1
    df, names = table(spark, x)
    fitted = synth.fit(df)
    assert fitted.used == "gaussian_copula"
    mixed = fitted.mixing @ fitted.mixing.T
    assert np.allclose(np.diag(mixed), 1) and mixed[0, 1] > 0.3 and mixed[0, 2] < -0.3
    assert synth.sample(fitted, 200).count() == 200
