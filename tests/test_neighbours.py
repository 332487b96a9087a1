"""Near duplicates over whole tables against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.operators import neighbours as nb, privacy as pv
from mirrortab.plans import compare


def encoded(spark, source, synthetic):
    rows = [(0, i, [float(x) for x in p]) for i, p in enumerate(source)] + [(1, i, [float(x) for x in p]) for i, p in enumerate(synthetic)]
    return spark.createDataFrame(rows, "side int, idx long, features array<double>")


def by_hand(source, synthetic, threshold):
    out = {}
    for i, y in enumerate(synthetic):
        d = np.sqrt(((source - y) ** 2).sum(axis=1)) if len(source) else np.zeros(0)
        if len(d) and d.min() < threshold:
            out[i] = (int(d.argmin()), float(d.min()))
    return out


def found(spark, source, synthetic, threshold, steps=()):
    rows = encoded(spark, source, synthetic)
    points = nb.near_points(rows, threshold, steps)
    got = {r["synth_idx"]: (r["nearest_source_idx"], r["distance"]) for r in nb.near_rows(rows, points).collect()}
    assert pv.near_counts(points).first()["near_duplicates"] == len(got)
    return got


@pytest.mark.parametrize("size, threshold", [(1, 0.01), (2, 0.05), (3, 0.1), (5, 0.3), (9, 0.5)])
def test_against_all_pairs(spark, size, threshold):
    r = np.random.default_rng(size)
    # A cluster, a cloud, repeated points and points on cell borders.
    source = np.concatenate([r.normal(0.5, 0.01, (150, size)), r.random((250, size)), np.full((5, size), 0.25), r.integers(0, 9, (80, size)) * threshold / 4])
    synthetic = np.concatenate([r.normal(0.5, 0.05, (150, size)), r.random((150, size)), source[::50], r.integers(0, 9, (80, size)) * threshold / 4 + threshold / 2])
    want, got = by_hand(source, synthetic, threshold), found(spark, source, synthetic, threshold)
    assert set(got) == set(want) and 10 < len(want)
    assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in want)
    assert all(abs(np.sqrt(((source[got[i][0]] - synthetic[i]) ** 2).sum()) - want[i][1]) < 1e-12 for i in want)


def test_labels_join_as_they_are(spark):
    r = np.random.default_rng(2)
    label = lambda n: r.integers(0, 4, (n, 1)) / 4
    source = np.concatenate([label(300), r.random((300, 2))], axis=1)
    synthetic = np.concatenate([label(200), r.random((200, 2))], axis=1)
    want = by_hand(source, synthetic, 0.05)
    plain, keyed = found(spark, source, synthetic, 0.05), found(spark, source, synthetic, 0.05, [0.25, None, None])
    assert plain == keyed and set(plain) == set(want) and len(want) > 5


def test_empty_sides(spark):
    none, some = np.zeros((0, 2)), np.ones((3, 2))
    assert found(spark, none, some, 0.1) == {} and found(spark, some, none, 0.1) == {} and found(spark, some, some, 0.0) == {}
    assert found(spark, some, some, 0.1) == {i: (0, 0.0) for i in range(3)}


def test_a_leak_among_many_rows_is_found(spark):
    """One near copy in 100,000 rows a side; the sampling option does not see it."""
    side = lambda which: spark.range(100_000).select(
        F.col("id").alias("k"), *[(F.rand(10 * which + j) * 1000).alias(f"x{j}") for j in range(5)], F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    source = side(1).where("k <> 77").union(spark.sql("SELECT 77L AS k, 0.5D, 0.5D, 0.5D, 999.5D, 999.5D, 'a'"))
    synthetic = side(2).where("k <> 88").union(spark.sql("SELECT 88L AS k, 0.6D, 0.5D, 0.4D, 999.5D, 999.6D, 'a'"))
    report, pairs = compare.privacy(source, synthetic, "k", threshold=0.001)
    r = report.first()
    assert (r["exact_duplicates"], r["near_duplicates"], r["near_duplicate_basis"]) == (0, 1, "all rows")
    assert [tuple(p)[:2] for p in pairs.collect()] == [(88, 77)]
    report, pairs = compare.privacy(source, synthetic, "k", threshold=0.001, size=500)
    assert report.first()["near_duplicate_basis"] == "estimated from samples of 500 rows a side" and pairs.count() == 0


def test_sides_can_be_encoded_apart(spark):
    a = spark.createDataFrame([(1, 0.0, "a", None), (2, 10.0, "b", 1), (3, None, None, 2)], "side int, idx double, c string, x int")
    b = spark.createDataFrame([(1, 0.0, "a", 5), (2, 100.0, "z", 6), (3, 50.0, "z", 9)], "side int, idx double, c string, x int")
    both = {(r["side"], r["idx"]): r["features"] for r in pv.encoded_rows(a, b, "side", ["idx", "c"]).rows.collect()}
    assert both == {(0, 1): [0.0, 0.25], (0, 2): [0.1, 0.5], (0, 3): [0.1, 0.0], (1, 1): [0.0, 0.25], (1, 2): [1.0, 0.75], (1, 3): [0.5, 0.75]}
    per = pv.encoded_rows(a, b, "side", ["idx", "c"], independent=True)
    assert per.steps == [None, None]
    per = {(r["side"], r["idx"]): r["features"] for r in per.rows.collect()}
    assert per[0, 2] == [1.0, 2 / 3] and per[1, 2] == [1.0, 0.5] and per[1, 1] == [0.0, 0.0]


def test_one_dictionary_for_all_columns(spark):
    names = [f"c{i}" for i in range(30)]
    df = spark.range(40).select("id", *[F.concat(F.lit("v"), (F.col("id") % (i % 7 + 1)).cast("string")).alias(n) for i, n in enumerate(names)])
    before = len(list(os.scandir(spark.conf.get("spark.checkpoint.dir"))))
    out = pv.label_encode(df, names, ["id"]).where("id = 5").first()
    assert [out[n] for n in names] == [(5 % (i % 7 + 1)) / (i % 7 + 1) for i in range(30)]
    assert len(list(os.scandir(spark.conf.get("spark.checkpoint.dir")))) - before == 1
