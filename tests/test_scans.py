"""Running values over cells of cells, on three levels of tiny cells, against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirrortab.operators import clean as cn
from mirrortab.operators.frequency import ranked_values
from mirrortab.operators.scans import Levels, carried, with_cells
from mirrortab.operators.validate import numeric_comparison

TINY = Levels(2, 3)


def test_levels_follow_the_rows():
    assert Levels.for_rows(1000) == Levels(6, 1)
    assert Levels.for_rows(500_000 * 1024) == Levels(10, 1)
    assert Levels.for_rows(500_000 * 1024 + 1).levels == 2
    for rows in (10 ** 6, 10 ** 9, 10 ** 12, 10 ** 15):
        found = Levels.for_rows(rows)
        assert found.bits <= 10 and rows <= 500_000 * found.fan ** found.levels < 4 * max(rows * found.fan, 64 * 500_000)


def test_cells_rise_with_the_value(spark):
    values = random.Random(3).sample(range(10 ** 6), 800)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(5)
    rows = with_cells(df, F.col("v").cast("double"), "cell", TINY).orderBy(F.asc_nulls_first("v")).collect()
    cells = [r["cell"] for r in rows]
    assert len(rows) == 801 and cells == sorted(cells) and cells[0] == 0 and max(cells) < 64
    sizes = pd.Series(cells).value_counts()
    assert len(sizes) > 48 and sizes.max() < 40
    assert with_cells(df.limit(0), F.col("v").cast("double"), "cell", TINY).count() == 0


@pytest.mark.parametrize("levels", [Levels(6, 1), Levels(3, 2), TINY])
def test_carried_values_equal_a_loop(spark, levels):
    draw = random.Random(7)
    cells = sorted(draw.sample(range(64), 40))
    ends = [(c, draw.choice([None, None, c * 10]), draw.choice([None, c * 100]), draw.randrange(9)) for c in cells]
    df = spark.createDataFrame(ends, "cell long, a long, b long, s long")
    got = {r["cell"]: (r["a"], r["b"], r["s"]) for r in carried(df, "cell", {"a": "last", "b": "next", "s": "sum"}, levels).collect()}
    for i, (c, *_) in enumerate(ends):
        a = [x[1] for x in ends[:i] if x[1] is not None]
        b = [x[2] for x in ends[i + 1:] if x[2] is not None]
        assert got[c] == (a[-1] if a else None, b[0] if b else None, sum(x[3] for x in ends[:i]))
    assert len(got) == 40


@pytest.mark.parametrize("gaps", [0.2, 0.97, 1.0])
def test_fill_on_three_levels_is_pandas(spark, gaps):
    draw = random.Random(11)
    keys = draw.sample(range(10 ** 9), 700)
    rows = [(k, None if draw.random() < gaps else draw.randrange(100), None if draw.random() < gaps else f"t{k % 7}") for k in keys]
    df = spark.createDataFrame(rows, "k long, v long, t string").repartition(6)
    out = cn.fill_along(df, ["v", "t"], "k", TINY).orderBy("k").collect()
    frame = pd.DataFrame(sorted(rows), columns=["k", "v", "t"]).astype({"v": "Int64", "t": "object"})
    want = frame.ffill().bfill()
    assert [r["k"] for r in out] == list(want["k"])
    assert [r["v"] for r in out] == [None if pd.isna(x) else int(x) for x in want["v"]]
    assert [r["t"] for r in out] == [None if pd.isna(x) else x for x in want["t"]]


def test_ranks_on_three_levels_equal_those_on_one(spark):
    draw = random.Random(13)
    rows = [(round(draw.gauss(0, 30), 2), None if i % 9 == 0 else draw.choice([5.0, 5.0, draw.randrange(400) / 4]), None) for i in range(1500)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(5)
    names = ["column", "value", "a", "b", "a_upto", "b_upto", "a_total", "b_total"]

    def ranked(levels):
        found = ranked_values({"a": df, "b": df.where("x > 0")}, ["x", "y", "z"], levels)
        return sorted(tuple(r[n] for n in names) for r in found.collect())

    one = ranked(None)
    assert ranked(TINY) == one and {r[0] for r in one} == {"x", "y"}
    for c, at in (("x", 0), ("y", 1)):
        known = sorted(r[at] for r in rows if r[at] is not None)
        assert [(r[1], r[4], r[6]) for r in one if r[0] == c] == [(v, sum(k <= v for k in known), len(known)) for v in sorted(set(known))]
    sides = df.where("x > 0"), df.where("x <= 0")
    plain, deep = (numeric_comparison(*sides, ["x", "y"], levels=levels).orderBy("column").collect() for levels in (None, TINY))
    for p, d in zip(plain, deep):
        assert [round(v, 9) if isinstance(v, float) else v for v in p] == [round(v, 9) if isinstance(v, float) else v for v in d]
