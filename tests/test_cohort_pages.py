"""Proportions met together, and pages through an index."""

import pytest
from pyspark.sql import functions as F

from mirrortab.operators import cohort as ch, prepare as pr, synth, view
from mirrortab.operators.pages import Pages
from mirrortab.operators.predicates import Requirement
from mirrortab.plans.generate import synthetic_rows


def test_quotas_meet_all_proportions():
    counts = {0: 5000, 1: 300, 2: 900, 3: 4}
    quotas = ch.joint_quotas(counts, [0.5, 0.2], 100_000)
    assert sum(quotas.values()) == 100_000
    assert abs(quotas[1] + quotas[3] - 50_000) <= 2 and abs(quotas[2] + quotas[3] - 20_000) <= 2
    odds = quotas[3] * quotas[0] / (quotas[1] * quotas[2])
    assert abs(odds / (4 * 5000 / (300 * 900)) - 1) < 0.01
    assert ch.joint_quotas({}, [0.5], 10) == {} and ch.joint_quotas({0: 7}, [0.5], 10) == {0: 10}
    assert ch.joint_quotas({0: 7, 1: 1}, [0.0], 10) == {0: 10, 1: 0} and ch.joint_quotas({0: 7, 1: 1}, [1.0], 3) == {0: 0, 1: 3}
    assert ch.joint_quotas({0: 1, 1: 1, 2: 1}, [], 10) == {0: 4, 1: 3, 2: 3}


@pytest.mark.parametrize("parts", [1, 7])
def test_joint_rows_hold_both_requests(spark, parts):
    i = F.col("id")
    pool = spark.range(3000).select(i, (i % 90).alias("age"), F.when(i % 11 != 0, i % 90 > 70).alias("ill"), (i * 3).alias("payload")).repartition(parts)
    wanted = [Requirement("age", "gte", 60, 0.7), Requirement("nothing", "equal", 1, 0.5), Requirement("ill", "equal", True, 0.25)]
    out = ch.resample(pool, "id", 2000, wanted, joint=True)
    rows = sorted(map(tuple, out.select("_row", "id", "age", "ill", "payload").collect()))
    assert [r[0] for r in rows] == list(range(2000)) and all(r[4] == 3 * r[1] for r in rows)
    assert abs(sum(r[2] >= 60 for r in rows) - 1400) <= 2 and abs(sum(bool(r[3]) for r in rows) - 500) <= 2
    assert abs(sum(r[2] >= 60 for r in rows[:200]) - 140) < 30
    if parts == 7:
        again = ch.resample(pool.repartition(3), "id", 2000, wanted, joint=True)
        assert sorted(map(tuple, again.select("_row", "id", "age", "ill", "payload").collect())) == rows
    else:
        assert ch.resample(pool.limit(0), "id", 5, wanted, joint=True).count() == 0
        with pytest.raises(ValueError):
            ch.joint_keys(pool, "id", 5, [Requirement("age", "gte", 1, 0.5)] * 11)


def test_a_deep_page_reads_one_or_two_files(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 97).alias("v"), F.lit("x").alias("t")).repartition(6)
    made = Pages.build(df, "v", "desc", ["id"], rows_per_file=300)
    again = Pages.open(spark, made.path)
    assert made.total == again.total == 5000
    for number in (1, 30, 99, 100, 101):
        page = again.page(number, 50)
        want, _ = view.page(df, number, 50, "v", "desc", ["id"])
        assert page.columns == df.columns and [tuple(r) for r in page.collect()] == [tuple(r) for r in want.collect()]
        assert len(page.inputFiles()) <= 2
    assert again.page(101, 50).count() == 0 and Pages.build(df.limit(0), "v").page(1).count() == 0
    for wrong in (lambda: again.page(0), lambda: again.page(1, 5), lambda: Pages.build(df, "none")):
        with pytest.raises(ValueError):
            wrong()


def test_cells_that_a_model_cannot_read_are_counted(spark):
    i = F.col("id")
    df = spark.range(200).select(
        "id", F.when(i % 20 == 0, "soon").when(i % 20 == 1, None).otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 50).cast("int")), "yyyy-MM-dd")).alias("seen"),
        F.when(i % 25 == 0, "high").otherwise((i * 1.5).cast("string")).alias("level"), F.lit("a").alias("t"))
    out, lost = pr.model_ready_counted(df, ["id"])
    assert lost == {"seen": 10, "level": 8}
    assert out.where("seen IS NULL").count() == 20 and out.where("level IS NULL").count() == 8
    clean = df.where("id % 20 > 1 AND id % 25 > 0")
    assert pr.model_ready_counted(clean, ["id"])[1] == {}


def test_synthetic_rows_meet_requests_together(spark):
    i = F.col("id")
    df = spark.range(400).select((i % 80).cast("double").alias("age"), F.when((i % 80 > 50) & (i % 3 > 0), "yes").otherwise("no").alias("ill"))
    wanted = [Requirement("age", "gte", 50, 0.7), Requirement("ill", "equal", "yes", 0.2)]
    rows = synthetic_rows(synth.fit(df), 500, wanted, joint=True).select("_row", "age", "ill").collect()
    assert sorted(r["_row"] for r in rows) == list(range(500))
    assert abs(sum(r["age"] >= 50 for r in rows) - 350) <= 5 and abs(sum(r["ill"] == "yes" for r in rows) - 100) <= 5
