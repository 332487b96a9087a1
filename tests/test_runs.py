"""The whole way from a table with identifiers to reports."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mirrortab.operators.predicates import Requirement
from mirrortab.plans.generate import Workbench
from mirrortab.sources import runs
from mirrortab.sources.tables import read_landed


@pytest.fixture(scope="module")
def bench(spark):
    return Workbench(spark, f"{spark.conf.get('spark.checkpoint.dir')}/bench")


def test_run_with_identifiers(spark, bench):
    i = F.col("id")
    visits = spark.range(240).select(
        i.alias("row"), F.concat(F.lit("P"), (i % 60).cast("string")).alias("Patient_ID"), F.concat(F.lit("N"), i).alias("Patient_Name"),
        F.concat(F.lit("m"), i, F.lit("@x.org")).alias("contact"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 90).cast("int")).alias("visit_date"),
        (20 + i * 7 % 60).cast("int").alias("age"), (i % 3 == 0).alias("diabetes"), F.when(i % 11 != 0, 100 + i * 13 % 50).alias("systolic_bp"))
    table_id = bench.register(visits, "visits", "row")
    record = runs.latest(runs.read(spark, bench.root, "datasets"), ["id"], [F.col("written_at")]).first()
    assert record["num_rows"] == 240 and record["sensitive_columns"] == ["Patient_Name", "contact"]
    cleaned, summary, removed = bench.preprocess(table_id)
    assert removed == ["Patient_ID", "Patient_Name", "contact"]
    assert cleaned.columns == ["visit_date", "age", "diabetes", "systolic_bp"]
    assert cleaned.where(F.col("systolic_bp").isNull()).count() == 0
    assert summary.first()["columns_excluded"] == ["Patient_ID", "Patient_Name", "contact"]

    run_id = bench.generate(table_id, 150, requirements=[Requirement("age", "gte", 50, 0.6)])
    state = runs.status(runs.read(spark, bench.root, "generations"), run_id)
    assert state["status"] == "done" and state["num_generated"] == 150 and state["cohort_report"][0]["generated_pct"] == 60.0
    rows = read_landed(spark, bench.root, "synthetic", run_id)
    assert rows.columns[0] == "synt_id" and not set(rows.columns) & {"Patient_ID", "Patient_Name", "contact"}
    ids = sorted(r[0] for r in rows.select("synt_id").collect())
    assert ids[0] == "SYN-000001" and ids[-1] == "SYN-000150"

    first = bench.validation(run_id).first()
    assert bench.validation(run_id).first()["id"] == first["id"]
    again = bench.validation(run_id, force=True).first()
    assert again["id"] != first["id"] and again["overall"] == first["overall"]
    assert bench.privacy(run_id).first()["risk_level"] in ("Low", "Medium", "High")


def test_failed_run_is_logged(spark, bench):
    with pytest.raises(AnalysisException):
        bench.generate("no-such-table", 100)
    last = runs.newest_runs(runs.read(spark, bench.root, "generations"), [F.desc("written_at")], k=1).first()
    assert last["status"] == "error" and last["error"]
    with pytest.raises(ValueError):
        bench.generate("no-such-table", 5)
    assert runs.status(runs.read(spark, bench.root, "generations"), "unknown") is None


def test_a_log_of_many_appends_is_read_from_few_files(spark, bench, monkeypatch):
    monkeypatch.setattr(runs, "TAIL_FILES", 5)
    root = f"{bench.root}/log"
    assert runs.read(spark, root, "validations").count() == 0
    for i in range(23):
        runs.append(spark, root, "validations", {"id": f"v{i}", "generation_id": f"g{i % 4}"})
        rows = runs.read(spark, root, "validations")
        assert rows.count() == i + 1 and len(rows.inputFiles()) <= 5 + runs.SNAPSHOT_FILES
    assert sorted(r["id"] for r in rows.collect()) == sorted(f"v{i}" for i in range(23))
    assert [runs.report_for(rows, f"g{k}").first()["id"] for k in range(4)] == ["v20", "v21", "v22", "v19"]
    assert len(runs._files(spark, f"{root}/validations")) <= 12 and len(runs._snapshots(spark, root, "validations")) <= 2


def test_a_log_of_many_files_without_a_snapshot(spark, bench):
    root = f"{bench.root}/old"
    old = spark.range(2000).selectExpr("concat('p', id) AS id", "concat('g', id % 50) AS generation_id", "CAST(timestamp_seconds(id) AS timestamp) AS written_at")
    empty = runs.read(spark, root, "privacy_checks")
    empty.unionByName(old, allowMissingColumns=True).repartition(400, "id").write.parquet(f"{root}/privacy_checks")
    before = sorted(map(str, runs.latest(runs.read(spark, root, "privacy_checks"), ["generation_id"], [F.col("written_at")]).collect()))
    runs.append(spark, root, "privacy_checks", {"id": "last", "generation_id": "new"})
    rows = runs.read(spark, root, "privacy_checks")
    assert len(rows.inputFiles()) <= runs.SNAPSHOT_FILES and rows.count() == 2001
    assert sorted(map(str, runs.latest(rows.where("id != 'last'"), ["generation_id"], [F.col("written_at")]).collect())) == before


def test_compaction_keeps_readers_and_late_appends(spark, bench, monkeypatch):
    root = f"{bench.root}/busy"
    for i in range(3):
        runs.append(spark, root, "validations", {"id": f"v{i}"})
    reader, whole = runs.read(spark, root, "validations"), runs._rows

    def append_meanwhile(*args):
        out = whole(*args)
        monkeypatch.setattr(runs, "_rows", whole)
        runs.append(spark, root, "validations", {"id": "late"})
        return out

    monkeypatch.setattr(runs, "_rows", append_meanwhile)
    runs.compact(spark, root, "validations")
    assert reader.count() == 3 and runs.read(spark, root, "validations").count() == 4
    # A snapshot that was not finished, and one that another writer made at the same time.
    runs.read(spark, root, "validations").limit(1).write.parquet(f"{root}/validations.snapshots/{99:012d}-torn/rows")
    base, tail = runs._state(spark, root, "validations")
    with monkeypatch.context() as m:
        m.setattr(runs, "_state", lambda *args: (base, tail))
        runs.compact(spark, root, "validations")
        runs.compact(spark, root, "validations")
    runs.append(spark, root, "validations", {"id": "after"})
    runs.compact(spark, root, "validations")
    found = runs.read(spark, root, "validations")
    assert sorted(r["id"] for r in found.collect()) == ["after", "late", "v0", "v1", "v2"]
