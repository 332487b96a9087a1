"""From a landed table to a synthetic one, with every state written to the run log."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from mirrortab.functions.values import ref
from mirrortab.operators import cohort, synth
from mirrortab.operators.classify import (DIRECT, LINKAGE, approved_columns, classes_of_schema, classify)
from mirrortab.operators.clean import preprocess
from mirrortab.operators.ordering import dense_index
from mirrortab.operators.predicates import Requirement
from mirrortab.operators.prepare import model_ready_counted
from mirrortab.operators.profile import profile
from mirrortab.plans import compare
from mirrortab.sources import runs
from mirrortab.sources.demo import patients_for
from mirrortab.sources.report import write_sections
from mirrortab.sources.tables import MIN_ROWS_MODEL, gate, land, new_id, read_landed


@dataclass
class Workbench:
    """Tables and run log under one folder that the cluster shares."""

    spark: SparkSession
    root: str
    seed: int = 42
    order_by: str = "row_order"

    def register(self, df: DataFrame, name: str, order_by: str, is_demo: bool = False) -> str:
        """Land an input table and record its profile and classes. ``order_by`` is its unique row order."""
        gate(df)
        kept = df.select(ref(order_by).alias(self.order_by), *[ref(c) for c in df.columns if c != order_by])
        table_id, _ = land(kept, self.root)
        landed = read_landed(self.spark, self.root, "raw", table_id)
        body = landed.drop(self.order_by)
        # The row order is not part of the table, so it is looked at but not reported.
        facts = [r for r in profile(landed, [self.order_by]).orderBy("position").collect() if r["column"] != self.order_by]
        classes = {r["column"]: r["category"] for r in classify(landed).collect()}
        classes.pop(self.order_by, None)
        runs.append(self.spark, self.root, "datasets", {
            "id": table_id, "name": name, "num_rows": body.count(), "num_columns": len(body.columns),
            "columns": [(r["column"], r["dtype"], r["missing_count"], r["unique_count"], classes[r["column"]]) for r in facts],
            "sensitive_columns": [c for c in body.columns if classes[c] == DIRECT], "approved_columns": [],
            "is_demo": is_demo, "status": "uploaded"})
        return table_id

    def register_demo(self, rows: int = 2000) -> str:
        """The demo table goes the same way as any other."""
        people = patients_for(self.spark.range(rows), "id", self.seed)
        return self.register(people, "demo", "id", is_demo=True)

    def recorded_classes(self, table_id: str) -> dict[str, str]:
        """Column to class as found when the table was registered, whoever reads them and when."""
        log = runs.read(self.spark, self.root, "datasets").where((F.col("id") == table_id) & F.col("columns").isNotNull())
        newest = runs.latest(log, ["id"], [F.col("written_at")]).first()
        if newest is None:
            raise ValueError(f"table {table_id} is not registered")
        return {c["column"]: c["category"] for c in newest["columns"]}

    def preprocess(self, table_id: str, wanted: Sequence[str] | None = None,
                   mapping: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
        """Clean the approved columns; (cleaned, summary, removed identifiers)."""
        landed = read_landed(self.spark, self.root, "raw", table_id)
        body = landed.drop(self.order_by)
        classes = self.recorded_classes(table_id)
        barred = [c for c in body.columns if classes[c] in (DIRECT, LINKAGE)]
        kept, removed = approved_columns(body.columns, wanted or body.columns, barred)
        cleaned, summary = preprocess(landed, kept, self.order_by, mapping)
        gate(cleaned, MIN_ROWS_MODEL)
        _, path = land(cleaned, self.root, "clean", table_id)
        runs.append(self.spark, self.root, "datasets", {
            "id": table_id, "approved_columns": kept, "preprocessed_path": path, "status": "preprocessed",
            "num_columns": len(cleaned.columns)})
        return read_landed(self.spark, self.root, "clean", table_id), summary, removed

    def generate(self, table_id: str, n: int, model: str = synth.DEFAULT_MODEL,
                 requirements: Sequence[Requirement] = (), preset: Mapping | None = None, joint: bool = False) -> str:
        """Fit, sample, resample to the requirements, write; every state is logged. Returns the run id.

        Requirements are applied one after the other; with ``joint`` they are met together.
        """
        if n < synth.MIN_ROWS_OUT:
            raise ValueError(f"at least {synth.MIN_ROWS_OUT} rows must be asked for")
        run_id, begun = new_id(), time.time()
        note = {"id": run_id, "dataset_id": table_id, "num_requested": n, "model_used": model}

        def log(status: str, progress: int, message: str, **more) -> None:
            note.update(more)
            runs.append(self.spark, self.root, "generations",
                        {**note, "status": status, "progress": progress, "message": message})

        log("pending", 0, "queued")
        try:
            landed = read_landed(self.spark, self.root, "raw", table_id)
            cleaned = read_landed(self.spark, self.root, "clean", table_id)
            ready, unread = model_ready_counted(cleaned, [])
            gate(ready, MIN_ROWS_MODEL)
            _, source_path = land(ready, self.root, "model_ready", run_id)
            ready = read_landed(self.spark, self.root, "model_ready", run_id)
            log("training", 15, "fitting", source_path=source_path, unread_cells=sorted(unread.items()))
            fitted = synth.fit(ready, model, self.seed)
            log("generating", 60, "sampling", model_used=fitted.used)
            wanted = list(requirements) or (cohort.preset_requirements(ready, preset) if preset else [])
            rows = synthetic_rows(fitted, n, wanted, self.seed, joint)
            keyed = LINKAGE in classes_of_schema(landed).values()
            out = synth.with_subject_ids(rows) if keyed else rows.drop(cohort.ROW)
            _, path = land(out, self.root, "synthetic", run_id)
            written = read_landed(self.spark, self.root, "synthetic", run_id)
            report = cohort.cohort_report(written, wanted).orderBy("place").collect() if wanted else []
            log("done", 100, "complete", output_path=path, num_generated=written.count(),
                seconds=round(time.time() - begun, 2),
                requirements=[(r.feature, r.operator, str(r.value), float(r.target_proportion)) for r in wanted],
                cohort_report=[(r["label"], r["requested_pct"], r["generated_pct"], r["diff_pct"], r["status"])
                               for r in report])
        except Exception as problem:
            log("error", 0, f"Error: {problem}", error=str(problem))
            raise
        return run_id

    def _pair(self, run_id: str) -> tuple[DataFrame, DataFrame, dict]:
        state = runs.status(runs.read(self.spark, self.root, "generations"), run_id)
        if state is None or state["status"] != "done":
            raise ValueError(f"generation {run_id} is not complete")
        return (read_landed(self.spark, self.root, "model_ready", run_id),
                read_landed(self.spark, self.root, "synthetic", run_id), state)

    def validation(self, run_id: str, force: bool = False) -> DataFrame:
        """The stored validation row of a run; computed if there is none or ``force``."""
        log = runs.read(self.spark, self.root, "validations")
        if not force:
            found = runs.report_for(log, run_id)
            if not found.isEmpty():
                return found
        source, synthetic, state = self._pair(run_id)
        touched = [r["feature"] for r in state["requirements"] or []]
        result = compare.validate(source, synthetic, cohort_columns=touched)
        report_id = new_id()
        path = f"{self.root}/reports/{report_id}"
        write_sections({"Numerical Stats": result.numeric, "Category Shares": result.categories,
                        "Categorical Stats": result.categorical, "Correlations": result.correlations,
                        "Summary": result.overall}, path)
        overall = self.spark.read.parquet(f"{path}/summary").first()
        runs.append(self.spark, self.root, "validations", {
            "id": report_id, "generation_id": run_id, "dataset_id": state["dataset_id"], "overall": tuple(overall),
            "report_path": path})
        return runs.report_for(runs.read(self.spark, self.root, "validations"), run_id)

    def privacy(self, run_id: str, force: bool = False) -> DataFrame:
        """The stored privacy row of a run; computed if there is none or ``force``."""
        log = runs.read(self.spark, self.root, "privacy_checks")
        if not force:
            found = runs.report_for(log, run_id)
            if not found.isEmpty():
                return found
        source, synthetic, state = self._pair(run_id)
        report, pairs = compare.privacy(_numbered(source), _numbered(synthetic), "_number")
        report_id = new_id()
        path = f"{self.root}/reports/{report_id}"
        write_sections({"Privacy Checks": report, "Near Duplicate Pairs": pairs}, path)
        row = self.spark.read.parquet(f"{path}/privacy_checks").first()
        runs.append(self.spark, self.root, "privacy_checks", {
            "id": report_id, "generation_id": run_id, "dataset_id": state["dataset_id"],
            "exact_duplicates": row["exact_duplicates"], "near_duplicates": row["near_duplicates"],
            "risk_level": row["risk_level"], "report_path": path})
        return runs.report_for(runs.read(self.spark, self.root, "privacy_checks"), run_id)


def _numbered(df: DataFrame) -> DataFrame:
    """Rows numbered by their content, so that the numbers do not depend on how files are packed."""
    return dense_index(df, [F.xxhash64(*[ref(c).cast("string") for c in df.columns])], "_number")


def synthetic_rows(model: synth.Model, n: int, requirements: Sequence[Requirement] = (), seed: int = 42,
                   joint: bool = False) -> DataFrame:
    """``n`` synthetic rows, numbered by ``_row``, in the requested proportions.

    Synthetic row i can be computed from i, so the pool is never written: the columns that requirements
    look at are computed for the whole pool, resampled as numbers, and full rows computed for what is kept.
    """
    if not requirements:
        return synth.sample(model, n)
    pool = model.source.sparkSession.range(synth.pool_size(n)).select(F.col("id").alias("_pool"))
    features = list(dict.fromkeys(r.feature for r in requirements if r.feature in model.columns))
    narrow = synth.rows_for(model, pool, "_pool", features)
    picked = (cohort.joint_keys if joint else cohort.resampled_keys)(narrow, "_pool", n, requirements, seed)
    return synth.rows_for(model, picked, "_pool").drop("_pool")
