"""The workbench's own tables: what runs write, and what is read back."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from mirrortab.catalog.registry import MEASURES, query, sides, table
from mirrortab.operators import cohort as ch, validate as vd
from mirrortab.operators.ordering import shared_folder
from mirrortab.plans.generate import Workbench
from mirrortab.sources import runs
from mirrortab.sources.tables import read_landed


def _bench(spark) -> Workbench:
    return Workbench(spark, f"{shared_folder(spark)}/{uuid.uuid4()}")


@query("persist_clean", """WITH d AS (SELECT DISTINCT c_nationkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)
SELECT c_nationkey, coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM d)) AS c_acctbal, c_mktsegment FROM d""")
def persist_clean(spark, folder):
    """Customers with gaps, registered and cleaned; the cleaned table as another reader finds it."""
    c = table(spark, folder, "customer")
    source = c.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    bench = _bench(spark)
    table_id = bench.register(source, "customers", "c_custkey")
    bench.preprocess(table_id)
    log = runs.read(spark, bench.root, "datasets").where((F.col("id") == table_id) & F.col("preprocessed_path").isNotNull())
    return spark.read.parquet(runs.latest(log, ["id"], [F.col("written_at")]).first()["preprocessed_path"])


def _orders_run(spark, folder) -> tuple[Workbench, str, DataFrame]:
    """Orders, cleaned and sampled with replacement."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    bench = _bench(spark)
    table_id = bench.register(o, "orders", "o_orderkey")
    bench.preprocess(table_id)
    return bench, bench.generate(table_id, o.count(), "bootstrap"), o


READY_ORDERS = """SELECT DISTINCT o_totalprice, o_orderstatus, o_orderdate FROM orders"""


@query("persist_model_ready", f"""SELECT o_totalprice, o_orderstatus,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719163 AS BIGINT) AS o_orderdate_ordinal FROM ({READY_ORDERS})""")
def persist_model_ready(spark, folder):
    """The table that a run was fitted on, by the path in the run log."""
    bench, run_id, _ = _orders_run(spark, folder)
    state = runs.status(runs.read(spark, bench.root, "generations"), run_id)
    return spark.read.parquet(state["source_path"])


@query("synthetic_read_back", f"""SELECT s.o_orderstatus, n AS rows, rows AS source_rows, CAST(0 AS BIGINT) AS foreign_rows, true AS absent_fails FROM
  (SELECT count(*) AS n FROM orders), (SELECT o_orderstatus, count(*) AS rows FROM ({READY_ORDERS}) GROUP BY 1) s""")
def synthetic_read_back(spark, folder):
    """Rows of a sampled table as read back, those that its source does not hold, and that a table that is not there is an error."""
    bench, run_id, _ = _orders_run(spark, folder)
    ready, rows = read_landed(spark, bench.root, "model_ready", run_id), read_landed(spark, bench.root, "synthetic", run_id)
    try:
        read_landed(spark, bench.root, "synthetic", "no-such-run")
        fails = False
    except AnalysisException:
        fails = True
    facts = rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(
        rows.join(ready, ready.columns, "left_anti").agg(F.count(F.lit(1)).alias("foreign_rows")))
    return ready.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(facts).withColumn("absent_fails", F.lit(fails))


@query("run_states", """SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status, coalesce(arg_max(CASE WHEN value < 50 THEN CAST(floor(value) AS INTEGER)
  ELSE -1 END, (ts, event_id)), 0) AS progress FROM events GROUP BY user_id""")
def run_states(spark, folder):
    """Events as the log of one run per user: where each one stands."""
    e = table(spark, folder, "events")
    log = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "ts", "event_id",
                   F.when(F.col("value") < 50, F.floor("value").cast("int")).otherwise(-1).alias("progress"))
    return runs.states(log, [F.col("ts"), F.col("event_id")]).select("id", "status", "progress")


@query("demo_load", """SELECT count(*) AS num_rows, CAST(12 AS BIGINT) AS num_columns, true AS is_demo, 'uploaded' AS status, count(*) AS landed_rows,
  CAST(0 AS BIGINT) AS changed_rows FROM customer""")
def demo_load(spark, folder):
    """A demo table with a row per customer, loaded like any other: its record, and landed rows that differ from the made ones."""
    from mirrortab.sources.demo import patients_for
    n, bench = table(spark, folder, "customer").count(), _bench(spark)
    table_id = bench.register_demo(n)
    record = runs.latest(runs.read(spark, bench.root, "datasets").where(F.col("id") == table_id), ["id"], [F.col("written_at")])
    landed = read_landed(spark, bench.root, "raw", table_id)
    made = patients_for(spark.range(n), "id", bench.seed).withColumnRenamed("id", bench.order_by).select(landed.columns)
    changed = landed.exceptAll(made).agg(F.count(F.lit(1)).alias("changed_rows"))
    return record.select("num_rows", "num_columns", "is_demo", "status").crossJoin(
        landed.agg(F.count(F.lit(1)).alias("landed_rows"))).crossJoin(changed)


@query("request_check", """WITH s AS (SELECT c_mktsegment, round(count(*) / (SELECT count(*) FROM customer) * 100, 2) AS pct FROM customer GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS place, 'c_mktsegment equal ' || c_mktsegment AS label, pct AS generated_pct, 'pass' AS status,
  CAST(5 AS INTEGER) AS refused FROM s""")
def request_check(spark, folder):
    """Requests for the shares that customers have, as plain mappings: accepted and met; and how many malformed ones are refused."""
    c = table(spark, folder, "customer")
    shares = ch.value_shares(c, "c_mktsegment").orderBy("value").collect()
    good = [{"feature": "c_mktsegment", "operator": "equal", "value": r["value"], "target_proportion": r["pct"] / 100} for r in shares]
    first, refused = good[0], 0
    for requests, preset in [([{**first, "feature": ""}], None), ([{**first, "value": None}], None), ([{**first, "target_proportion": 1.01}], None),
                             ([], {"older_patients_pct": 101}), ([], {"activity_distribution": {"Low": 0}})]:
        try:
            ch.check_requests([*good, *requests], preset)
        except ValueError:
            refused += 1
    out = ch.cohort_report(c, ch.check_requests(good))
    return out.select("place", "label", "generated_pct", "status", F.lit(refused).alias("refused"))


@query("cohort_affected", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {str(c in ("l_quantity", "l_tax")).lower()} AS cohort_affected,
  count({c}) FILTER (l_shipdate < TIMESTAMP '1998-07-01') AS source_n, count({c}) FILTER (l_shipdate >= TIMESTAMP '1998-07-01') AS synth_n FROM lineitem""" for c in MEASURES))
def cohort_affected(spark, folder):
    """Which compared columns a request has touched."""
    a, b = sides(spark, folder)
    touched = ch.check_requests([{"feature": f, "operator": "gte", "value": 0, "target_proportion": 0.5} for f in ("l_quantity", "l_tax")])
    out = vd.numeric_comparison(a, b, MEASURES, cohort_columns=[r.feature for r in touched])
    return out.select("column", "cohort_affected", "source_n", "synth_n")
