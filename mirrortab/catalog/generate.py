"""Cohort control and synthesis."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mirrortab.catalog.registry import FLAGS, MEASURES, query, rounded, sides, table
from mirrortab.catalog.tables import KINDS_SQL, levelled
from mirrortab.functions.draws import LINEAR_SPAN, linear_index, linear_score
from mirrortab.operators import classify as cl, cohort as ch, profile as pf, synth
from mirrortab.operators.ordering import dense_index, shared_folder
from mirrortab.operators.predicates import Requirement
from mirrortab.operators.prepare import dates_to_ordinals
from mirrortab.plans.generate import Workbench, synthetic_rows
from mirrortab.sources import runs
from mirrortab.sources.demo import patients_for

BUILDING = Requirement("c_mktsegment", "equal", "BUILDING", 0.4)
SOLVENT = Requirement("c_acctbal", "gte", 5000, 0.3)
COLUMNS_SQL = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _step_sql(pool: str, order: str, test: str, share: float, name: str) -> str:
    """One requirement: draws by plain arithmetic, joined to the numbered strata of the pool."""
    return f"""{name}_n AS (SELECT count(*) AS n, CAST(round({share} * count(*)) AS BIGINT) AS n1 FROM customer),
{name}_p AS (SELECT *, {test} AS ok, row_number() OVER (PARTITION BY {test} ORDER BY {order}) - 1 AS pos,
  count(*) OVER (PARTITION BY {test}) AS size FROM {pool}),
{name}_s AS (SELECT n, n1, min(k) AS step FROM (SELECT n, n1, unnest(range(n * 618 // 1000 + 1, n * 618 // 1000 + 1000)) AS k FROM {name}_n)
  WHERE gcd(k, n) = 1 GROUP BY n, n1),
{name}_d AS (SELECT i, t < n1 AS ok, CASE WHEN t < n1 THEN t ELSE t - n1 END AS j
  FROM (SELECT i, n1, CASE WHEN n1 > 0 AND n1 < n THEN i * step % n ELSE i END AS t FROM {name}_s, range(n) r(i))),
{name} AS (SELECT d.i AS _row, {COLUMNS_SQL} FROM {name}_d d JOIN {name}_p p ON p.ok = d.ok AND p.pos = (d.j * 48271 + 12345) % p.size)"""


def resampled(spark, folder, requirements):
    c = table(spark, folder, "customer")
    return ch.resample(c, "c_custkey", c.count(), requirements, draw=linear_index, score=linear_score, score_span=LINEAR_SPAN)


ONE_STEP_SQL = _step_sql("customer", "c_custkey", "c_mktsegment = 'BUILDING'", 0.4, "a")
TWO_STEP_SQL = f"{ONE_STEP_SQL}, {_step_sql('a', '_row', 'c_acctbal >= 5000', 0.3, 'b')}"


@query("stratified_resample", f"WITH {ONE_STEP_SQL} SELECT _row, {COLUMNS_SQL} FROM a")
def stratified_resample(spark, folder):
    return resampled(spark, folder, [BUILDING]).select("_row", *COLUMNS_SQL.split(", "))


@query("cohort_sequence", f"WITH {TWO_STEP_SQL} SELECT _row, {COLUMNS_SQL} FROM b")
def cohort_sequence(spark, folder):
    wanted = [BUILDING, Requirement("no_such_column", "equal", 1, 0.5), SOLVENT]
    return resampled(spark, folder, wanted).select("_row", *COLUMNS_SQL.split(", "))


@query("cohort_joint", """WITH c AS (SELECT c_mktsegment = 'BUILDING' AS building, c_acctbal >= 5000 AS solvent FROM customer),
t AS (SELECT count(*) AS n, 0.4::DOUBLE AS p, 0.3::DOUBLE AS q, count(*) FILTER (building AND solvent)::DOUBLE * count(*) FILTER (NOT building AND NOT solvent)
  / (count(*) FILTER (building AND NOT solvent) * count(*) FILTER (NOT building AND solvent)) AS odds FROM c),
b AS (SELECT *, 1 - p - q + odds * (p + q) AS b FROM t), x AS (SELECT *, 2 * odds * p * q / (b + sqrt(b * b + 4 * (1 - odds) * odds * p * q)) AS x FROM b),
s AS (SELECT n, unnest([true, true, false, false]) AS building, unnest([true, false, true, false]) AS solvent, n * unnest([x, p - x, q - x, 1 - p - q + x]) AS exact FROM x),
r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC) AS place, n - sum(floor(exact)) OVER () AS spare FROM s)
SELECT building, solvent, CAST(floor(exact) + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS rows FROM r""")
def cohort_joint(spark, folder):
    """Both proportions at once: rows of each combination, which keep the odds ratio of the customers."""
    c = table(spark, folder, "customer")
    out = ch.resample(c, "c_custkey", c.count(), [BUILDING, SOLVENT], joint=True)
    return out.groupBy((F.col("c_mktsegment") == "BUILDING").alias("building"), (F.col("c_acctbal") >= 5000).alias("solvent")).agg(F.count(F.lit(1)).alias("rows"))


@query("bootstrap_sample", f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer)
SELECT i AS _row, {COLUMNS_SQL} FROM (SELECT count(*) AS m FROM customer), range(m) t(i) JOIN p ON pos = (i * 48271 + 12345) % n""")
def bootstrap_sample(spark, folder):
    return resampled(spark, folder, []).select("_row", *COLUMNS_SQL.split(", "))


@query("trim_pad", f"""WITH n AS (SELECT count(*) AS n, count(*) // 3 AS few, count(*) + count(*) // 2 AS many FROM customer),
few AS (SELECT c_custkey FROM customer ORDER BY (c_custkey * 48271 + 12345) % 2147483647, c_custkey LIMIT (SELECT few FROM n)),
p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT 'trimmed' AS kind, row_number() OVER (ORDER BY c_custkey) - 1 AS _row, c_custkey FROM few
UNION ALL SELECT 'padded', pos, c_custkey FROM p
UNION ALL SELECT 'padded', n + i, c_custkey FROM n, range(many - n) t(i) JOIN p ON pos = (i * 48271 + 12345) % n""")
def trim_pad(spark, folder):
    keys = table(spark, folder, "customer").select(F.col("c_custkey").alias("_key"))
    n = keys.count()
    def cut(kind, size):
        out = ch.trimmed_or_padded(keys, size, draw=linear_index, score=linear_score, score_span=LINEAR_SPAN)
        return out.select(F.lit(kind).alias("kind"), "_row", F.col("_key").alias("c_custkey"))
    return cut("trimmed", n // 3).unionByName(cut("padded", n + n // 2))


REPORT_SQL = """SELECT CAST({place} AS INTEGER) AS place, '{label}' AS label, round({target}::DOUBLE * 100, 2) AS requested_pct, round(p * 100, 2) AS generated_pct,
  round(abs({target} - p) * 100, 2) AS diff_pct, CASE WHEN round(abs({target} - p) * 100, 2) <= 5 THEN 'pass' ELSE 'warn' END AS status
FROM (SELECT count(*) FILTER ({test}) / count(*) AS p FROM {pool})"""


@query("cohort_report", f"WITH {TWO_STEP_SQL} " + " UNION ALL ".join([
    REPORT_SQL.format(place=0, label="c_mktsegment equal BUILDING", target=0.4, test="c_mktsegment = 'BUILDING'", pool="b"),
    REPORT_SQL.format(place=1, label="solvent", target=0.3, test="c_acctbal >= 5000", pool="b"),
    "SELECT 2, 'no_such_column equal 1', 50.0, NULL, NULL, 'column_missing'"]))
def cohort_report(spark, folder):
    named = Requirement("c_acctbal", "gte", 5000, 0.3, "solvent")
    wanted = [BUILDING, named, Requirement("no_such_column", "equal", 1, 0.5)]
    out = ch.cohort_report(resampled(spark, folder, wanted), wanted)
    return out.select("place", "label", "requested_pct", "generated_pct", "diff_pct", "status")


PRESET = {"older_patients_pct": 40, "diabetic_pct": 30, "activity_distribution": {"BUILDING": 50, "MACHINERY": 25, "FURNITURE": 25},
          "age_column": "age"}
PRESET_SQL = "(SELECT c_nationkey * 4 AS Age, c_acctbal >= 5000 AS Diabetes, c_mktsegment AS ActivityLevel FROM customer)"


@query("cohort_preset", " UNION ALL ".join([
    REPORT_SQL.format(place=0, label="Age ≥ 60", target=0.4, test="Age >= 60", pool=PRESET_SQL),
    REPORT_SQL.format(place=1, label="Diabetes = diabetic", target=0.3, test="Diabetes", pool=PRESET_SQL),
    REPORT_SQL.format(place=2, label="ActivityLevel = BUILDING", target=0.5, test="ActivityLevel = 'BUILDING'", pool=PRESET_SQL)]))
def cohort_preset(spark, folder):
    c = table(spark, folder, "customer").select((F.col("c_nationkey") * 4).alias("Age"), (F.col("c_acctbal") >= 5000).alias("Diabetes"),
                                                F.col("c_mktsegment").alias("ActivityLevel"))
    out = ch.cohort_report(c, ch.preset_requirements(c, PRESET))
    return out.select("place", "label", "requested_pct", "generated_pct", "diff_pct", "status")


@query("value_shares", """SELECT c_mktsegment AS value, round(count(*) / (SELECT count(*) FROM customer) * 100, 2) AS pct FROM customer GROUP BY 1""")
def value_shares(spark, folder):
    return ch.value_shares(table(spark, folder, "customer"), "c_mktsegment")


@query("validate_requirements", """
SELECT * FROM (VALUES (0, 'no_such', 'unknown column'), (1, 'value', 'not a number'), (2, 'value', 'lower bound not below upper'),
  (3, 'value', 'between needs two numbers'), (4, 'event_type', 'unknown value'), (5, 'level', 'target out of range'),
  (6, 'event_type', 'targets of one column exceed 150'), (4, 'event_type', 'targets of one column exceed 150')) t(place, feature, problem)
WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'sleeping')""")
def validate_requirements(spark, folder):
    t = levelled(spark, folder)
    wanted = [Requirement("no_such", "equal", 1, 0.2), Requirement("value", "gte", "many", 0.1),
              Requirement("value", "between", [30, 10], 0.1), Requirement("value", "between", [30], 0.1),
              Requirement("event_type", "equal", "sleeping", 0.9), Requirement("level", "equal", "Low", 1.2),
              Requirement("event_type", "equal", "error", 0.8)]
    kinds = cl.column_kinds(t)
    values = pf.cohort_profile_values(t, ["event_type", "is_error", "level"])
    return ch.validate_requirements(spark, wanted, kinds, values)


@query("operators_for_kind", f"""
WITH k AS ({KINDS_SQL}), u AS (SELECT unnest(['event_id', 'value', 'event_type', 'is_error', 'level']) AS "column",
  unnest([count(DISTINCT event_id), count(DISTINCT value), count(DISTINCT event_type), 2, 3]) AS unique_count FROM events)
SELECT "column", kind, CASE WHEN kind = 'numerical' THEN 'greater_than,gte,less_than,lte,equal,between'
  WHEN kind = 'binary' THEN 'equal,not_equal' WHEN kind = 'ordinal' THEN 'greater_than,gte,less_than,lte,equal,equal,not_equal'
  WHEN unique_count > 2 THEN 'equal,not_equal,in_values' ELSE 'equal,not_equal' END AS operators,
  CASE WHEN kind = 'numerical' THEN 'greater_than' ELSE 'equal' END AS default_operator FROM k JOIN u USING ("column")""")
def operators_for_kind(spark, folder):
    t = levelled(spark, folder)
    facts = pf.cohort_profile(t, ["event_id"], t.columns)
    out = ch.operators_for_kind(facts)
    return out.select("column", "kind", F.array_join("operators", ",").alias("operators"), "default_operator")


@query("pool_size", """SELECT c_nationkey, count(*) AS n, 3 * count(*) AS pool FROM customer GROUP BY c_nationkey""")
def pool_size(spark, folder):
    n = F.col("n")
    per = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return per.select("c_nationkey", "n", synth.pool_size(n).cast("bigint").alias("pool"))


@query("assign_synt_id", """SELECT 'SYN-' || CASE WHEN r < 1000000 THEN lpad(CAST(r AS VARCHAR), 6, '0') ELSE CAST(r AS VARCHAR) END AS synt_id, c_custkey,
  c_mktsegment FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)""")
def assign_synt_id(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return synth.with_subject_ids(dense_index(c, ["c_custkey"], "_row"))


GRID = [i / 16 for i in range(17)]


@query("copula_marginals", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {g}::DOUBLE AS share, round(quantile_cont({c}, {g}), 4) AS value FROM lineitem" for c in MEASURES for g in GRID))
def copula_marginals(spark, folder):
    return rounded(synth.copula_marginals(table(spark, folder, "lineitem"), MEASURES, GRID))


def _ready(spark, folder):
    return dates_to_ordinals(table(spark, folder, "lineitem").select(*MEASURES, *FLAGS, "l_shipdate"))


@query("copula_corr")
def copula_corr(spark, folder):
    """Correlation matrix of the normal scores."""
    model = synth.fit(_ready(spark, folder))
    matrix = model.mixing @ model.mixing.T
    rows = [(a, b, float(round(matrix[i, j], 4))) for i, a in enumerate(model.columns) for j, b in enumerate(model.columns) if i < j]
    return spark.createDataFrame(rows, "col_a string, col_b string, correlation double")


@query("synthesize")
def synthesize(spark, folder):
    """As many synthetic line items as there are real ones."""
    ready = _ready(spark, folder)
    return synth.sample(synth.fit(ready), ready.count())


@query("synthesize_cohort")
def synthesize_cohort(spark, folder):
    """Synthetic line items in requested proportions: first large quantities, then one flag."""
    ready = _ready(spark, folder)
    wanted = [Requirement("l_quantity", "gte", 40, 0.5), Requirement("l_returnflag", "equal", "A", 0.2)]
    return synthetic_rows(synth.fit(ready), ready.count(), wanted)


@query("model_fallback", """SELECT m AS asked, u AS used, (SELECT count(*) FROM customer) AS rows FROM
(VALUES ('gaussian_copula', 'gaussian_copula'), ('independent', 'independent'), ('bootstrap', 'bootstrap'), ('unheard_of', 'gaussian_copula')) t(m, u)""")
def model_fallback(spark, folder):
    c = table(spark, folder, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    n, out = c.count(), None
    for name in ("gaussian_copula", "independent", "bootstrap", "unheard_of"):
        model = synth.fit(c, name)
        rows = synth.sample(model, n).agg(F.count(F.lit(1)).alias("rows"))
        part = rows.select(F.lit(name).alias("asked"), F.lit(model.used).alias("used"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("generate", """SELECT 'done' AS status, 'gaussian_copula' AS model_used, (SELECT count(*) FROM customer) AS num_generated, 100 AS progress""")
def generate(spark, folder):
    """Register, clean, fit, sample, resample and write customers; the run log's last state."""
    bench = Workbench(spark, f"{shared_folder(spark)}/{uuid.uuid4()}")
    c = table(spark, folder, "customer")
    source = c.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    table_id = bench.register(source, "customers", "c_custkey")
    bench.preprocess(table_id)
    run_id = bench.generate(table_id, c.count(), requirements=[BUILDING])
    log = runs.read(spark, bench.root, "generations").where(F.col("id") == run_id)
    last = runs.latest(log, ["id"], [F.col("written_at")])
    return last.select("status", "model_used", "num_generated", "progress")


@query("demo_patients")
def demo_patients(spark, folder):
    """One demo patient per customer, summarised."""
    people = patients_for(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    return people.groupBy("Sex", "ActivityLevel", "Diabetes").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("Age"), 2).alias("age"), F.round(F.avg("HbA1c"), 2).alias("hba1c"))


@query("schema_of_sides", """SELECT unnest(['l_quantity', 'l_returnflag']) AS "column", 'common' AS status, unnest(['float', 'categorical']) AS left_type,
  unnest(['float', 'categorical']) AS right_type FROM (SELECT 1 FROM lineitem LIMIT 1)""")
def schema_of_sides(spark, folder):
    a, b = sides(spark, folder)
    return cl.schema_diff(a.select("l_quantity", "l_returnflag"), b.select("l_quantity", "l_returnflag"))
