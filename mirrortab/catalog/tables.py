"""Sources, sinks, run tables, schema rules."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from mirrortab import rules
from mirrortab.catalog.registry import VISITS_SQL, query, table, visits
from mirrortab.functions.values import as_number, finite_or, moment_from_text, normalised_name
from mirrortab.operators import classify as cl, profile as pf
from mirrortab.operators.ordering import shared_folder
from mirrortab.operators.view import chosen_columns
from mirrortab.sources import runs, tables as st


def _words(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


NORMAL_SQL = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
CLASS_SQL = f"""CASE WHEN n IN ({_words(rules.LINKAGE_KEY_NAMES)}) OR regexp_matches(n, '_key$') THEN 'longitudinal_key'
  WHEN n IN ({_words(rules.TEMPORAL_NAMES)}) OR regexp_matches(n, '(_date|_time|_at)$') OR regexp_matches(n, '^(date|time)_')
    THEN 'temporal'
  WHEN n IN ({_words(rules.HEALTH_NAMES)}) THEN 'sensitive_health'
  WHEN n IN ({_words(rules.DIRECT_ID_NAMES)}) THEN 'direct_identifier'
  WHEN n IN ({_words(rules.QUASI_ID_NAMES)}) THEN 'quasi_identifier'
  WHEN regexp_matches(n, 'number$') THEN 'direct_identifier'"""


@query("scan_csv", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part""")
def scan_csv(spark, folder):
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    st.export_csv(table(spark, folder, "part"), path)
    return st.read_table(spark, path, "csv")


@query("scan_csv_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv_text(spark, folder):
    """Texts of many lines, with quotes and commas, through CSV and back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    st.export_csv(table(spark, folder, "documents"), path)
    return st.read_table(spark, path, "csv")


@query("scan_csv_html", "SELECT page_id, url, html FROM pages")
def scan_csv_html(spark, folder):
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    st.export_csv(table(spark, folder, "pages"), path)
    return st.read_table(spark, path, "csv")


@query("export_columns", "SELECT p_name, p_partkey, p_size FROM part")
def export_columns(spark, folder):
    return chosen_columns(table(spark, folder, "part"), ["p_name", "no_such_column", "p_partkey", "p_size"])


@query("ingest_gate", """
SELECT unnest(['not_empty', 'has_columns', 'enough_rows']) AS rule,
       unnest([count(*) > 0, true, count(*) >= 10]) AS passed FROM orders""")
def ingest_gate(spark, folder):
    return st.gate_facts(table(spark, folder, "orders"))


@query("min_rows_gate", """
SELECT unnest(['not_empty', 'has_columns', 'enough_rows']) AS rule,
       unnest([count(*) > 0, true, count(*) >= 50]) AS passed FROM nation""")
def min_rows_gate(spark, folder):
    return st.gate_facts(table(spark, folder, "nation"), st.MIN_ROWS_MODEL)


@query("run_latest", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""")
def run_latest(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return runs.latest(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("report_lookup", """
SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, count(*) AS versions
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def report_lookup(spark, folder):
    done = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    newest = runs.latest(done, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    versions = done.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("versions"))
    return newest.join(versions, "o_custkey").select("o_custkey", "o_totalprice", "versions")


@query("latest_runs", """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def latest_runs(spark, folder):
    o = table(spark, folder, "orders")
    top = runs.newest_runs(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderstatus") == "O")
    return top.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


@query("run_status", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.note'), '') AS note
FROM events""")
def run_status(spark, folder):
    e = table(spark, folder, "events")
    parsed = runs.parsed(F.col("props"), "k bigint, note string")
    return e.select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["note"], F.lit("")).alias("note"))


@query("dataset_record", f"""
WITH v AS ({VISITS_SQL}) SELECT * FROM (
  SELECT 'patient_id' AS "column", 'longitudinal_key' AS category, count(*) - count(patient_id) AS missing_count,
         count(DISTINCT patient_id) AS unique_count FROM v UNION ALL
  SELECT 'pain_score', 'sensitive_health', count(*) - count(pain_score), count(DISTINCT pain_score) FROM v UNION ALL
  SELECT 'visit_date', 'temporal', count(*) - count(visit_date), count(DISTINCT visit_date) FROM v UNION ALL
  SELECT 'visit_no', 'clinical', count(*) - count(visit_no), count(DISTINCT visit_no) FROM v UNION ALL
  SELECT 'visit_type', 'sensitive_health', count(*) - count(visit_type), count(DISTINCT visit_type) FROM v)""")
def dataset_record(spark, folder):
    """Land a table, read it back, record its profile and classes in the run log, read the record."""
    root = f"{shared_folder(spark)}/{uuid.uuid4()}"
    table_id, _ = st.land(visits(spark, folder), root)
    landed = st.read_landed(spark, root, "raw", table_id)
    facts = pf.profile(landed, ["visit_no"])
    classes = cl.classes_of_schema(landed)
    columns = [(r["column"], r["dtype"], r["missing_count"], r["unique_count"], classes[r["column"]])
               for r in facts.select("column", "dtype", "missing_count", "unique_count").collect()]
    runs.append(spark, root, "datasets", {"id": table_id, "name": "visits", "columns": columns, "status": "uploaded",
                                          "written_at": dt.datetime.now(dt.timezone.utc)})
    record = runs.latest(runs.read(spark, root, "datasets"), ["id"], [F.col("written_at")])
    rows = record.select(F.inline("columns"))
    return rows.select("column", "category", "missing_count", "unique_count")


@query("normalise_names", f"""
SELECT DISTINCT 'part' AS kind, {NORMAL_SQL.format(c='p_name')} AS name FROM part UNION ALL
SELECT DISTINCT 'customer', {NORMAL_SQL.format(c='c_name')} FROM customer UNION ALL
SELECT DISTINCT 'url', {NORMAL_SQL.format(c='url')} FROM pages""")
def normalise_names(spark, folder):
    def names(t, column, kind):
        return table(spark, folder, t).select(F.lit(kind).alias("kind"), normalised_name(F.col(column)).alias("name")).distinct()
    return (names("part", "p_name", "part").unionByName(names("customer", "c_name", "customer"))
            .unionByName(names("pages", "url", "url")))


@query("classify_columns", f"""
WITH v AS ({VISITS_SQL}),
facts AS (SELECT count(DISTINCT text) > 0.8 * count(text)
            AND bool_or(contains(text, '@')) AS mail
          FROM documents),
names(c, m) AS (
  SELECT unnest(['visit_no', 'patient_id', 'visit_date', 'visit_type', 'pain_score', 'doc_id', 'lang', 'source', 'n_chars']), false
  UNION ALL SELECT 'text', mail FROM facts),
cls AS (SELECT c, m, {NORMAL_SQL.format(c='c')} AS n FROM names),
done AS (SELECT c AS "column", {CLASS_SQL} WHEN m THEN 'direct_identifier' ELSE 'clinical' END AS category FROM cls)
SELECT "column", category, category IN ('direct_identifier', 'longitudinal_key') AS excluded_from_modeling FROM done""")
def classify_columns(spark, folder):
    first = cl.classify(visits(spark, folder))
    second = cl.classify(table(spark, folder, "documents"))
    return first.unionByName(second).select("column", "category", "excluded_from_modeling")


@query("classify_names", f"""
WITH names AS (SELECT DISTINCT p_name || '_key' AS c FROM part UNION SELECT DISTINCT p_type || ' Date' FROM part
  UNION SELECT DISTINCT lower(role) || '-number' FROM conversations UNION SELECT DISTINCT 'pain ' || replace(event_type, 'view', 'score') FROM events
  UNION SELECT DISTINCT lang FROM documents UNION SELECT DISTINCT c_mktsegment FROM customer),
cls AS (SELECT c, {NORMAL_SQL.format(c='c')} AS n FROM names)
SELECT c AS "column", {CLASS_SQL} ELSE 'clinical' END AS category FROM cls""")
def classify_names(spark, folder):
    """The name rules on a table of names, as a catalog with very many columns would use them."""
    def names(t, c):
        return table(spark, folder, t).select(c.alias("column"))
    every = (names("part", F.concat("p_name", F.lit("_key"))).union(names("part", F.concat("p_type", F.lit(" Date"))))
             .union(names("conversations", F.concat(F.lower("role"), F.lit("-number"))))
             .union(names("events", F.concat(F.lit("pain "), F.replace("event_type", F.lit("view"), F.lit("score")))))
             .union(names("documents", F.col("lang"))).union(names("customer", F.col("c_mktsegment")))).distinct()
    return every.select("column", cl.class_of_name(F.col("column")).alias("category"))


@query("sensitive_columns", f"""
WITH names(c) AS (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice',
  'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate'])),
cls AS (SELECT c, {NORMAL_SQL.format(c='c')} AS n FROM names)
SELECT c AS "column" FROM (SELECT c, {CLASS_SQL} ELSE 'clinical' END AS k FROM cls) WHERE k = 'direct_identifier'""")
def sensitive_columns(spark, folder):
    return cl.sensitive_columns(cl.classify(table(spark, folder, "lineitem")))


def _mail_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(DISTINCT {column}) > 0.8 * count({column})
      AND bool_or(contains({column}, '@')) AS mail_like FROM documents"""


@query("email_like", f"{_mail_sql('text')} UNION ALL {_mail_sql('lang')} UNION ALL {_mail_sql('source')}")
def email_like(spark, folder):
    return cl.mail_like(table(spark, folder, "documents"))


@query("infer_types", f"""
SELECT * FROM (VALUES ('event_id', 'integer'), ('shown_day', 'datetime'), ('event_type', 'categorical'),
  ('value', 'float'), ('ts', 'datetime'), ('is_error', 'boolean')) t("column", dtype)
WHERE (SELECT count(*) FROM events) > 0
  AND (SELECT avg(CASE WHEN try_strptime(d, '%Y-%m-%d') IS NOT NULL THEN 1 ELSE 0 END) FROM
       (SELECT strftime(ts, '%Y-%m-%d') AS d FROM events)) > 0.8""")
def infer_types(spark, folder):
    e = table(spark, folder, "events")
    shown = e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("shown_day"), "event_type", "value", "ts",
                     (F.col("event_type") == "error").alias("is_error"))
    return cl.infer_types(shown).select("column", "dtype")


KINDS_SQL = """
WITH t AS (SELECT event_id, value, event_type, event_type = 'error' AS is_error,
  CASE WHEN value < 30 THEN 'Low' WHEN value < 60 THEN 'Medium' ELSE 'High' END AS level FROM events),
d AS (SELECT count(DISTINCT event_type) AS a, count(DISTINCT is_error) AS b, count(DISTINCT level) AS c,
  bool_and(lower(level) IN ('low', 'medium', 'high')) AS o FROM t)
SELECT unnest(['event_id', 'value', 'event_type', 'is_error', 'level']) AS "column",
  unnest(['integer', 'float', 'categorical', 'boolean', 'categorical']) AS dtype,
  unnest(['numerical', 'numerical', CASE WHEN a = 2 THEN 'binary' ELSE 'categorical' END,
          CASE WHEN b = 2 THEN 'binary' ELSE 'categorical' END,
          CASE WHEN c = 2 THEN 'binary' WHEN o THEN 'ordinal' ELSE 'categorical' END]) AS kind FROM d"""


def levelled(spark, folder):
    e = table(spark, folder, "events")
    level = F.when(F.col("value") < 30, "Low").when(F.col("value") < 60, "Medium").otherwise("High")
    return e.select("event_id", "value", "event_type", (F.col("event_type") == "error").alias("is_error"), level.alias("level"))


@query("column_kinds", KINDS_SQL)
def column_kinds(spark, folder):
    return cl.column_kinds(levelled(spark, folder))


@query("model_metadata", f"""
SELECT "column", CASE WHEN dtype = 'boolean' THEN 'boolean' WHEN kind = 'numerical' THEN 'numerical' ELSE 'categorical' END
  AS model_type FROM ({KINDS_SQL})""")
def model_metadata(spark, folder):
    return cl.model_types(cl.column_kinds(levelled(spark, folder)))


@query("approved_columns", f"""
WITH v AS ({VISITS_SQL}) SELECT visit_date, pain_score FROM v""")
def approved_columns(spark, folder):
    v = visits(spark, folder)
    classes = cl.classes_of_schema(v)
    barred = [c for c in v.columns if classes[c] in (cl.DIRECT, cl.LINKAGE)]
    kept, _ = cl.approved_columns(v.columns, ["patient_id", "visit_date", "pain_score"], barred)
    return v.select(*kept)


@query("schema_diff", f"""
WITH a("column", left_type) AS (SELECT column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer'
    WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'categorical' END
  FROM (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name,
    unnest([typeof(o_orderkey), typeof(o_custkey), typeof(o_orderstatus), typeof(o_totalprice), typeof(o_orderdate),
      typeof(o_orderpriority)]) AS data_type FROM (SELECT * FROM orders LIMIT 1))),
b("column", right_type) AS (VALUES ('o_orderkey', 'integer'), ('o_totalprice', 'categorical'), ('note', 'categorical'))
SELECT coalesce(a."column", b."column") AS "column", CASE WHEN right_type IS NULL THEN 'missing'
  WHEN left_type IS NULL THEN 'extra' ELSE 'common' END AS status, left_type, right_type
FROM a FULL JOIN b ON a."column" = b."column" """)
def schema_diff(spark, folder):
    o = table(spark, folder, "orders")
    other = o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), F.lit("x").alias("note"))
    return cl.schema_diff(o, other)


@query("safe_float", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0.0 WHEN l_tax = 0 THEN 0.0
  ELSE round(l_extendedprice / l_discount, 4) END AS ratio FROM lineitem""")
def safe_float(spark, folder):
    li = table(spark, folder, "lineitem")
    raw = (F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan")))
           .otherwise(F.col("l_extendedprice") / F.nullif(F.col("l_discount"), F.lit(0.0))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(finite_or(raw, F.lit(0.0)), 4).alias("ratio"))


@query("coerce_numeric", """
SELECT doc_id, TRY_CAST(regexp_extract(source, '[0-9]+') AS DOUBLE) AS origin, CAST(n_chars AS DOUBLE) AS n_chars,
  CASE WHEN lang = 'en' THEN 1::DOUBLE ELSE 0::DOUBLE END AS is_english, CAST(NULL AS DOUBLE) AS lang FROM documents""")
def coerce_numeric(spark, folder):
    d = table(spark, folder, "documents").select(
        "doc_id", F.regexp_extract("source", "[0-9]+", 0).alias("origin"), "n_chars",
        (F.col("lang") == "en").alias("is_english"), "lang")
    return d.select("doc_id", *[as_number(d, c).alias(c) for c in ("origin", "n_chars", "is_english", "lang")])


@query("parse_dates", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS a,
  CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS b, CAST(NULL AS TIMESTAMP) AS c FROM orders""")
def parse_dates(spark, folder):
    o = table(spark, folder, "orders")
    texts = o.select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("a"),
                     F.date_format("o_orderdate", "MMM d, yyyy").alias("b"), F.col("o_orderpriority").alias("c"))
    return texts.select("o_orderkey", *[moment_from_text(F.col(c)).cast("timestamp_ntz").alias(c) for c in "abc"])
