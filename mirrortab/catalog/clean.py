"""Cleaning and model preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirrortab.catalog.registry import GAPPY_SQL, ORDINAL_SQL, VISITS_SQL, gappy, query, table, visits
from mirrortab.operators import clean as cn, prepare as pr
from mirrortab.operators.classify import LINKAGE


@query("dedupe", """
SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY text, lang""")
def dedupe(spark, folder):
    return cn.drop_duplicates(table(spark, folder, "documents").select("text", "lang", "doc_id"), "doc_id")


@query("dedupe_count", """
SELECT count(*) AS rows_before, count(DISTINCT (text, lang)) AS rows_after, count(*) - count(DISTINCT (text, lang))
  AS duplicates_removed FROM documents""")
def dedupe_count(spark, folder):
    d = table(spark, folder, "documents").select("text", "lang", "doc_id")
    after = cn.drop_duplicates(d, "doc_id").agg(F.count(F.lit(1)).alias("rows_after"))
    before = d.count()
    return after.select(F.lit(before).cast("bigint").alias("rows_before"), "rows_after",
                        (F.lit(before) - F.col("rows_after")).alias("duplicates_removed"))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = ", ".join(KEYS)


@query("impute_median", f"""
WITH g AS ({GAPPY_SQL}), m AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM g)
SELECT {KEYS_SQL}, coalesce(l_quantity, m) AS l_quantity FROM g, m""")
def impute_median(spark, folder):
    return cn.fill_median(gappy(spark, folder).select(*KEYS, "l_quantity"), ["l_quantity"])


@query("impute_mode", f"""
WITH g AS ({GAPPY_SQL}), m AS (SELECT l_returnflag AS v FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, l_returnflag LIMIT 1)
SELECT {KEYS_SQL}, coalesce(l_returnflag, v) AS l_returnflag FROM g, m""")
def impute_mode(spark, folder):
    return cn.fill_mode(gappy(spark, folder).select(*KEYS, "l_returnflag"), ["l_returnflag"])


VISIT_GAPS_SQL = f"""SELECT visit_no, CASE WHEN visit_type <> 'error' AND pain_score >= 10 THEN visit_date END AS visit_date,
  CASE WHEN visit_type <> 'click' THEN visit_type END AS visit_type FROM ({VISITS_SQL})"""


def visit_gaps(spark, folder):
    v = visits(spark, folder)
    return v.select("visit_no", F.when((F.col("visit_type") != "error") & (F.col("pain_score") >= 10), F.col("visit_date"))
                    .alias("visit_date"), F.when(F.col("visit_type") != "click", F.col("visit_type")).alias("visit_type"))


@query("impute_ffill_bfill", f"""
WITH v AS ({VISIT_GAPS_SQL}) SELECT visit_no,
  coalesce(last_value(visit_date IGNORE NULLS) OVER a, first_value(visit_date IGNORE NULLS) OVER b) AS visit_date,
  coalesce(last_value(visit_type IGNORE NULLS) OVER a, first_value(visit_type IGNORE NULLS) OVER b) AS visit_type
FROM v WINDOW a AS (ORDER BY visit_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (ORDER BY visit_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def impute_ffill_bfill(spark, folder):
    return cn.fill_along(visit_gaps(spark, folder), ["visit_date", "visit_type"], "visit_no")


@query("missing_handled", f"""
WITH g AS ({GAPPY_SQL}) SELECT unnest(['l_quantity', 'l_returnflag', 'l_shipdate']) AS "column",
  unnest([count(*) - count(l_quantity), count(*) - count(l_returnflag), count(*) - count(l_shipdate)]) AS missing FROM g""")
def missing_handled(spark, folder):
    return cn.missing_handled(gappy(spark, folder))


@query("cast_boolean", """
SELECT c_custkey, c_acctbal >= 0 AS solvent, CASE WHEN c_nationkey <> 3 THEN c_nationkey > 10 END AS far, c_mktsegment FROM customer""")
def cast_boolean(spark, folder):
    c = table(spark, folder, "customer")
    words = c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, "Yes").otherwise("no").alias("solvent"),
                     F.when(F.col("c_nationkey") != 3, F.when(F.col("c_nationkey") > 10, "1").otherwise("0")).alias("far"),
                     "c_mktsegment")
    return cn.cast_booleans(words)


@query("cast_dates", """
SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ordered, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS TIMESTAMP) END AS promised,
  o_orderpriority FROM orders""")
def cast_dates(spark, folder):
    o = table(spark, folder, "orders")
    texts = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"),
                     F.when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "M/d/yyyy")).alias("promised"),
                     "o_orderpriority")
    out = cn.cast_dates(texts, ["o_orderkey"])
    return out.select("o_orderkey", F.col("ordered").cast("timestamp_ntz").alias("ordered"),
                      F.col("promised").cast("timestamp_ntz").alias("promised"), "o_orderpriority")


@query("cast_dates_mixed", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS mixed FROM orders""")
def cast_dates_mixed(spark, folder):
    """Half of the values are dates, so all stay as they are."""
    o = table(spark, folder, "orders")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    return cn.cast_dates(o.select("o_orderkey", mixed.alias("mixed")), ["o_orderkey"])


VISIT_TABLE_SQL = f"""SELECT visit_no, patient_id, strftime(visit_date, '%Y-%m-%d') AS day,
  CASE WHEN visit_type <> 'click' THEN visit_type END AS kind, CASE WHEN pain_score >= 20 THEN pain_score END AS pain,
  CASE WHEN visit_type = 'error' THEN 'yes' ELSE 'no' END AS failed FROM ({VISITS_SQL})"""
PREPROCESS_SQL = f"""
WITH v AS ({VISIT_TABLE_SQL}),
d AS (SELECT min(visit_no) AS visit_no, day, kind, pain, failed FROM v GROUP BY day, kind, pain, failed),
m AS (SELECT quantile_cont(pain, 0.5) AS pain FROM d),
k AS (SELECT kind FROM d WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"""


def visit_table(spark, folder):
    v = visits(spark, folder)
    return v.select("visit_no", "patient_id", F.date_format("visit_date", "yyyy-MM-dd").alias("day"),
                    F.when(F.col("visit_type") != "click", F.col("visit_type")).alias("kind"),
                    F.when(F.col("pain_score") >= 20, F.col("pain_score")).alias("pain"),
                    F.when(F.col("visit_type") == "error", "yes").otherwise("no").alias("failed"))


@query("preprocess", f"""{PREPROCESS_SQL}
SELECT CAST(day AS TIMESTAMP) AS day, coalesce(d.kind, k.kind) AS visit_kind, coalesce(d.pain, m.pain) AS pain,
  failed = 'yes' AS failed FROM d, m, k""")
def preprocess(spark, folder):
    cleaned, _ = cn.preprocess(visit_table(spark, folder), ["day", "kind", "pain", "failed"], "visit_no", {"kind": "visit_kind"})
    return cleaned.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("preprocess_summary", f"""{PREPROCESS_SQL}
SELECT (SELECT count(*) FROM v) AS rows_before, count(*) AS rows_after, (SELECT count(*) FROM v) - count(*) AS duplicates_removed,
  'visit_kind=' || (count(*) - count(kind)) || ',pain=' || (count(*) - count(pain)) AS missing_handled,
  'day,visit_kind,pain,failed' AS columns_included, 'patient_id' AS columns_excluded FROM d""")
def preprocess_summary(spark, folder):
    _, s = cn.preprocess(visit_table(spark, folder), ["day", "kind", "pain", "failed"], "visit_no", {"kind": "visit_kind"})
    shown = F.transform("missing_handled", lambda m: F.concat(m["column"], F.lit("="), m["missing"].cast("string")))
    return s.select("rows_before", "rows_after", "duplicates_removed", F.array_join(shown, ",").alias("missing_handled"),
                    F.array_join("columns_included", ",").alias("columns_included"),
                    F.array_join("columns_excluded", ",").alias("columns_excluded"))


@query("strip_identifiers", "SELECT * EXCLUDE (l_linenumber) FROM lineitem")
def strip_identifiers(spark, folder):
    return pr.strip_identifiers(table(spark, folder, "lineitem"))


@query("pseudonymise_key", f"""
WITH v AS ({VISITS_SQL}), f AS (SELECT patient_id, row_number() OVER (ORDER BY min(visit_no)) AS timeline_id FROM v
  WHERE patient_id IS NOT NULL GROUP BY patient_id)
SELECT visit_no, timeline_id, visit_type, pain_score FROM v LEFT JOIN f USING (patient_id)""")
def pseudonymise_key(spark, folder):
    v = visits(spark, folder).select("visit_no", "patient_id", "visit_type", "pain_score")
    key = pr.columns_of_class(v, LINKAGE)[0]
    return pr.pseudonymise(v, key, ["visit_no"]).select("visit_no", "timeline_id", "visit_type", "pain_score")


@query("date_to_ordinal", f"SELECT l_orderkey, l_linenumber, l_partkey, {ORDINAL_SQL} AS l_shipdate_ordinal FROM lineitem")
def date_to_ordinal(spark, folder):
    return pr.dates_to_ordinals(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"))


@query("date_string_to_ordinal", f"""
SELECT visit_no, CAST(date_diff('day', DATE '1970-01-01', CAST(visit_date AS DATE)) + 719163 AS BIGINT) AS day, visit_type
FROM ({VISITS_SQL})""")
def date_string_to_ordinal(spark, folder):
    v = visits(spark, folder).select("visit_no", F.date_format("visit_date", "dd MMM yyyy").alias("day"), "visit_type")
    return pr.date_strings_to_ordinals(v, ["visit_no"])


@query("numeric_strings", """
SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS DOUBLE) AS origin, lang FROM documents""")
def numeric_strings(spark, folder):
    d = table(spark, folder, "documents")
    return pr.numeric_strings(d.select("doc_id", F.regexp_extract("source", "[0-9]+", 0).alias("origin"), "lang"))


@query("drop_all_null", "SELECT c_custkey, c_name FROM customer")
def drop_all_null(spark, folder):
    c = table(spark, folder, "customer")
    return pr.drop_all_null(c.select("c_custkey", F.when(F.col("c_custkey") < 0, F.col("c_acctbal")).alias("never"), "c_name"))


MODEL_READY_SQL = f"""
SELECT visit_type, pain_score, CAST(date_diff('day', DATE '1970-01-01', CAST(visit_date AS DATE)) + 719163 AS BIGINT) AS day,
  CAST(CAST(pain_score AS INTEGER) AS DOUBLE) AS whole_pain,
  CAST(date_diff('day', DATE '1970-01-01', CAST(visit_date AS DATE)) + 719163 AS BIGINT) AS visit_date_ordinal
FROM ({VISITS_SQL})"""


@query("model_ready", MODEL_READY_SQL)
def model_ready(spark, folder):
    v = visits(spark, folder)
    wide = v.select("visit_no", "patient_id", F.col("visit_type").alias("Phone Number"), "visit_date", "visit_type", "pain_score",
                    F.date_format("visit_date", "yyyy-MM-dd").alias("day"),
                    F.rint("pain_score").cast("int").cast("string").alias("whole_pain"),
                    F.when(F.col("visit_no") < 0, F.col("pain_score")).alias("empty"))
    return pr.model_ready(wide, ["visit_no"]).drop("visit_no")


@query("ordinal_to_date", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""")
def ordinal_to_date(spark, folder):
    o = pr.dates_to_ordinals(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"))
    return pr.ordinals_to_dates(o, ["o_orderdate_ordinal"])
