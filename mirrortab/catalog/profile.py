"""Profiles, predicates, views."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from mirrortab.catalog.registry import GAPPY_SQL, VISITS_SQL, gappy, query, rounded, table, visits
from mirrortab.catalog.tables import levelled
from mirrortab.operators.pages import Pages
from mirrortab.operators import classify as cl, clean, profile as pf, view
from mirrortab.operators.cohort import measure_proportions
from mirrortab.operators.ordering import dense_index
from mirrortab.operators.predicates import Requirement, condition

GAPPY_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
GAPPY_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
GAPPY_TYPES = dict(zip(GAPPY_COLUMNS, ["integer"] * 4 + ["float"] * 4 + ["categorical"] * 2 + ["datetime"]))


def _profile_sql(c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", '{GAPPY_TYPES[c]}' AS dtype, count(*) - count({c}) AS missing_count, "
            f"round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS unique_count, "
            f"{'true' if c == 'l_linenumber' else 'false'} AS is_sensitive FROM g")


@query("profile", f"WITH g AS ({GAPPY_SQL}) " + " UNION ALL ".join(_profile_sql(c) for c in GAPPY_COLUMNS))
def profile(spark, folder):
    out = pf.profile(gappy(spark, folder), GAPPY_ORDER)
    return out.select("column", "dtype", "missing_count", "missing_pct", "unique_count", "is_sensitive")


def _samples_sql(c: str) -> str:
    shown = {"visit_date": "strftime(visit_date, '%Y-%m-%d')"}.get(c, f"CAST({c} AS VARCHAR)")
    return (f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY visit_no) - 1 AS INTEGER) AS place, "
            f"{shown} AS value FROM v WHERE {c} IS NOT NULL) WHERE place < 5")


@query("sample_values", f"WITH v AS ({VISITS_SQL}) " + " UNION ALL ".join(
    _samples_sql(c) for c in ("visit_no", "patient_id", "visit_type", "visit_date")))
def sample_values(spark, folder):
    v = visits(spark, folder).withColumn("visit_date", F.date_format("visit_date", "yyyy-MM-dd"))
    return cl.first_values(v, ["visit_no", "patient_id", "visit_type", "visit_date"], pf.SAMPLES, ["visit_no"])


LONGITUDINAL_SQL = f"""
WITH v AS ({VISITS_SQL}), s AS (SELECT patient_id, count(*) AS n FROM v GROUP BY patient_id),
k AS (SELECT count(*) AS unique_subjects, round(avg(n), 2) AS avg_obs_per_subject, max(n) AS max_obs_per_subject,
        count(*) FILTER (n > 1) AS repeated_subjects FROM s WHERE patient_id IS NOT NULL)
SELECT repeated_subjects > 0 AS is_longitudinal,
  CASE WHEN repeated_subjects > 0 THEN 'longitudinal' ELSE 'cross_sectional' END AS dataset_type,
  'patient_id' AS linkage_key, CASE WHEN repeated_subjects > 0 THEN 'visit_date' END AS temporal_column,
  unique_subjects, (SELECT count(*) FROM v) AS total_observations, avg_obs_per_subject, max_obs_per_subject,
  repeated_subjects FROM k"""


@query("longitudinal_info", LONGITUDINAL_SQL)
def longitudinal_info(spark, folder):
    v = visits(spark, folder)
    return pf.longitudinal_info(v, cl.classes_of_schema(v))


def _summary_sql(position: int, c: str, dtype: str, category: str) -> str:
    return (f"SELECT CAST({position} AS INTEGER) AS position, '{c}' AS \"column\", '{dtype}' AS dtype, count(*) - count({c}) AS missing_count, "
            f"count(DISTINCT {c}) AS unique_count, '{category}' AS category FROM v")


@query("dataset_summary", f"WITH v AS ({VISITS_SQL}), info AS ({LONGITUDINAL_SQL}), cols AS (" + " UNION ALL ".join([
    _summary_sql(0, "visit_no", "integer", "clinical"), _summary_sql(1, "patient_id", "integer", "longitudinal_key"),
    _summary_sql(2, "visit_date", "datetime", "temporal"), _summary_sql(3, "visit_type", "categorical", "sensitive_health"),
    _summary_sql(4, "pain_score", "float", "sensitive_health")]) + """)
SELECT cols.*, total_observations, dataset_type, linkage_key, unique_subjects FROM cols, info""")
def dataset_summary(spark, folder):
    v = visits(spark, folder)
    return pf.dataset_summary(v, ["visit_no"], cl.classes_of_schema(v))


@query("cohort_profile_num", """
SELECT 'l_quantity' AS "column", min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 4) AS mean,
  count(DISTINCT l_quantity) AS unique_count FROM lineitem UNION ALL
SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), round(avg(l_extendedprice), 4),
  count(DISTINCT l_extendedprice) FROM lineitem UNION ALL
SELECT 'l_linenumber', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE), round(avg(l_linenumber), 4),
  count(DISTINCT l_linenumber) FROM lineitem""")
def cohort_profile_num(spark, folder):
    li = table(spark, folder, "lineitem")
    return rounded(pf.cohort_profile_numeric(li, ["l_quantity", "l_extendedprice", "l_linenumber"]))


LEVELLED_SQL = """SELECT event_id, value, event_type, event_type = 'error' AS is_error,
  CASE WHEN value < 30 THEN 'Low' WHEN value < 60 THEN 'Medium' ELSE 'High' END AS level FROM events"""


@query("cohort_profile_cat", f"""
WITH t AS ({LEVELLED_SQL})
SELECT 'event_type' AS "column", event_type AS value, count(*) AS n, CAST(999 AS INTEGER) AS rank FROM t GROUP BY event_type
UNION ALL SELECT 'level', level, count(*), CAST(CASE level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS INTEGER)
FROM t GROUP BY level""")
def cohort_profile_cat(spark, folder):
    return pf.cohort_profile_values(levelled(spark, folder), ["event_type", "level"])


@query("ordinal_order", f"""
WITH t AS ({LEVELLED_SQL})
SELECT 'level' AS "column", string_agg(level, '<' ORDER BY CASE level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END)
  AS ordinal_order FROM (SELECT DISTINCT level FROM t)""")
def ordinal_order(spark, folder):
    out = pf.ordinal_order(levelled(spark, folder), ["level"])
    return out.select("column", F.array_join("ordinal_order", "<").alias("ordinal_order"))


@query("cohort_profile", f"""
WITH t AS ({LEVELLED_SQL}), d AS (SELECT count(DISTINCT event_type) AS a, count(DISTINCT is_error) AS b,
  count(DISTINCT level) AS c, count(DISTINCT value) AS v, min(value) AS lo, max(value) AS hi, round(avg(value), 4) AS mean FROM t)
SELECT 'value' AS "column", 'float' AS dtype, 'numerical' AS kind, lo AS min, hi AS max, mean, v AS unique_count FROM d
UNION ALL SELECT 'event_type', 'categorical', CASE WHEN a = 2 THEN 'binary' ELSE 'categorical' END, NULL, NULL, NULL, a FROM d
UNION ALL SELECT 'is_error', 'boolean', CASE WHEN b = 2 THEN 'binary' ELSE 'categorical' END, NULL, NULL, NULL, b FROM d
UNION ALL SELECT 'level', 'categorical', CASE WHEN c = 2 THEN 'binary' ELSE 'ordinal' END, NULL, NULL, NULL, c FROM d""")
def cohort_profile(spark, folder):
    return rounded(pf.cohort_profile(levelled(spark, folder), ["event_id"], ["value", "event_type", "is_error", "level"]))


@query("histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT 'l_extendedprice' AS "column", CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 4) AS low,
  round(lo + (b.bin + 1) * w, 4) AS high, coalesce(c.n, 0) AS count
FROM (SELECT unnest(range(10)) AS bin) b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin""")
def histogram(spark, folder):
    return rounded(pf.histogram(table(spark, folder, "lineitem"), ["l_extendedprice"]))


@query("category_counts", f"""
WITH g AS ({GAPPY_SQL}) SELECT coalesce(l_returnflag, 'Unknown') AS name, count(*) AS value FROM g GROUP BY 1""")
def category_counts(spark, folder):
    return pf.category_counts(gappy(spark, folder), "l_returnflag")


def _flags(df, key, tests):
    return df.select(*key, *[condition(df, f, op, v).alias(n) for n, f, op, v in tests])


@query("predicate_numeric", f"""
WITH g AS ({GAPPY_SQL}) SELECT l_orderkey, l_linenumber, l_partkey,
  coalesce(l_quantity > 25, false) AS gt, coalesce(l_quantity < 25, false) AS lt, coalesce(l_quantity >= 25, false) AS ge,
  coalesce(l_quantity <= 25, false) AS le, coalesce(l_quantity = 25, false) AS eq, coalesce(l_quantity <> 25, true) AS ne,
  coalesce(l_quantity BETWEEN 10 AND 20, false) AS bt, coalesce(l_quantity IN (1, 2, 3), false) AS one_of FROM g""")
def predicate_numeric(spark, folder):
    q = "l_quantity"
    return _flags(gappy(spark, folder), ["l_orderkey", "l_linenumber", "l_partkey"], [
        ("gt", q, "greater_than", 25), ("lt", q, "<", "25"), ("ge", q, "gte", 25), ("le", q, "<=", 25),
        ("eq", q, "equals", 25), ("ne", q, "!=", 25), ("bt", q, "between", [10, 20]), ("one_of", q, "in_values", [1, "2", 3])])


@query("predicate_boolean", """
SELECT event_id, e AS eq_yes, NOT e AS eq_no, NOT e AS ne_1, e AS one_of, e AS ge_1, true AS ge_0 FROM
(SELECT event_id, event_type = 'error' AS e FROM events)""")
def predicate_boolean(spark, folder):
    b = "is_error"
    return _flags(levelled(spark, folder), ["event_id"], [
        ("eq_yes", b, "equal", "yes"), ("eq_no", b, "eq", "No"), ("ne_1", b, "not_equal", 1),
        ("one_of", b, "in_values", ["1", "true", "yes", "1.0"]), ("ge_1", b, "gte", 1), ("ge_0", b, "gte", 0)])


@query("predicate_string", f"""
WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(lower(trim(l_returnflag)), 'nan') AS f FROM ({GAPPY_SQL}))
SELECT l_orderkey, l_linenumber, l_partkey, f = 'a' AS eq, f <> 'a' AS ne, f IN ('a', 'n') AS one_of, f = 'nan' AS missing,
  false AS between_text FROM g""")
def predicate_string(spark, folder):
    c = "l_returnflag"
    return _flags(gappy(spark, folder), ["l_orderkey", "l_linenumber", "l_partkey"], [
        ("eq", c, "equal", " A "), ("ne", c, "not_equal", "a"), ("one_of", c, "in_values", ["A", "N"]),
        ("missing", c, "=", "nan"), ("between_text", c, "between", [1, 2])])


@query("predicate_coerced", """
SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS DOUBLE) >= 10 AS ge,
  CAST(regexp_extract(source, '[0-9]+') AS DOUBLE) BETWEEN 3 AND 7 AS bt, false AS lang_ge FROM documents""")
def predicate_coerced(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.regexp_extract("source", "[0-9]+", 0).alias("origin"), "lang")
    return _flags(d, ["doc_id"], [("ge", "origin", "gte", 10), ("bt", "origin", "between", [3, 7]), ("lang_ge", "lang", "gte", 3)])


@query("measure_proportion", """
SELECT unnest([0, 1, 2, 3]) AS place, unnest([round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0 END), 6),
  round(avg(CASE WHEN c_acctbal >= 5000 THEN 1.0 ELSE 0 END), 6),
  round(avg(CASE WHEN c_nationkey IN (1, 2, 3) THEN 1.0 ELSE 0 END), 6), 0.0]) AS proportion FROM customer""")
def measure_proportion(spark, folder):
    shares = measure_proportions(table(spark, folder, "customer"), [
        Requirement("c_mktsegment", "equal", "building", 0.4), Requirement("c_acctbal", "gte", 5000, 0.3),
        Requirement("c_nationkey", "in_values", [1, 2, 3], 0.2), Requirement("missing", "equal", 1, 0.2)])
    return rounded(shares, 6)


@query("text_search", """
SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '(?i)RED|brand#1$')
  OR regexp_matches(p_name, '(?i)RED|brand#1$') OR regexp_matches(p_brand, '(?i)RED|brand#1$')""")
def text_search(spark, folder):
    return view.search(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand"), "RED|brand#1$")


@query("text_search_literal", """
SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'example.com') OR contains(lower(lang), 'example.com')
  OR contains(CAST(doc_id AS VARCHAR), 'example.com')""")
def text_search_literal(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return view.search(d, "Example.com", literal=True).select("doc_id", "lang")


SORT_SQL = "ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("sort_nulls_last", f"""
WITH g AS ({GAPPY_SQL}) SELECT row_number() OVER ({SORT_SQL}) AS place, l_orderkey, l_linenumber, l_quantity FROM g ORDER BY place""")
def sort_nulls_last(spark, folder):
    """All rows with their places in the sorted table."""
    order = [F.desc_nulls_last("l_quantity"), *GAPPY_ORDER]
    return dense_index(gappy(spark, folder), order, "place", start=1).select("place", "l_orderkey", "l_linenumber", "l_quantity")


@query("page", f"""
WITH g AS ({GAPPY_SQL}) SELECT l_orderkey, l_linenumber, l_quantity, (SELECT count(*) FROM g) AS total_rows FROM g
{SORT_SQL} LIMIT 50 OFFSET 100""")
def page(spark, folder):
    rows, total = view.page(gappy(spark, folder), 3, 50, "l_quantity", "desc", GAPPY_ORDER)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", F.lit(total.first()[0]).cast("bigint").alias("total_rows"))


@query("deep_page", f"""
WITH g AS ({GAPPY_SQL}), p AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER ({SORT_SQL}) AS place, count(*) OVER () AS total_rows FROM g)
SELECT l_orderkey, l_linenumber, l_quantity, total_rows FROM p WHERE place > total_rows // 60 * 50 AND place <= (total_rows // 60 + 1) * 50""")
def deep_page(spark, folder):
    """A page behind five sixths of the rows, through the index of the sorted table."""
    sorted_table = Pages.build(gappy(spark, folder), "l_quantity", "desc", GAPPY_ORDER)
    rows = sorted_table.page(sorted_table.total // 60 + 1, 50)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", F.lit(sorted_table.total).cast("bigint").alias("total_rows"))


@query("rename_columns", "SELECT p_partkey AS part, p_name AS label, p_size FROM part")
def rename_columns(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return clean.rename_columns(p, {"p_partkey": "part", "p_name": "label", "no_such": "x"})
