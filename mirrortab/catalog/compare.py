"""Statistical validation and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirrortab.catalog.registry import (EARLY_DAY, FLAGS, MEASURES, ORDINAL_SQL, SOURCE_SQL, SYNTH_SQL, part_sides, query,
                                        ready_sides, rounded, sides, table, text_sides)
from mirrortab.functions.draws import LINEAR_SPAN, linear_score
from mirrortab.operators import privacy as pv, validate as vd
from mirrortab.operators.frequency import exact_quantiles
from mirrortab.plans import compare
from mirrortab.sources.report import long_report

READY = [*MEASURES, "l_shipdate_ordinal"]
READY_SQL = (f"src AS (SELECT {', '.join(MEASURES + FLAGS)}, {ORDINAL_SQL} AS l_shipdate_ordinal FROM ({SOURCE_SQL})), "
             f"syn AS (SELECT {', '.join(MEASURES + FLAGS)}, {ORDINAL_SQL} AS l_shipdate_ordinal FROM ({SYNTH_SQL}))")


def _moments(side: str, name: str, c: str) -> str:
    return (f"SELECT '{c}' AS c, count({c}) AS {name}_n, avg({c}) AS {name}_mean, stddev_samp({c}) AS {name}_std, "
            f"CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS {name}_median, CAST(min({c}) AS DOUBLE) AS {name}_min, "
            f"CAST(max({c}) AS DOUBLE) AS {name}_max, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS {name}_q25, "
            f"CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS {name}_q75 FROM {side}")


STATS = ["n", "mean", "std", "median", "min", "max", "q25", "q75"]


def stats_sql(columns) -> str:
    return ("ms AS (" + " UNION ALL ".join(_moments("src", "source", c) for c in columns) + "), my AS ("
            + " UNION ALL ".join(_moments("syn", "synth", c) for c in columns) + ")")


def ks_sql(columns, cap: str = "ny") -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v, {int(t == 'src')} AS s, {int(t == 'syn')} AS y FROM {t} "
                               f"WHERE {c} IS NOT NULL" for c in columns for t in ("src", "syn"))
    return f"""u AS ({cells}), f AS (SELECT c, v, sum(s) AS s, sum(y) AS y FROM u GROUP BY c, v),
r AS (SELECT c, sum(s) OVER w AS cs, sum(y) OVER w AS cy, sum(s) OVER (PARTITION BY c) AS ns, sum(y) OVER (PARTITION BY c) AS ny
  FROM f WINDOW w AS (PARTITION BY c ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, {cap} AS cap FROM r),
d AS (SELECT c, max(abs(cs / ns - ((cy * cap) // ny) / cap)) AS d, max(ns) AS n1, max(cap) AS n2 FROM k GROUP BY c),
l AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS lam FROM d),
ks AS (SELECT c, d, n1, CAST(n2 AS BIGINT) AS n2, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(
  range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * lam * lam))))) END AS p FROM l)"""


@query("numeric_stats", f"""WITH {READY_SQL}, {stats_sql(READY)}
SELECT ms.c AS "column", source_n, synth_n, {', '.join(f'round({s}_{m}, 4) AS {s}_{m}' for s in ('source', 'synth') for m in STATS[1:])}
FROM ms JOIN my ON ms.c = my.c""")
def numeric_stats(spark, folder):
    a, b = ready_sides(spark, folder)
    out = vd.numeric_comparison(a, b, READY)
    return rounded(out.select("column", "source_n", "synth_n", *[f"{s}_{m}" for s in ("source", "synth") for m in STATS[1:]]))


@query("exact_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS share, round(quantile_cont({c}, {q}), 4) AS value FROM lineitem"
    for c in MEASURES for q in (0.0, 0.01, 0.1, 0.5, 0.99, 1.0)))
def quantiles(spark, folder):
    return rounded(exact_quantiles(table(spark, folder, "lineitem"), MEASURES, [0.0, 0.01, 0.1, 0.5, 0.99, 1.0]))


@query("ks_statistic", f"""WITH {READY_SQL}, {ks_sql(READY, 'ny')} SELECT c AS "column", round(d, 6) AS ks_statistic FROM ks""")
def ks_statistic(spark, folder):
    a, b = ready_sides(spark, folder)
    return rounded(vd.numeric_comparison(a, b, READY, cap=None).select("column", "ks_statistic"), 6)


KS_TEST_SQL = """SELECT c AS "column", round(d, 6) AS ks_statistic, round(p, 6) AS ks_pvalue, p > 0.05 AS ks_pass,
  CASE WHEN p > 0.05 THEN 'pass' ELSE 'fail' END AS ks_status, round((1 - d) * 100, 2) AS distribution_similarity FROM ks"""


@query("ks_test", f"WITH {READY_SQL}, {ks_sql(READY)} {KS_TEST_SQL}")
def ks_test(spark, folder):
    a, b = ready_sides(spark, folder)
    out = vd.numeric_comparison(a, b, READY)
    return rounded(out.select("column", "ks_statistic", "ks_pvalue", "ks_pass", "ks_status", "distribution_similarity"), 6)


EARLY_SQL = (f"src AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{EARLY_DAY}'), "
             f"syn AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{EARLY_DAY}')")


@query("ks_cap", f"""WITH {EARLY_SQL}, {ks_sql(MEASURES, 'least(ny, 2 * ns)')}
SELECT c AS "column", CAST(n1 AS BIGINT) AS source_n, n2 AS ks_capped_synth_n, round(d, 6) AS ks_statistic, round(p, 6) AS ks_pvalue FROM ks""")
def ks_cap(spark, folder):
    a, b = sides(spark, folder, EARLY_DAY)
    out = vd.numeric_comparison(a, b, MEASURES, cap=vd.KS_CAP)
    return rounded(out.select("column", "source_n", "ks_capped_synth_n", "ks_statistic", "ks_pvalue"), 6)


@query("ks_diagnose", f"""WITH {EARLY_SQL}, {ks_sql(['l_quantity', 'l_tax'], 'ny')}
SELECT c AS "column", 'double' AS source_type, 'double' AS synth_type, NULL AS reason, round(d, 6) AS ks_statistic,
  round(p, 6) AS ks_pvalue, p > 0.05 AS ks_pass FROM ks
UNION ALL SELECT 'l_returnflag', 'string', 'string', 'not numeric on both sides', NULL, NULL, NULL
UNION ALL SELECT 'l_linestatus', 'string', 'string', 'not numeric on both sides', NULL, NULL, NULL""")
def ks_diagnose(spark, folder):
    a, b = sides(spark, folder, EARLY_DAY)
    keep = ["l_quantity", "l_tax", "l_returnflag", "l_linestatus"]
    return rounded(vd.ks_diagnosis(a.select(*keep), b.select(*keep)), 6)


GAP_CASE = "CASE WHEN l_discount <> 0.05 THEN l_returnflag END"


def flagged(df):
    return df.select(F.when(F.col("l_discount") != 0.05, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus",
                     F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("l_quantity"), "l_tax")


def _gap_side(side: str) -> str:
    return (f"(SELECT {GAP_CASE} AS l_returnflag, l_linestatus, CASE WHEN l_linenumber <> 4 THEN l_quantity END AS l_quantity, "
            f"l_tax FROM ({side}))")


GAP_SQL = f"src AS {_gap_side(SOURCE_SQL)}, syn AS {_gap_side(SYNTH_SQL)}"


@query("route_columns", f"""WITH {GAP_SQL}, a AS (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_quantity', 'l_tax']) AS "column",
  unnest([0.0, 0.0, count(l_quantity) / count(*), count(l_tax) / count(*)]) AS x FROM src),
b AS (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_quantity', 'l_tax']) AS "column",
  unnest([0.0, 0.0, count(l_quantity) / count(*), count(l_tax) / count(*)]) AS y FROM syn)
SELECT "column", round(x, 6) AS source_share, round(y, 6) AS synth_share,
  CASE WHEN x >= 0.9 AND y >= 0.9 THEN 'numeric' ELSE 'categorical' END AS treated FROM a JOIN b USING ("column")""")
def route_columns(spark, folder):
    a, b = sides(spark, folder)
    return rounded(vd.route_columns(flagged(a), flagged(b), ["l_returnflag", "l_linestatus", "l_quantity", "l_tax"]), 6)


def category_sql(columns) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS c, coalesce(CAST({c} AS VARCHAR), 'nan') AS v, {int(t == 'src')} AS s, "
                               f"{int(t == 'syn')} AS y FROM {t}" for c in columns for t in ("src", "syn"))
    return f"""cu AS ({cells}), cf AS (SELECT c, v, sum(s) AS s, sum(y) AS y FROM cu GROUP BY c, v),
ct AS (SELECT *, sum(s) OVER (PARTITION BY c) AS ns, sum(y) OVER (PARTITION BY c) AS ny FROM cf),
cp AS (SELECT *, CAST(round(s / ns * 100, 2) AS DECIMAL(10, 2)) AS sp, CAST(round(y / ny * 100, 2) AS DECIMAL(10, 2)) AS yp,
  y / ny * ns + 0.5 AS e, s + 0.5 AS o FROM ct),
cs AS (SELECT c, count(*) AS k, sum((o - e) * (o - e) / e) AS x, sum(abs(CAST(s AS HUGEINT) * CAST(ny AS HUGEINT) - CAST(y AS HUGEINT) * CAST(ns AS HUGEINT))) AS apart, max(ns) AS ns, max(ny) AS ny FROM cp GROUP BY c),
cat AS (SELECT c, k, x, CASE WHEN k < 2 THEN NULL WHEN x <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, 600),
  lambda i: exp(-x / 2 + ((k - 1) / 2 + i) * ln(x / 2) - lgamma((k - 1) / 2 + i + 1))))) END AS p,
  round(CAST(apart AS DOUBLE) / (2.0::DOUBLE * ns * ny), 4) AS tvd,
  round((1.0::DOUBLE - least(CAST(apart AS DOUBLE) / (2.0::DOUBLE * ns * ny), 1.0::DOUBLE)) * 100, 2) AS similarity FROM cs)"""


CATS = ["l_returnflag", "l_linestatus", "l_quantity"]


@query("category_distribution", f"""WITH {GAP_SQL}, {category_sql(CATS)}
SELECT c AS "column", v AS category, CAST(sp AS DOUBLE) AS source_pct, CAST(yp AS DOUBLE) AS synth_pct FROM cp""")
def category_distribution(spark, folder):
    a, b = sides(spark, folder)
    return vd.category_distribution(vd.category_frequencies(flagged(a), flagged(b), CATS))


def categorical(spark, folder):
    a, b = sides(spark, folder)
    return vd.categorical_comparison(vd.category_frequencies(flagged(a), flagged(b), CATS))


MANY_SQL = "src AS (SELECT text AS t FROM documents), syn AS (SELECT url AS t FROM pages)"


@query("tvd_many_values", f"""WITH {MANY_SQL}, {category_sql(['t'])} SELECT c AS "column", k AS categories, tvd, similarity AS similarity_score FROM cat""")
def tvd_many_values(spark, folder):
    """Two sides of many values each, none of them in common."""
    a = table(spark, folder, "documents").select(F.col("text").alias("t"))
    b = table(spark, folder, "pages").select(F.col("url").alias("t"))
    return vd.categorical_comparison(vd.category_frequencies(a, b, ["t"])).select("column", "categories", "tvd", "similarity_score")


@query("tvd", f"""WITH {GAP_SQL}, {category_sql(CATS)} SELECT c AS "column", tvd, similarity AS similarity_score FROM cat""")
def tvd(spark, folder):
    return categorical(spark, folder).select("column", "tvd", "similarity_score")


@query("chi_square", f"""WITH {GAP_SQL}, {category_sql(CATS)}
SELECT c AS "column", k AS categories, round(x, 4) AS chi2_statistic, round(p, 6) AS chi2_pvalue FROM cat""")
def chi_square(spark, folder):
    return rounded(categorical(spark, folder).select("column", "categories", "chi2_statistic", "chi2_pvalue"), chi2_pvalue=6)


def correlation_sql(columns) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    rows = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS pair, '{a}' AS col_a, '{b}' AS col_b, (SELECT corr({a}, {b}) FROM src) AS x, (SELECT corr({a}, {b}) FROM syn) AS y"
        for i, (a, b) in enumerate(pairs))
    return (f"cw AS ({rows}), co AS (SELECT pair, col_a, col_b, round(x, 4) AS source_correlation, round(y, 4) AS synth_correlation, "
            f"round(abs(x - y), 4) AS difference FROM cw WHERE x IS NOT NULL AND y IS NOT NULL)")


@query("correlations", f"WITH {READY_SQL}, {correlation_sql(READY)} SELECT * FROM co")
def correlations(spark, folder):
    a, b = ready_sides(spark, folder)
    return vd.correlations(a, b, READY)


@query("correlations_with_gaps", f"WITH {GAP_SQL}, {correlation_sql(['l_quantity', 'l_tax'])} SELECT * FROM co")
def correlations_with_gaps(spark, folder):
    a, b = sides(spark, folder)
    return vd.correlations(flagged(a), flagged(b), ["l_quantity", "l_tax"])


@query("top_correlations", f"WITH {READY_SQL}, {correlation_sql(READY)} SELECT * FROM co ORDER BY pair LIMIT 8")
def top_correlations(spark, folder):
    a, b = ready_sides(spark, folder)
    return vd.top_correlations(vd.correlations(a, b, READY))


OVERALL_SQL = f"""{READY_SQL}, {ks_sql(READY)}, {category_sql(FLAGS)}, {correlation_sql(READY)},
sims AS (SELECT round((1 - d) * 100, 2) AS v FROM ks UNION ALL SELECT similarity FROM cat),
parts AS (SELECT (SELECT round(avg(v), 2) FROM sims) AS distribution_similarity,
  (SELECT round(greatest(0.0, 1.0 - avg(difference)) * 100, 2) FROM co) AS correlation_preservation,
  (SELECT round(count(*) FILTER (p > 0.05) / count(*) * 100, 2) FROM ks) AS ks_pass_rate,
  (SELECT count(*) FROM ks) AS ks_tested_columns, (SELECT count(*) FROM ks WHERE p > 0.05) AS ks_passed_columns,
  CAST(0 AS BIGINT) AS ks_skipped_columns),
overall AS (SELECT *, round(0.5 * distribution_similarity + 0.3 * correlation_preservation + 0.2 * ks_pass_rate, 2) AS overall_quality FROM parts)"""


@query("overall_scores", f"WITH {OVERALL_SQL} SELECT * FROM overall")
def overall_scores(spark, folder):
    a, b = ready_sides(spark, folder)
    return compare.validate(a, b).overall


@query("stat_comparison", f"""WITH {READY_SQL}, {stats_sql(READY)}, w AS (SELECT * FROM ms JOIN my USING (c))
SELECT c AS "column", 'Mean' AS metric, round(source_mean, 4) AS source, round(synth_mean, 4) AS synthetic FROM w UNION ALL
SELECT c, 'Median', round(source_median, 4), round(synth_median, 4) FROM w UNION ALL
SELECT c, 'Std Dev', round(source_std, 4), round(synth_std, 4) FROM w""")
def stat_comparison(spark, folder):
    a, b = ready_sides(spark, folder)
    return rounded(vd.stat_comparison(vd.numeric_comparison(a, b, READY)))


@query("validation_report", f"""WITH {OVERALL_SQL}, {stats_sql(READY)}
SELECT 'numeric' AS part, c AS item, round(d, 6) AS a, round(p, 6) AS b, round((1 - d) * 100, 2) AS c FROM ks
UNION ALL SELECT 'categorical', c, tvd, round(x, 4), similarity FROM cat
UNION ALL SELECT 'correlation', col_a || ' / ' || col_b, source_correlation, synth_correlation, difference FROM co
UNION ALL SELECT 'overall', 'overall', distribution_similarity, correlation_preservation, overall_quality FROM overall""")
def validation_report(spark, folder):
    a, b = ready_sides(spark, folder)
    v = compare.validate(a, b, cohort_columns=["l_quantity"])

    def part(df, name, item, x, y, z):
        return df.select(F.lit(name).alias("part"), item.alias("item"), x.alias("a"), y.alias("b"), z.alias("c"))

    return (part(v.numeric, "numeric", F.col("column"), F.round("ks_statistic", 6), F.round("ks_pvalue", 6),
                 F.col("distribution_similarity"))
            .unionByName(part(v.categorical, "categorical", F.col("column"), F.col("tvd"), F.round("chi2_statistic", 4),
                              F.col("similarity_score")))
            .unionByName(part(v.correlations, "correlation", F.concat_ws(" / ", "col_a", "col_b"),
                              F.col("source_correlation"), F.col("synth_correlation"), F.col("difference")))
            .unionByName(part(v.overall, "overall", F.lit("overall"), F.col("distribution_similarity"),
                              F.col("correlation_preservation"), F.col("overall_quality"))))


@query("grade_bands", """
SELECT p_partkey, CASE WHEN p_size * 2 >= 85 THEN 'good' WHEN p_size * 2 >= 65 THEN 'fair' ELSE 'poor' END AS score,
  CASE WHEN p_size * 2 >= 80 THEN 'good' WHEN p_size * 2 >= 60 THEN 'fair' ELSE 'poor' END AS similarity,
  CASE WHEN p_size / 100 <= 0.05 THEN 'Excellent' WHEN p_size / 100 <= 0.15 THEN 'Good' ELSE 'Review' END AS correlation,
  CASE WHEN p_type = 'ECONOMY' THEN 'Missing' WHEN p_size / 5 <= 2 THEN 'Excellent' WHEN p_size / 5 <= 5 THEN 'Good' ELSE 'Review' END
    AS cohort FROM part""")
def grade_bands(spark, folder):
    size = F.col("p_size")
    status = F.when(F.col("p_type") == "ECONOMY", "column_missing").otherwise("pass")
    return table(spark, folder, "part").select(
        "p_partkey", vd.score_grade(size * 2).alias("score"), vd.similarity_grade(size * 2).alias("similarity"),
        vd.correlation_grade(size / 100).alias("correlation"), vd.cohort_grade(status, size / 5).alias("cohort"))


TEXT_SQL = "ds AS (SELECT * FROM documents WHERE source < 'src2'), dy AS (SELECT * FROM documents WHERE source >= 'src2')"


@query("exact_duplicates", f"""WITH {TEXT_SQL} SELECT count(*) AS exact_duplicates FROM dy
WHERE EXISTS (SELECT 1 FROM ds WHERE ds.text IS NOT DISTINCT FROM dy.text AND ds.lang IS NOT DISTINCT FROM dy.lang)""")
def exact_duplicates(spark, folder):
    a, b = text_sides(spark, folder)
    return pv.exact_duplicates(a.select("text", "lang"), b.select("text", "lang"))


@query("minmax_encode", """SELECT p_partkey, p_brand, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS p_size,
  round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part""")
def minmax_encode(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return rounded(pv.minmax_encode(p, ["p_size", "p_retailprice"]), 6)


@query("minmax_encode_gaps", f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 4 THEN l_quantity END AS q FROM lineitem),
s AS (SELECT min(q) AS lo, max(q) AS hi, quantile_cont(q, 0.5) AS mid FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, round((coalesce(q, mid) - lo) / (hi - lo), 6) AS l_quantity FROM g, s""")
def minmax_encode_gaps(spark, folder):
    li = table(spark, folder, "lineitem")
    g = li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("l_quantity"))
    return rounded(pv.minmax_encode(g, ["l_quantity"]), 6)


@query("label_encode", """WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)),
t AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part))
SELECT p_partkey, round(b.i / b.n, 6) AS p_brand, round(t.i / t.n, 6) AS p_name FROM part JOIN b USING (p_brand) JOIN t USING (p_name)""")
def label_encode(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    return rounded(pv.label_encode(p, ["p_brand", "p_name"], ["p_partkey"]), 6)


FEATURES = ["p_size", "p_retailprice", "p_brand"]


NEAR_SQL = """both_sides AS (SELECT CASE WHEN p_type < 'M' THEN 0 ELSE 1 END AS side, p_partkey AS idx, p_size, p_retailprice, p_brand FROM part),
enc AS (SELECT side, idx, (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) AS a,
  (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b,
  (dense_rank() OVER (ORDER BY p_brand) - 1) / (SELECT count(DISTINCT p_brand) FROM both_sides) AS c FROM both_sides),
dist AS (SELECT y.idx AS synth_idx, s.idx AS near_idx, sqrt((s.a - y.a) * (s.a - y.a) + (s.b - y.b) * (s.b - y.b) + (s.c - y.c) * (s.c - y.c)) AS d
  FROM enc y, enc s WHERE y.side = 1 AND s.side = 0),
near AS (SELECT synth_idx, arg_min(near_idx, (d, near_idx)) AS nearest_source_idx, min(d) AS distance FROM dist WHERE d < 0.05 GROUP BY synth_idx)"""


def _encoded(spark, folder):
    a, b = part_sides(spark, folder)
    return pv.encoded_rows(a, b, "p_partkey", FEATURES)


def _near(spark, folder):
    """Encoded rows of both sides and the near points among them."""
    encoded = _encoded(spark, folder)
    return encoded.rows, pv.near_points(encoded.rows, pv.THRESHOLD, encoded.steps)


@query("sample_n", f"""SELECT p_partkey, p_name FROM part ORDER BY (p_partkey * 48271 + 12345) % 2147483647, p_partkey LIMIT 500""")
def sample_n(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_name")
    return pv.sample_rows(p, "p_partkey", pv.SAMPLE, linear_score(F.col("p_partkey")), LINEAR_SPAN)


@query("nearest_source", f"WITH {NEAR_SQL} SELECT synth_idx, nearest_source_idx, round(distance, 6) AS distance FROM near")
def nearest_source(spark, folder):
    return rounded(pv.near_rows(*_near(spark, folder)), 6)


@query("near_duplicates", f"""WITH {NEAR_SQL} SELECT count(*) AS near_duplicates, count(DISTINCT (a, b, c)) AS near_points
FROM near JOIN enc ON side = 1 AND idx = synth_idx""")
def near_duplicates(spark, folder):
    return pv.near_counts(_near(spark, folder)[1])


@query("near_duplicate_pairs", f"""WITH {NEAR_SQL} SELECT synth_idx, nearest_source_idx, round(distance, 4) AS distance FROM near
ORDER BY synth_idx LIMIT 10""")
def near_duplicate_pairs(spark, folder):
    return pv.near_duplicate_pairs(pv.near_rows(*_near(spark, folder)))


def _sample_sql(side: int, where: str) -> str:
    return (f"(SELECT {side} AS side, row_number() OVER (ORDER BY (p_partkey * 48271 + 12345) % 2147483647, p_partkey) - 1 AS idx, "
            f"p_partkey, p_size, p_retailprice, p_brand FROM part WHERE {where} QUALIFY idx < 500)")


#: The sampling option: 500 rows a side.
SAMPLED_SQL = NEAR_SQL.replace(NEAR_SQL[:NEAR_SQL.index("enc AS")], f"""both_sides AS ({_sample_sql(0, "p_type < 'M'")} UNION ALL {_sample_sql(1, "p_type >= 'M'")}),
""").replace(" WHERE d < 0.05", "")


@query("near_duplicates_sampled", f"""WITH {SAMPLED_SQL} SELECT count(*) FILTER (distance < 0.05) AS sample_near_duplicates,
  CAST(round_even(count(*) FILTER (distance < 0.05) * (SELECT count(*) FROM part WHERE p_type >= 'M') / count(*), 0) AS BIGINT) AS near_duplicates FROM near""")
def near_duplicates_sampled(spark, folder):
    a, b = part_sides(spark, folder)
    encoded = pv.encoded_samples(a, b, "p_partkey", FEATURES, score=linear_score, span=LINEAR_SPAN)
    return pv.near_duplicates(pv.nearest_source(encoded), b.count())


@query("risk_level", """SELECT source, CASE WHEN n = 0 THEN 'Unknown' WHEN e / n > 0.01 OR f / n > 0.05 THEN 'High'
  WHEN e / n > 0.001 OR f / n > 0.02 THEN 'Medium' ELSE 'Low' END AS risk_level FROM (
  SELECT source, count(*) * 40 AS n, count(*) FILTER (lang = 'es') AS e, count(*) FILTER (lang = 'fr') * 8 AS f FROM documents GROUP BY source)""")
def risk_level(spark, folder):
    per = table(spark, folder, "documents").groupBy("source").agg(
        (F.count(F.lit(1)) * 40).alias("n"), F.count(F.when(F.col("lang") == "es", 1)).alias("e"),
        (F.count(F.when(F.col("lang") == "fr", 1)) * 8).alias("f"))
    return per.select("source", pv.risk_level(F.col("e"), F.col("f"), F.col("n")).alias("risk_level"))


PRIVACY_SQL = f"""{NEAR_SQL},
xd AS (SELECT count(*) AS exact_duplicates FROM (SELECT * FROM part WHERE p_type >= 'M') y WHERE EXISTS (SELECT 1 FROM part s
  WHERE s.p_type < 'M' AND s.p_size = y.p_size AND s.p_retailprice = y.p_retailprice AND s.p_brand = y.p_brand)),
nd AS (SELECT count(*) AS near_duplicates FROM near),
tot AS (SELECT count(*) FILTER (p_type < 'M') AS ns, count(*) FILTER (p_type >= 'M') AS ny FROM part),
pr AS (SELECT exact_duplicates, near_duplicates, ns, ny, CASE WHEN exact_duplicates / ny > 0.01 OR near_duplicates / ny > 0.05 THEN 'High'
  WHEN exact_duplicates / ny > 0.001 OR near_duplicates / ny > 0.02 THEN 'Medium' ELSE 'Low' END AS risk_level FROM xd, nd, tot)"""


def privacy_of_parts(spark, folder):
    a, b = part_sides(spark, folder)
    return compare.privacy(a, b, "p_partkey", FEATURES)[0]


@query("privacy_report", f"""WITH {PRIVACY_SQL} SELECT exact_duplicates, near_duplicates, risk_level,
  round(exact_duplicates / ny * 100, 4) AS exact_duplicate_rate_pct, round(near_duplicates / ny * 100, 4) AS near_duplicate_rate_pct,
  0.05::DOUBLE AS near_duplicate_threshold, 'all rows' AS near_duplicate_basis, ns AS total_source_records, ny AS total_synthetic_records,
  CASE risk_level {" ".join(f"WHEN '{level}' THEN '{words}'" for level, words in pv.INTERPRETATIONS.items())} ELSE '' END AS risk_interpretation,
  '{pv.DISCLAIMER}' AS disclaimer FROM pr""")
def privacy_report(spark, folder):
    return privacy_of_parts(spark, folder)


@query("report_long", f"""WITH {OVERALL_SQL}, {PRIVACY_SQL}
SELECT 'Summary' AS section, metric AS item, 'score' AS metric, round(CAST(v AS DOUBLE), 6) AS number, CAST(NULL AS VARCHAR) AS text
FROM (SELECT unnest(['distribution_similarity', 'correlation_preservation', 'ks_pass_rate', 'ks_tested_columns', 'ks_passed_columns',
  'ks_skipped_columns', 'overall_quality']) AS metric, unnest([distribution_similarity, correlation_preservation, ks_pass_rate,
  ks_tested_columns, ks_passed_columns, ks_skipped_columns, overall_quality]) AS v FROM overall)
UNION ALL SELECT 'Numerical Stats', c, unnest(['ks_statistic', 'ks_pvalue']), unnest([round(d, 6), round(p, 6)]), NULL FROM ks
UNION ALL SELECT 'Categorical Stats', c, unnest(['tvd', 'similarity_score', 'chi2_statistic', 'chi2_pvalue']),
  unnest([tvd, similarity, round(x, 6), round(p, 6)]), NULL FROM cat
UNION ALL SELECT 'Correlations', col_a || ' / ' || col_b, unnest(['source_correlation', 'synth_correlation', 'difference']),
  unnest([source_correlation, synth_correlation, difference]), NULL FROM co
UNION ALL SELECT 'Privacy Checks', unnest(['Exact Duplicates', 'Near Duplicates', 'Near Duplicates Basis', 'Risk Level']), 'value', NULL,
  unnest([CAST(exact_duplicates AS VARCHAR), CAST(near_duplicates AS VARCHAR), 'all rows', risk_level]) FROM pr""")
def report_long(spark, folder):
    a, b = ready_sides(spark, folder)
    v = compare.validate(a, b)
    v.numeric = v.numeric.select("column", "ks_statistic", "ks_pvalue")
    out = long_report(compare.report_tables(v, privacy_of_parts(spark, folder)))
    return out.where(F.col("item") != "Disclaimer")
