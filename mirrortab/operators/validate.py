"""Source against synthetic: distributions, categories, correlations, scores."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mirrortab.functions.maths import chi2_pvalue, ks_pvalue
from mirrortab.functions.values import as_number, is_number, missing_to_null, type_of
from mirrortab.operators.frequency import pair_frequencies, quantile_of, ranked_values
from mirrortab.operators.scans import Levels
from mirrortab.operators.gram import pair_correlations, pair_moments

KS_CAP = 2
KS_ALPHA = 0.05
NUMERIC_SHARE = 0.9


def readable_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share): how much of each column reads as numbers, nulls counting against it."""
    row = df.agg(*[F.coalesce(F.avg(as_number(df, c).isNotNull().cast("double")), F.lit(0.0)).alias(f"c{i}")
                   for i, c in enumerate(columns)])
    cells = [x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"c{i}"))]
    return row.select(F.stack(F.lit(len(columns)), *cells).alias("column", "share"))


def route_columns(source: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, source_share, synth_share, treated): numeric iff nine in ten rows read on both sides."""
    a = readable_share(source, columns).withColumnRenamed("share", "source_share")
    b = readable_share(synthetic, columns).withColumnRenamed("share", "synth_share")
    numeric = (F.col("source_share") >= NUMERIC_SHARE) & (F.col("synth_share") >= NUMERIC_SHARE)
    return a.join(F.broadcast(b), "column").select(
        "column", "source_share", "synth_share", F.when(numeric, "numeric").otherwise("categorical").alias("treated"))


def capped_counts(pair: DataFrame, cap: int | None) -> DataFrame:
    """Add ``capped_total`` and ``capped_upto``: the synthetic side cut to ``cap`` times the source.

    The cut is a systematic sample without replacement of the sorted values: its size is exact, it
    needs no row key and no second pass, and no value's share moves by more than one row.
    """
    total = F.col("n_synth_total")
    size = total if cap is None else F.least(total, F.col("n_source_total") * cap)
    wide = pair.withColumn("capped_total", size)
    part = F.expr("(cast(n_synth_upto as decimal(19,0)) * cast(capped_total as decimal(19,0))) "
                  "div cast(n_synth_total as decimal(19,0))")
    return wide.withColumn("capped_upto", F.when(total == F.col("capped_total"), F.col("n_synth_upto")).otherwise(part))


def numeric_comparison(source: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                       cap: int | None = None, cohort_columns: Collection[str] = (),
                       levels: Levels | None = None) -> DataFrame:
    """One row per numeric column: size, moments and quartiles of both sides, and the KS test.

    ``cap`` cuts the synthetic side of the test to that multiple of the source; ``KS_CAP`` is the usual choice, none the default.
    """
    value = F.col("value")
    ranked = capped_counts(ranked_values({"n_source": source, "n_synth": synthetic}, columns, levels), cap)
    gap = F.abs(F.try_divide(F.col("n_source_upto"), F.col("n_source_total"))
                - F.try_divide(F.col("capped_upto"), F.col("capped_total")))

    def side(n: str, name: str) -> list[Column]:
        total, here = F.col(f"{n}_total"), F.when(F.col(n) > 0, value)
        mean = F.try_divide(F.col(f"{n}_sum"), total)
        spread = F.sum(F.col(n) * (value - mean) * (value - mean))
        return [F.max(total).alias(f"{name}_n"), F.max(mean).alias(f"{name}_mean"),
                F.sqrt(spread / F.greatest(F.max(total) - 1, F.lit(1))).alias(f"{name}_std"),
                quantile_of(0.5, n).alias(f"{name}_median"), F.min(here).alias(f"{name}_min"),
                F.max(here).alias(f"{name}_max"), quantile_of(0.25, n).alias(f"{name}_q25"),
                quantile_of(0.75, n).alias(f"{name}_q75")]

    # Columns without a number on one side are left out after the aggregation: a filter before it would
    # turn the left join of ranked_values into an inner one.
    stats = ranked.groupBy("column").agg(
        *side("n_source", "source"), *side("n_synth", "synth"), F.max("capped_total").alias("ks_capped_synth_n"),
        F.max(gap).alias("d")).where((F.col("source_n") > 0) & (F.col("synth_n") > 0))
    enough = (F.col("source_n") >= 2) & (F.col("synth_n") >= 2)
    tested = stats.withColumn("ks_statistic", F.when(enough, F.col("d"))).withColumn(
        "ks_pvalue", F.when(enough, ks_pvalue(F.col("d"), F.col("source_n"), F.col("ks_capped_synth_n"))))
    passed = F.coalesce(F.col("ks_pvalue") > KS_ALPHA, F.lit(False))
    status = F.when(~enough, "insufficient_data").when(passed, "pass").otherwise("fail")
    return tested.select(
        "column", "source_n", "synth_n",
        F.when(enough, F.col("ks_capped_synth_n")).otherwise(F.col("synth_n")).alias("ks_capped_synth_n"),
        F.col("column").isin(list(cohort_columns)).alias("cohort_affected"),
        *[f"{s}_{m}" for s in ("source", "synth") for m in ("mean", "std", "median", "min", "max", "q25", "q75")],
        "ks_statistic", "ks_pvalue", passed.alias("ks_pass"), status.alias("ks_status"),
        F.lit(KS_ALPHA).alias("ks_alpha"),
        F.when(enough, F.round((1.0 - F.col("d")) * 100, 2)).otherwise(0.0).alias("distribution_similarity"))


def category_frequencies(source: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n_source, n_synth) and both totals; null is the category ``nan``."""
    def named(df: DataFrame) -> DataFrame:
        return df.select([F.coalesce(missing_to_null(df, c).cast("string"), F.lit("nan")).alias(c) for c in columns])

    pair = pair_frequencies(named(source), named(synthetic), columns)
    totals = pair.groupBy("column").agg(F.sum("n_source").alias("source_total"), F.sum("n_synth").alias("synth_total"))
    return pair.join(F.broadcast(totals), "column")


def _percent(n: str, total: str) -> Column:
    """Percentage at two decimals, as an exact decimal."""
    return F.round(F.coalesce(F.try_divide(F.col(n), F.col(total)), F.lit(0.0)) * 100, 2).cast("decimal(10,2)")


def category_distribution(counts: DataFrame) -> DataFrame:
    """(column, category, source_pct, synth_pct) from :func:`category_frequencies`."""
    return counts.select("column", F.col("value").alias("category"),
                         _percent("n_source", "source_total").cast("double").alias("source_pct"),
                         _percent("n_synth", "synth_total").cast("double").alias("synth_pct"))


def categorical_comparison(counts: DataFrame) -> DataFrame:
    """One row per column: chi-square test, total variation distance, similarity."""
    scaled = F.coalesce(F.try_divide(F.col("n_synth"), F.col("synth_total")) * F.col("source_total"), F.lit(0.0))
    seen, expected = F.col("n_source") + 0.5, scaled + 0.5
    # Over the common denominator the differences are whole numbers, so their sum is exact.
    cross = [(F.col(a).cast("decimal(19,0)") * F.coalesce(F.col(b), F.lit(0)).cast("decimal(19,0)"))
             for a, b in (("n_source", "synth_total"), ("n_synth", "source_total"))]
    apart = F.abs(cross[0] - cross[1])
    sums = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("categories"),
        F.sum((seen - expected) * (seen - expected) / expected).alias("chi2_statistic"),
        F.sum(apart).cast("double").alias("apart"), F.max("source_total").alias("ns"), F.max("synth_total").alias("ny"))
    tvd = F.coalesce(F.try_divide(F.col("apart"), 2.0 * F.col("ns") * F.col("ny")), F.lit(1.0))
    similarity = (1.0 - F.least(tvd, F.lit(1.0))) * 100
    return sums.select(
        "column", "categories", "chi2_statistic",
        chi2_pvalue(F.col("chi2_statistic"), F.col("categories") - 1).alias("chi2_pvalue"),
        F.round(tvd, 4).alias("tvd"), F.round(similarity, 2).alias("similarity_score"))


def correlations(source: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pair, col_a, col_b, source_correlation, synth_correlation, difference), pairwise complete, both tables in one scan."""
    spark = source.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame(
            [], "pair int, col_a string, col_b string, source_correlation double, synth_correlation double, difference double")
    names = {c: f"c{i}" for i, c in enumerate(columns)}

    def numbers(df: DataFrame, which: int) -> DataFrame:
        return df.select(F.lit(which).alias("side"), *[as_number(df, c).alias(names[c]) for c in columns])

    both = numbers(source, 0).unionByName(numbers(synthetic, 1))
    pairs = pair_correlations(pair_moments(both, [F.col(n) for n in names.values()], F.col("side")))
    r = F.when(~F.isnan("r"), F.col("r"))
    sides = pairs.groupBy("i", "j").agg(
        F.max(F.when(F.col("side") == 0, r)).alias("a"), F.max(F.when(F.col("side") == 1, r)).alias("b"))
    # The place of a pair among all pairs in the order of the columns.
    i, j, k = F.col("i"), F.col("j"), len(columns)
    pair = F.expr(f"cast(i * {k} - i * (i + 1) div 2 as int)") + j - i - 1
    name = F.array(*[F.lit(c) for c in columns])
    return sides.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        pair.cast("int").alias("pair"), name[i].alias("col_a"), name[j].alias("col_b"), F.round("a", 4).alias("source_correlation"),
        F.round("b", 4).alias("synth_correlation"), F.round(F.abs(F.col("a") - F.col("b")), 4).alias("difference"))


def top_correlations(corr: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` pairs, as a report shows them."""
    return corr.orderBy("pair").limit(k)


def overall_scores(numeric: DataFrame, categorical: DataFrame, corr: DataFrame) -> DataFrame:
    """One row of scores over the per-column and per-pair results."""
    none, no = F.lit(None).cast("double"), F.lit(False)
    status = F.col("ks_status")
    parts = (numeric.select(F.col("distribution_similarity").alias("similarity"), none.alias("difference"),
                            status.isin("pass", "fail").alias("tested"), F.col("ks_pass").alias("passed"),
                            (status == "insufficient_data").alias("skipped"))
             .unionByName(categorical.select(F.col("similarity_score").alias("similarity"), none.alias("difference"),
                                             no.alias("tested"), no.alias("passed"), no.alias("skipped")))
             .unionByName(corr.select(none.alias("similarity"), "difference", no.alias("tested"), no.alias("passed"),
                                      no.alias("skipped"))))
    sums = parts.agg(
        F.coalesce(F.round(F.avg("similarity"), 2), F.lit(0.0)).alias("distribution_similarity"),
        F.coalesce(F.round(F.greatest(F.lit(0.0), 1.0 - F.avg("difference")) * 100, 2), F.lit(100.0))
        .alias("correlation_preservation"),
        F.count(F.when(F.col("tested"), 1)).alias("ks_tested_columns"),
        F.count(F.when(F.col("tested") & F.col("passed"), 1)).alias("ks_passed_columns"),
        F.count(F.when(F.col("skipped"), 1)).alias("ks_skipped_columns"))
    rate = F.coalesce(F.round(F.try_divide(F.col("ks_passed_columns"), F.col("ks_tested_columns")) * 100, 2), F.lit(0.0))
    quality = F.round(0.5 * F.col("distribution_similarity") + 0.3 * F.col("correlation_preservation")
                      + 0.2 * F.col("ks_pass_rate"), 2)
    return sums.withColumn("ks_pass_rate", rate).select(
        "distribution_similarity", "correlation_preservation", "ks_pass_rate", "ks_tested_columns",
        "ks_passed_columns", "ks_skipped_columns", quality.alias("overall_quality"))


def stat_comparison(numeric: DataFrame) -> DataFrame:
    """(column, metric, source, synthetic) for mean, median and standard deviation."""
    cells = [x for label, m in (("Mean", "mean"), ("Median", "median"), ("Std Dev", "std"))
             for x in (F.lit(label), F.col(f"source_{m}"), F.col(f"synth_{m}"))]
    return numeric.select("column", F.stack(F.lit(3), *cells).alias("metric", "source", "synthetic"))


def ks_diagnosis(source: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Uncapped KS of every shared column, or the reason why a column is left out."""
    rows, numeric = [], []
    for c in [c for c in source.columns if c in synthetic.columns]:
        a, b = type_of(source, c), type_of(synthetic, c)
        fits = is_number(a) and is_number(b)
        rows.append((c, a.simpleString(), b.simpleString(), None if fits else "not numeric on both sides"))
        if fits:
            numeric.append(c)
    table = source.sparkSession.createDataFrame(
        rows, "column string, source_type string, synth_type string, reason string")
    if not numeric:
        return table.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("ks_statistic", "double"), ("ks_pvalue", "double"), ("ks_pass", "boolean"))])
    stats = numeric_comparison(source, synthetic, numeric, cap=None)
    joined = table.join(F.broadcast(stats), "column", "left")
    few = (F.col("ks_status") == "insufficient_data") | (F.col("ks_status").isNull() & F.col("reason").isNull())
    return joined.select("column", "source_type", "synth_type",
                         F.coalesce("reason", F.when(few, "too few non-null values")).alias("reason"),
                         "ks_statistic", "ks_pvalue", F.when(~few, F.col("ks_pass")).alias("ks_pass"))


# Limits between the grades.
SCORE_LIMITS = [(85, "good"), (65, "fair")]
SIMILARITY_LIMITS = [(80, "good"), (60, "fair")]
CORRELATION_LIMITS = [(0.05, "Excellent"), (0.15, "Good")]
COHORT_LIMITS = [(2, "Excellent"), (5, "Good")]


def grade_at_least(c: Column, limits, rest: str) -> Column:
    ladder = F.when(c >= limits[0][0], limits[0][1])
    for limit, name in limits[1:]:
        ladder = ladder.when(c >= limit, name)
    return ladder.otherwise(rest)


def grade_at_most(c: Column, limits, rest: str) -> Column:
    ladder = F.when(c <= limits[0][0], limits[0][1])
    for limit, name in limits[1:]:
        ladder = ladder.when(c <= limit, name)
    return ladder.otherwise(rest)


def score_grade(c: Column) -> Column:
    return grade_at_least(c, SCORE_LIMITS, "poor")


def similarity_grade(c: Column) -> Column:
    return grade_at_least(c, SIMILARITY_LIMITS, "poor")


def correlation_grade(c: Column) -> Column:
    return grade_at_most(c, CORRELATION_LIMITS, "Review")


def cohort_grade(status: Column, diff: Column) -> Column:
    return F.when(status == "column_missing", "Missing").otherwise(grade_at_most(diff, COHORT_LIMITS, "Review"))
