"""Whole validation and privacy runs over a source and a synthetic table."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from mirrortab.functions.draws import SPAN
from mirrortab.functions.values import ref
from mirrortab.operators import privacy as pv, validate as vd
from mirrortab.operators.classify import common_columns
from mirrortab.operators.ordering import cut_lineage
from mirrortab.sources.report import sections


@dataclass
class Validation:
    numeric: DataFrame
    categories: DataFrame
    categorical: DataFrame
    correlations: DataFrame
    overall: DataFrame


def empty_numeric(spark) -> DataFrame:
    return spark.createDataFrame([], "column string, distribution_similarity double, ks_status string, ks_pass boolean")


def empty_categorical(spark) -> DataFrame:
    return spark.createDataFrame(
        [], "column string, categories bigint, chi2_statistic double, chi2_pvalue double, tvd double, "
            "similarity_score double")


def validate(source: DataFrame, synthetic: DataFrame, cap: int | None = None,
             cohort_columns: Collection[str] = (), numeric_only: bool = False) -> Validation:
    """Compare the common columns. One small pass routes the columns; the results stay lazy."""
    spark, columns = source.sparkSession, common_columns(source, synthetic)
    routes = {r["column"]: r for r in vd.route_columns(source, synthetic, columns).collect()}
    numeric = [c for c in columns if routes[c]["treated"] == "numeric"]
    textual = [c for c in columns if c not in numeric]
    paired = [c for c in columns if routes[c]["source_share"] > 0 and routes[c]["synth_share"] > 0]
    if numeric_only:
        paired = [c for c in paired if c in numeric]
    stats = vd.numeric_comparison(source, synthetic, numeric, cap, cohort_columns) if numeric else empty_numeric(spark)
    if textual:
        counts = vd.category_frequencies(source, synthetic, textual)
        shares, tests = vd.category_distribution(counts), vd.categorical_comparison(counts)
    else:
        shares = spark.createDataFrame([], "column string, category string, source_pct double, synth_pct double")
        tests = empty_categorical(spark)
    corr = vd.correlations(source, synthetic, paired)
    return Validation(stats, shares, tests, corr, vd.overall_scores(stats, tests, corr))


def privacy(source: DataFrame, synthetic: DataFrame, key: str, columns: Sequence[str] | None = None,
            size: int | None = None, threshold: float = pv.THRESHOLD, score: Callable[[Column], Column] | None = None,
            span: int = SPAN, independent: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one-row report, first near-duplicate pairs). ``key`` numbers the rows on both sides and is not compared.

    Near duplicates are looked for among all rows. With ``size`` they are estimated from that many sampled rows a side,
    picked by ``score``, and the report says so.
    """
    spark = source.sparkSession
    columns = [c for c in common_columns(source, synthetic) if c != key] if columns is None else list(columns)
    source_rows, synthetic_rows = source.count(), synthetic.count()
    if not columns or not source_rows or not synthetic_rows:
        pairs = spark.createDataFrame([], "synth_idx bigint, nearest_source_idx bigint, distance double")
        return pv.privacy_report(0, 0, source_rows, synthetic_rows, spark, size), pairs
    exact = pv.exact_duplicates(source.select([ref(c) for c in columns]), synthetic.select([ref(c) for c in columns]))
    if size is None:
        encoded = pv.encoded_rows(source, synthetic, key, columns, independent)
        points = cut_lineage(pv.near_points(encoded.rows, threshold, encoded.steps))
        near, nearest = pv.near_counts(points).first()["near_duplicates"], pv.near_rows(encoded.rows, points)
    else:
        nearest = pv.nearest_source(pv.encoded_samples(source, synthetic, key, columns, size, score, span, independent))
        near = pv.near_duplicates(nearest, synthetic_rows, threshold).first()["near_duplicates"]
    report = pv.privacy_report(exact.first()["exact_duplicates"], near, source_rows, synthetic_rows, spark, size)
    return report, pv.near_duplicate_pairs(nearest, threshold)


def report_tables(validation: Validation, privacy_row: DataFrame) -> dict[str, DataFrame]:
    return sections(validation.numeric, validation.categorical, validation.correlations, validation.overall, privacy_row)

