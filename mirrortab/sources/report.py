"""Reports as tables: one per section, or one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mirrortab.functions.values import ref

# Section titles.
SECTIONS = ["Summary", "Numerical Stats", "Categorical Stats", "Correlations", "Privacy Checks"]


def summary_section(overall: DataFrame) -> DataFrame:
    """(metric, score) rows."""
    cells = [x for c in overall.columns for x in (F.lit(c), ref(c).cast("double"))]
    return overall.select(F.stack(F.lit(len(overall.columns)), *cells).alias("metric", "score"))


def privacy_section(privacy: DataFrame) -> DataFrame:
    """(check, value) rows."""
    cells = [F.lit("Exact Duplicates"), F.col("exact_duplicates").cast("string"),
             F.lit("Near Duplicates"), F.col("near_duplicates").cast("string"),
             F.lit("Near Duplicates Basis"), F.col("near_duplicate_basis"),
             F.lit("Risk Level"), F.col("risk_level"), F.lit("Disclaimer"), F.col("disclaimer")]
    return privacy.select(F.stack(F.lit(5), *cells).alias("check", "value"))


def sections(numeric: DataFrame, categorical: DataFrame, corr: DataFrame, overall: DataFrame,
             privacy: DataFrame) -> dict[str, DataFrame]:
    return dict(zip(SECTIONS, [
        summary_section(overall), numeric,
        categorical.select("column", "tvd", "similarity_score", "chi2_statistic", "chi2_pvalue"),
        corr, privacy_section(privacy)]))


def write_sections(parts: dict[str, DataFrame], path: str) -> None:
    for title, part in parts.items():
        part.write.mode("overwrite").parquet(f"{path}/{title.lower().replace(' ', '_')}")


def long_report(parts: dict[str, DataFrame], digits: int = 6) -> DataFrame:
    """(section, item, metric, number, text): every cell of every section as a row."""
    out = None
    for title, part in parts.items():
        labels = [c for c in ("column", "col_a", "col_b", "metric", "check") if c in part.columns]
        numbers = [f.name for f in part.schema.fields
                   if f.dataType.typeName() in ("integer", "long", "double", "boolean") and f.name != "pair"]
        texts = [c for c in part.columns if c not in labels and c not in numbers and c != "pair"]
        cells = [x for c in numbers for x in (F.lit(c), F.round(ref(c).cast("double"), digits), F.lit(None).cast("string"))]
        cells += [x for c in texts for x in (F.lit(c), F.lit(None).cast("double"), ref(c).cast("string"))]
        rows = part.select(F.lit(title).alias("section"), F.concat_ws(" / ", *[ref(c) for c in labels]).alias("item"),
                           F.stack(F.lit(len(numbers) + len(texts)), *cells).alias("metric", "number", "text"))
        out = rows if out is None else out.unionByName(rows)
    return out
