"""How close synthetic rows come to source rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from mirrortab.functions.draws import SPAN, bits
from mirrortab.functions.values import as_number, is_number, missing_to_null, ref, type_of
from mirrortab.operators.classify import common_columns
from mirrortab.operators.frequency import medians
from mirrortab.operators.neighbours import apart, near_points, near_rows
from mirrortab.operators.ordering import BROADCAST_BYTES, BROADCAST_ROWS, bottom_k, cut_lineage, dense_index, skew_join

THRESHOLD = 0.05
SAMPLE = 500
PAIRS_SHOWN = 10
MISSING = "__missing__"

# Report wording.
DISCLAIMER = (
    "The figures are hints, found by comparing rows. They say nothing about attacks that use other knowledge, and they neither "
    "prove anonymity nor replace a review of the source, the model and its settings.")
INTERPRETATIONS = {
    "Low": "Few synthetic rows equal or resemble a source row.",
    "Medium": "A noticeable part of the synthetic rows resembles source rows; look at the listed pairs before sharing.",
    "High": "Many synthetic rows repeat source rows, as a model does that has learned them by heart; "
            "do not share them before someone responsible for the source has looked at them.",
}


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the row's cells as text, each with its length, so that no two rows run together."""
    cells = []
    for c in columns:
        text = missing_to_null(df, c).cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*cells), 256))


def exact_duplicates(source: DataFrame, synthetic: DataFrame) -> DataFrame:
    """One row: synthetic rows, counted with repetition, that occur in the source.

    Both sides are counted per row digest in one aggregation, so copies collapse before the shuffle
    and whole texts never travel.
    """
    columns = common_columns(source, synthetic)
    if not columns:
        return source.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("exact_duplicates"))
    both = (source.select(row_digest(source, columns).alias("row"), F.lit(1).alias("s"), F.lit(0).alias("y"))
            .unionByName(synthetic.select(row_digest(synthetic, columns).alias("row"), F.lit(0).alias("s"),
                                          F.lit(1).alias("y"))))
    per_row = both.groupBy("row").agg(F.max("s").alias("s"), F.sum("y").alias("y"))
    return per_row.agg(F.coalesce(F.sum(F.when(F.col("s") == 1, F.col("y"))), F.lit(0).cast("bigint"))
                       .alias("exact_duplicates"))


def _scaled(c: Column, fill, low, high) -> Column:
    if low is None or high is None or not high > low:
        return F.lit(0.0)
    return (F.coalesce(c, F.lit(fill)) - F.lit(low)) / F.lit(high - low)


def minmax_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns scaled to [0, 1], missing values at the median; a constant column becomes 0."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[f(as_number(df, c)).alias(f"{n}{i}") for i, c in enumerate(columns)
                                                    for n, f in (("lo", F.min), ("hi", F.max), ("known", F.count))]).first()
    middle = medians(df, [c for i, c in enumerate(columns) if row[f"known{i}"] < row["rows"]])
    new = {c: _scaled(as_number(df, c), middle.get(c), row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
    return df.select([new[c].alias(c) if c in new else ref(c) for c in df.columns])


def _label(df: DataFrame, column: str) -> Column:
    return F.coalesce(missing_to_null(df, column).cast("string"), F.lit(MISSING))


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, code, labels): place of each distinct label of a column in sorted order, over the number of its labels.

    One dictionary for all columns: the distinct cells are numbered in the order of column and label, and a
    column's first number is taken off. What is broadcast is one row per column.
    """
    cells = [x for c in columns for x in (F.lit(c), _label(df, c))]
    seen = df.select(F.stack(F.lit(len(columns)), *cells).alias("column", "label")).distinct()
    placed = dense_index(seen, ["column", "label"], "place")
    extent = placed.groupBy("column").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("labels"))
    code = (F.col("place") - F.col("first")) / F.col("labels").cast("double")
    return placed.join(F.broadcast(extent), "column").select("column", "label", code.alias("code"), "labels")


def label_encode(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The named columns as label codes. Few labels are broadcast; many are joined, hot ones split."""
    return _label_encoded(df, columns, key)[0]


def _label_encoded(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`label_encode`, and the number of labels of each column."""
    if not columns:
        return df, {}
    codes = label_codes(df, columns)
    extents = {r["column"]: r for r in codes.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("label")).alias("bytes")).collect()}
    out = df
    for c in columns:
        mine = codes.where(F.col("column") == c).select("label", "code")
        here = out.withColumn("label", _label(df, c))
        extent = extents.get(c)
        if extent is None or extent["rows"] <= BROADCAST_ROWS and (extent["bytes"] or 0) <= BROADCAST_BYTES:
            joined = here.join(F.broadcast(mine), "label", "left")
        else:
            joined = skew_join(here, mine, "label", F.struct(*[ref(k) for k in key]), how="left")
        out = joined.select([F.col("code").alias(c) if n == c else ref(n) for n in out.columns])
    return out, {c: e["rows"] for c, e in extents.items()}


@dataclass
class Encoded:
    """(side, idx, features) of all rows of two tables, side 0 the source; ``steps`` has the smallest gap between different values
    of each feature where it is known."""
    rows: DataFrame
    steps: list[float | None]


def encoded_rows(source: DataFrame, synthetic: DataFrame, key: str, columns: Sequence[str], independent: bool = False) -> Encoded:
    """All rows of both tables as points; idx is the key.

    Scales, medians and labels are fitted on both tables together, or per side when ``independent``.
    """
    numbers = [c for c in columns if is_number(type_of(source, c))]
    texts = [c for c in columns if c not in numbers]
    # Names of their own, so that no column of the tables can clash with side and idx.
    names = {c: f"x{i}" for i, c in enumerate(columns)}

    def side(df: DataFrame, which: int) -> DataFrame:
        return df.select(F.lit(which).alias("side"), ref(key).alias("idx"),
                         *[(as_number(df, c) if c in numbers else _label(df, c)).alias(names[c]) for c in columns])

    both = cut_lineage(side(source, 0).unionByName(side(synthetic, 1)))
    groups = [both.where("side = 0"), both.where("side = 1")] if independent else [both]
    out, steps = None, {}
    for rows in groups:
        scaled = minmax_encode(rows, [names[c] for c in numbers]) if numbers else rows
        coded, sizes = _label_encoded(scaled, [names[c] for c in texts], ["idx"])
        if not independent:
            steps = {n: 1.0 / k for n, k in sizes.items()}
        points = coded.select("side", "idx", F.array(*[F.col(names[c]).cast("double") for c in columns]).alias("features"))
        out = points if out is None else out.unionByName(points)
    return Encoded(cut_lineage(out), [steps.get(names[c]) for c in columns])


def near_counts(points: DataFrame) -> DataFrame:
    """One row: synthetic rows near a source row, and the different points they lie at."""
    return points.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("near_duplicates"), F.count(F.lit(1)).alias("near_points"))


def sample_rows(df: DataFrame, key: str, size: int = SAMPLE, score: Column | None = None,
                span: int = SPAN) -> DataFrame:
    """Exactly min(size, rows) rows without replacement, the same for any partitioning."""
    score = bits(42, "sample", ref(key)) if score is None else score
    return bottom_k(df, size, score, span, [key])


def encoded_samples(source: DataFrame, synthetic: DataFrame, key: str, columns: Sequence[str], size: int = SAMPLE,
                    score: Callable[[Column], Column] | None = None, span: int = SPAN,
                    independent: bool = False) -> DataFrame:
    """(side, idx, features): up to ``size`` rows per side, encoded; side 0 is the source.

    Scales and labels are fitted on both samples together, or per side when ``independent``.
    """
    rank_score = (lambda k: bits(42, "sample", k)) if score is None else score

    def side(df: DataFrame, which: int) -> DataFrame:
        picked = sample_rows(df.select([ref(c) for c in dict.fromkeys([key, *columns])]), key, size,
                             rank_score(ref(key)), span)
        order = Window.partitionBy("side").orderBy(rank_score(F.col("_key")), "_key")
        return (picked.select(F.lit(which).alias("side"), ref(key).alias("_key"),
                              *[(as_number(df, c) if is_number(type_of(df, c)) else _label(df, c)).alias(c)
                                for c in columns])
                .withColumn("idx", (F.row_number().over(order) - 1).cast("bigint")).drop("_key"))

    # Two samples of bounded size, written once so that the tables are scanned for them only once.
    both = cut_lineage(side(source, 0).unionByName(side(synthetic, 1)))
    numbers = [c for c in columns if is_number(type_of(source, c))]
    group = F.col("side") if independent else F.lit(0)
    fits = both.groupBy(group.alias("g")).agg(
        *[f(ref(c)).alias(f"{n}{i}") for i, c in enumerate(numbers)
          for n, f in (("lo", F.min), ("hi", F.max), ("mid", F.median))], F.count(F.lit(1)).alias("rows")).collect()

    def feature(c: str) -> Column:
        if c in numbers:
            i = numbers.index(c)
            per_group = F.when(F.lit(False), F.lit(0.0))
            for fit in fits:
                per_group = per_group.when(group == F.lit(fit["g"]),
                                           _scaled(ref(c), fit[f"mid{i}"], fit[f"lo{i}"], fit[f"hi{i}"]))
            return per_group
        labels = Window.partitionBy(group)
        place = F.dense_rank().over(labels.orderBy(ref(c))) - 1
        return place / F.col(f"_classes_{columns.index(c)}")

    counted = both
    for c in columns:
        if c not in numbers:
            counted = counted.withColumn(f"_rank_{columns.index(c)}",
                                         F.dense_rank().over(Window.partitionBy(group).orderBy(ref(c))))
            counted = counted.withColumn(f"_classes_{columns.index(c)}",
                                         F.max(f"_rank_{columns.index(c)}").over(Window.partitionBy(group)))
    return counted.select("side", "idx", F.array(*[feature(c).cast("double") for c in columns]).alias("features"))


def nearest_source(encoded: DataFrame) -> DataFrame:
    """(synth_idx, nearest_source_idx, distance) within the two bounded samples.

    The source sample is one array of at most ``SAMPLE`` rows that every synthetic row looks through.
    """
    points = (encoded.where(F.col("side") == 0)
              .agg(F.collect_list(F.struct("idx", "features")).alias("points")))
    rows = encoded.where(F.col("side") == 1).select("idx", "features").withColumn("points", points.scalar())

    best = F.array_min(F.transform("points", lambda p: F.struct(apart(p["features"], F.col("features")).alias("distance"), p["idx"].alias("at"))))
    return (rows.select(F.col("idx").alias("synth_idx"), best.alias("best"))
            .select("synth_idx", F.col("best.at").alias("nearest_source_idx"), F.col("best.distance").alias("distance")))


def near_duplicates(nearest: DataFrame, synthetic_rows: int, threshold: float = THRESHOLD) -> DataFrame:
    """One row: near duplicates in the sample, and that number scaled to the whole synthetic table."""
    hits = F.count(F.when(F.col("distance") < threshold, 1))
    sampled = F.count(F.lit(1))
    scaled = F.coalesce(F.rint(F.try_divide(hits * F.lit(float(synthetic_rows)), sampled)), F.lit(0.0))
    return nearest.agg(hits.alias("sample_near_duplicates"), scaled.cast("bigint").alias("near_duplicates"))


def near_duplicate_pairs(nearest: DataFrame, threshold: float = THRESHOLD, k: int = PAIRS_SHOWN) -> DataFrame:
    """The first ``k`` pairs under the threshold, in the order of the synthetic sample."""
    return (nearest.where(F.col("distance") < threshold).orderBy("synth_idx").limit(k)
            .select("synth_idx", "nearest_source_idx", F.round("distance", 4).alias("distance")))


def risk_level(exact: Column, near: Column, synthetic_rows: Column) -> Column:
    exact_rate, near_rate = F.try_divide(exact, synthetic_rows), F.try_divide(near, synthetic_rows)
    return (F.when(synthetic_rows == 0, "Unknown")
            .when((exact_rate > 0.01) | (near_rate > 0.05), "High")
            .when((exact_rate > 0.001) | (near_rate > 0.02), "Medium").otherwise("Low"))


def privacy_report(exact: int, near: int, source_rows: int, synthetic_rows: int, spark, sampled: int | None = None) -> DataFrame:
    """One row: counts, rates, risk level and its wording; ``sampled`` is the number of rows a side that near duplicates were looked for in, if not all."""
    counts = spark.createDataFrame(
        [(exact, near, source_rows, synthetic_rows)],
        "exact_duplicates bigint, near_duplicates bigint, total_source_records bigint, total_synthetic_records bigint")
    total = F.col("total_synthetic_records")
    level = risk_level(F.col("exact_duplicates"), F.col("near_duplicates"), total)

    def rate(c: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(c), total) * 100, 4), F.lit(0.0))

    words = F.create_map(*[F.lit(x) for item in INTERPRETATIONS.items() for x in item])
    return counts.withColumn("risk_level", level).select(
        "exact_duplicates", "near_duplicates", "risk_level", rate("exact_duplicates").alias("exact_duplicate_rate_pct"),
        rate("near_duplicates").alias("near_duplicate_rate_pct"), F.lit(THRESHOLD).alias("near_duplicate_threshold"),
        F.lit("all rows" if sampled is None else f"estimated from samples of {sampled} rows a side").alias("near_duplicate_basis"),
        "total_source_records", "total_synthetic_records",
        F.coalesce(F.try_element_at(words, F.col("risk_level")), F.lit("")).alias("risk_interpretation"),
        F.lit(DISCLAIMER).alias("disclaimer"))
