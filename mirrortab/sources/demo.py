"""Correlated demo patients; row i is the same for any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mirrortab.functions.draws import normal, uniform

# Age bands with their probabilities, effects and limits of the demo table.
AGE_LOW, AGE_SPAN = 18, 72
SEXES = [("Male", 0.48), ("Female", 0.96)]
DIABETES_BANDS = [(60, 0.35), (40, 0.18)]
DIABETES_REST = 0.06
SMOKER_BANDS = [(50, 0.25), (30, 0.18)]
SMOKER_REST = 0.10
FIRST_VISIT, VISIT_DAYS = "2022-01-01", 1095
MISSING_SHARE = 0.03
WITH_GAPS = ["BloodPressureSystolic", "BloodPressureDiastolic", "MedicationAdherence", "PainScore", "BMI", "HbA1c"]


def _banded(age: Column, bands, rest: float) -> Column:
    ladder = F.when(age >= bands[0][0], bands[0][1])
    for limit, p in bands[1:]:
        ladder = ladder.when(age >= limit, p)
    return ladder.otherwise(rest)


def _clipped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def demo_patients(spark: SparkSession, n: int = 2000, seed: int = 42) -> DataFrame:
    """12 columns with conditional distributions and about 3 % missing values in six of them."""
    return patients_for(spark.range(n), "id", seed).drop("id")


def patients_for(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One demo patient per row of ``ids``."""
    i = F.col(key)

    def u(tag: str) -> Column:
        return uniform(seed, tag, i)

    def z(tag: str, scale: float) -> Column:
        return normal(seed, tag, i) * scale

    base = ids.select(i, (F.floor(u("age") * AGE_SPAN) + AGE_LOW).cast("int").alias("Age"), u("sex").alias("_s"))
    age = F.col("Age")
    people = base.select(
        i, "Age", F.when(F.col("_s") < SEXES[0][1], "Male").when(F.col("_s") < SEXES[1][1], "Female")
        .otherwise("Other").alias("Sex"),
        (u("diabetes") < _banded(age, DIABETES_BANDS, DIABETES_REST)).alias("Diabetes"),
        (u("smoker") < _banded(age, SMOKER_BANDS, SMOKER_REST)).alias("_smoker"))
    sick = F.col("Diabetes").cast("int")
    raw = F.when(age >= 60, 1.2).when(F.col("Diabetes"), 1.5).otherwise(2.2) + z("activity", 0.6)
    active = people.withColumn("_a", raw).withColumn(
        "ActivityLevel", F.when(F.col("_a") < 1.0, "Low").when(F.col("_a") < 1.8, "Medium").otherwise("High"))
    level = F.when(F.col("ActivityLevel") == "Low", 1.8).when(F.col("ActivityLevel") == "High", -0.8).otherwise(0.4)
    pain = F.round(_clipped(1.5 + 0.03 * (age - 18) + 1.5 * sick + level + z("pain", 1.2), 0, 10), 1)
    scored = active.withColumn("PainScore", pain)
    full = scored.select(
        i, "Age", "Sex", "Diabetes",
        _clipped(F.round(100 + 0.4 * age + 10 * sick + z("systolic", 10.0), 1), 80, 200).alias("BloodPressureSystolic"),
        _clipped(F.round(60 + 0.15 * age + 5 * sick + z("diastolic", 6.0), 1), 40, 130).alias("BloodPressureDiastolic"),
        "ActivityLevel",
        _clipped(F.round(80 - 0.5 * F.col("PainScore") + z("adherence", 12.0), 1), 0, 100).alias("MedicationAdherence"),
        "PainScore",
        _clipped(F.round(22 + 0.05 * age + 3 * sick + z("bmi", 3.5), 1), 14, 55).alias("BMI"),
        _clipped(F.round(5.0 + 1.8 * sick + 0.01 * age + z("hba1c", 0.5), 2), 4.0, 12.0).alias("HbA1c"),
        F.when(F.col("_smoker"), "Smoker").otherwise("Non-Smoker").alias("SmokingStatus"),
        F.date_format(F.date_add(F.lit(FIRST_VISIT).cast("date"), F.floor(u("visit") * VISIT_DAYS).cast("int")),
                      "yyyy-MM-dd").alias("VisitDate"))
    return full.select([F.when(u(f"gap/{c}") >= MISSING_SHARE, F.col(c)).alias(c) if c in WITH_GAPS else F.col(c)
                        for c in full.columns])
