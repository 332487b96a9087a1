"""Cohort requirements as boolean columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mirrortab import rules
from mirrortab.functions.values import as_number, is_number, is_text, missing_to_null, ref, type_of

# Accepted spellings of each comparison.
OPERATORS = {
    "gt": ["greater_than", "gt", ">"],
    "lt": ["less_than", "lt", "<"],
    "ge": ["gte", "greater_than_or_equal", ">="],
    "le": ["lte", "less_than_or_equal", "<="],
    "eq": ["equal", "eq", "equals", "=", "=="],
    "ne": ["not_equal", "ne", "!="],
    "between": ["between"],
    "in": ["in_values", "in"],
}
SPELLINGS = {word: name for name, words in OPERATORS.items() for word in words}
ORDERINGS = {"gt", "lt", "ge", "le", "between"}
NUMERIC_SHARE = 0.9


@dataclass(frozen=True)
class Requirement:
    """Rows where ``feature operator value`` holds shall make up ``target_proportion`` of the result."""

    feature: str
    operator: str
    value: Any
    target_proportion: float
    label: str | None = None
    key: str | None = None

    @property
    def shown_label(self) -> str:
        return self.label or f"{self.feature} {self.operator} {self.value}"


def operator_name(operator: str) -> str | None:
    return SPELLINGS.get(operator.lower().strip())


def truth_of(value: Any) -> bool:
    if not isinstance(value, str):
        return bool(value)
    word = value.lower().strip()
    return word in rules.TRUE_WORDS or word == "1.0"


def numbers_of(values: Sequence[Any]) -> list[float]:
    """The items as numbers; one that is none is an error, as it is in every other comparison."""
    out = []
    for v in values:
        try:
            out.append(float(v))
        except (TypeError, ValueError):
            raise ValueError(f"not a number in a list of numbers: {v!r}") from None
    return out


def compare_numbers(c: Column, op: str, value: Any) -> Column:
    if op == "in":
        hit = c.isin(numbers_of(value))
    elif op == "between":
        hit = c.between(float(value[0]), float(value[1]))
    else:
        v = F.lit(float(value))
        hit = {"gt": c > v, "lt": c < v, "ge": c >= v, "le": c <= v, "eq": c == v, "ne": c != v}[op]
    return F.coalesce(hit, F.lit(op == "ne"))


def compare_truth(c: Column, op: str, value: Any) -> Column:
    if op == "in":
        return F.coalesce(c.isin([truth_of(v) for v in value]), F.lit(False))
    if op in ("eq", "ne"):
        hit = c == F.lit(truth_of(value))
        return F.coalesce(hit if op == "eq" else ~hit, F.lit(op == "ne"))
    return compare_numbers(c.cast("int").cast("double"), op, value)


def compare_text(c: Column, op: str, value: Any) -> Column:
    word = F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("nan"))
    if op == "in":
        return word.isin([str(v).lower().strip() for v in value])
    hit = word == F.lit(str(value).lower().strip())
    return hit if op == "eq" else ~hit


def condition(df: DataFrame, feature: str, operator: str, value: Any) -> Column:
    """Never-null boolean column for ``feature operator value``.

    Ordering a text column needs to know whether it holds numbers: one pass over that column.
    """
    op, dtype = operator_name(operator), type_of(df, feature)
    if op is None:
        return F.lit(False)
    if isinstance(dtype, T.BooleanType):
        return compare_truth(ref(feature), op, value)
    if is_number(dtype):
        return compare_numbers(missing_to_null(df, feature), op, value)
    if op not in ORDERINGS:
        return compare_text(ref(feature), op, value)
    number = as_number(df, feature)
    if is_text(dtype):
        share = df.agg(F.avg(number.isNotNull().cast("double"))).first()[0]
        if share is not None and share >= NUMERIC_SHARE:
            return compare_numbers(number, op, value)
    return F.lit(False)
