"""Distribution functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Abramowitz and Stegun 7.1.26, error function.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]

# P. J. Acklam's rational approximation of the normal quantile.
QUANTILE_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
              1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
QUANTILE_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
              6.680131188771972e+01, -1.328068155288572e+01, 1.0]
QUANTILE_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
              -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
QUANTILE_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
              3.754408661907416e+00, 1.0]
QUANTILE_TAIL = 0.02425

# Lanczos coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7]


def _horner(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    tail = _horner(list(reversed(ERF_A)), t) * t * F.exp(-x * x)
    return F.when(z >= 0, 1.0 - 0.5 * tail).otherwise(0.5 * tail)


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    middle = _horner(QUANTILE_A, r) * q / _horner(QUANTILE_B, r)
    low = F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
    tail = _horner(QUANTILE_C, low) / _horner(QUANTILE_D, low)
    return (F.when(p < QUANTILE_TAIL, tail)
            .when(p > 1.0 - QUANTILE_TAIL, -tail)
            .otherwise(middle))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic."""
    root = F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    lam = (root + 0.12 + 0.11 / root) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0)
        * F.exp(-2.0 * k.cast("double") * k.cast("double") * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def chi2_pvalue(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution; null when ``df`` is not positive."""
    a, h = df.cast("double") / 2.0, x / 2.0
    far = h > a + 25.0 * F.sqrt(a) + 60.0
    terms = (F.lit(120.0) + F.greatest(F.lit(0.0), h - a) + 12.0 * F.sqrt(h + a)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        term = acc["term"] * h / (a + k.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["total"])
    lower = F.exp(-h + a * F.ln(h) - log_gamma(a + 1.0)) * total
    return (F.when(df <= 0, F.lit(None).cast("double"))
            .when(x <= 0, 1.0).when(far, 0.0)
            .otherwise(F.greatest(F.lit(0.0), 1.0 - lower)))
