"""Pseudo-random columns that depend on a row's key, never on its partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SPAN = 1 << 53


def bits(seed: int, tag: str, *key: Column) -> Column:
    """53 hash bits of (seed, tag, key) as a non-negative long."""
    return F.xxhash64(F.lit(seed), F.lit(tag), *key).bitwiseAND(F.lit(SPAN - 1))


def uniform(seed: int, tag: str, *key: Column) -> Column:
    """Uniform in the open interval (0, 1)."""
    return (bits(seed, tag, *key).cast("double") + 0.5) / float(SPAN)


def normal(seed: int, tag: str, *key: Column) -> Column:
    """Standard normal, by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(seed, f"{tag}/r", *key)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, f"{tag}/a", *key))


def hash_index(seed: int, tag: str, i: Column, size: Column) -> Column:
    """Draw number ``i`` as an index in [0, size)."""
    return F.least(F.floor(uniform(seed, tag, i) * size), size - 1).cast("bigint")


def linear_index(seed: int, tag: str, i: Column, size: Column) -> Column:
    """The same by plain arithmetic, for results that another engine has to repeat."""
    return F.pmod(i * F.lit(48271) + F.lit(12345), size).cast("bigint")


LINEAR_SPAN = 2147483647


def linear_score(key: Column) -> Column:
    """Arithmetic shuffle score in [0, LINEAR_SPAN)."""
    return F.pmod(key.cast("bigint") * F.lit(48271) + F.lit(12345), F.lit(LINEAR_SPAN))
