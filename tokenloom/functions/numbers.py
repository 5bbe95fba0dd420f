"""Numeric expressions: finiteness, softmax pieces, exact shares."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(vector: Column) -> Column:
    """Whether a vector is there and holds only finite values."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def rounded(x: Column, places: int) -> Column:
    """x to some decimal places as SQL rounds doubles: halves of the product go away from zero, and zero keeps its sign."""
    scale = 10.0**places
    far = F.abs(x) * scale
    near = F.rint(far)
    found = F.signum(x) * F.when(far - near == 0.5, near + 1).otherwise(near) / scale
    return F.when(F.abs(found) < float("inf"), found).otherwise(x)


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exp over an array; minus infinity where all values are."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(top == float("-inf"), top).otherwise(top + F.ln(total))


def affine(x: Column, weight: Column, bias: Column) -> Column:
    """x . weight + bias, added up from the left."""
    return F.aggregate(F.zip_with(x, weight, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v) + bias


def mass_shift(ratio: float, most: Column) -> Column:
    """ln(ratio / most): how far biases of new rows move so that their mass stays below ratio."""
    if not (math.isfinite(ratio) and 0 < ratio < 1):
        raise ValueError("the ratio must be between 0 and 1")
    return F.ln(F.lit(ratio) / most)


def share_unit(longest: int, fallbacks: int) -> int:
    """A whole number that shares of 1 / length (lengths to `longest`) and 1 / fallbacks divide."""
    return math.lcm(*range(1, max(1, longest) + 1)) * max(1, fallbacks)
