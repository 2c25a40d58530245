"""Numeric predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; false for NULL, NaN and both infinities.

    Spark orders NaN above infinity, so one comparison covers all three.
    """
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))
