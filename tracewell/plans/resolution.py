"""Bucket width from the requested range and the view's point budget."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from tracewell.functions.time import epoch_micros

# Points per chart for each view, and the budget for any other view.
POINT_BUDGET = {"overview": 100, "standard": 2000, "focus": 5000}
DEFAULT_POINT_BUDGET = 2000
# 1 s, 10 s, 1 min, 5 min, 1 h, 1 d.
BUCKET_LADDER_SECONDS = (1, 10, 60, 300, 3600, 86400)


def points_for_mode(mode: str | Column) -> int | Column:
    """Point budget of a view, for a plain string or for a column of view names."""
    if isinstance(mode, str):
        return POINT_BUDGET.get(mode, DEFAULT_POINT_BUDGET)
    budget = F.lit(DEFAULT_POINT_BUDGET)
    for name, points in POINT_BUDGET.items():
        budget = F.when(mode == name, F.lit(points)).otherwise(budget)
    return budget


def bucket_seconds(start: datetime, end: datetime, mode: str = "standard") -> int:
    """Ladder step for one range: the smallest that keeps within the budget, else the largest."""
    wanted = (end - start).total_seconds() / points_for_mode(mode)
    fitting = (step for step in BUCKET_LADDER_SECONDS if step >= wanted)
    return next(fitting, BUCKET_LADDER_SECONDS[-1])


def bucket_seconds_column(start: Column, end: Column, mode: Column) -> Column:
    """The same choice for every row of a selection table."""
    span_micros = epoch_micros(end) - epoch_micros(start)
    points = points_for_mode(mode)
    choice = F.lit(BUCKET_LADDER_SECONDS[-1])
    for step in reversed(BUCKET_LADDER_SECONDS[:-1]):
        fits = span_micros <= points.cast("long") * F.lit(step * 1_000_000).cast("long")
        choice = F.when(fits, F.lit(step)).otherwise(choice)
    return choice


def extent_seconds_column(start: Column, end: Column, points: int) -> Column:
    """Free width ``max(1, round(span / points))`` with ties going to the even second."""
    span = (epoch_micros(end) - epoch_micros(start)) / 1_000_000
    return F.greatest(F.lit(1).cast("long"), F.bround(span / points).cast("long"))
