from tracewell.plans.query_plan import (
    displayed_columns,
    expand_selection,
    missing_mappings,
    plan_columns,
    plan_metrics,
    resolve_columns,
)
from tracewell.plans.resolution import (
    BUCKET_LADDER_SECONDS,
    POINT_BUDGET,
    bucket_seconds,
    bucket_seconds_column,
    points_for_mode,
)
from tracewell.plans.status import tool_status

__all__ = [
    "BUCKET_LADDER_SECONDS",
    "POINT_BUDGET",
    "bucket_seconds",
    "bucket_seconds_column",
    "displayed_columns",
    "expand_selection",
    "missing_mappings",
    "plan_columns",
    "plan_metrics",
    "points_for_mode",
    "resolve_columns",
    "tool_status",
]
