"""Align the series of several tools on time into one wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.text import (
    boolean_text,
    float_text,
    scientific_digits,
    scientific_exponent,
    scientific_text,
)
from tracewell.functions.time import iso_text


def align_wide(
    result: DataFrame, tools: list[str] | dict[str, list[str]], time_column: str = "bucket"
) -> DataFrame:
    """Full outer alignment of a wide result on its time column.

    Columns are ``ts`` and ``{tool}.{column}``, by tool, then in the order listed. ``tools`` maps
    each tool to its own columns of the result; a plain list gives every tool all of them. Tools
    that failed are left out by not naming them. The caller names the tools, so no extra job has
    to find them, and all is one aggregate keyed on time.
    """
    values = [c for c in result.columns if c not in ("tool_id", time_column)]
    own = tools if isinstance(tools, dict) else dict.fromkeys(tools, values)
    cells = [
        F.first(F.when(F.col("tool_id") == tool, _quoted(c)), ignorenulls=True).alias(f"{tool}.{c}")
        for tool in sorted(own)
        for c in own[tool]
    ]
    scoped = result.where(F.col("tool_id").isin(list(own))).groupBy(
        _quoted(time_column).alias("ts")
    )
    return scoped.agg(*cells) if cells else scoped.agg(F.count("*")).select("ts")


def as_csv_text(rows: DataFrame) -> DataFrame:
    """Every cell as the text the CSV sinks write; NULL becomes the empty string.

    Timestamps are ISO-8601 UTC. Floating point text is built in three projections, so that
    the digits found by the first are computed once and not wherever they are used.
    """
    kinds = {field.name: field.dataType.typeName() for field in rows.schema.fields}
    floats = {name: i for i, name in enumerate(kinds) if kinds[name] in ("double", "float")}
    values = {name: _quoted(name).cast("double") for name in floats}
    found = rows.withColumns(
        {f"__sci_{i}": scientific_text(values[name]) for name, i in floats.items()}
    )
    split = found.withColumns(
        {f"__digits_{i}": scientific_digits(F.col(f"__sci_{i}")) for i in floats.values()}
        | {f"__exp_{i}": scientific_exponent(F.col(f"__sci_{i}")) for i in floats.values()}
    )
    cells = []
    for name, kind in kinds.items():
        if name in floats:
            i = floats[name]
            text = float_text(values[name], F.col(f"__digits_{i}"), F.col(f"__exp_{i}"))
        elif kind.startswith("timestamp"):
            text = iso_text(_quoted(name))
        elif kind == "boolean":
            text = boolean_text(_quoted(name))
        else:
            text = _quoted(name).cast("string")
        cells.append(F.coalesce(text, F.lit("")).alias(name))
    return split.select(*cells)


def _quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")
