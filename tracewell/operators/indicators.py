"""What is doubtful in a mapping: empty cells, units that differ, raw names used twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def expected_units(cells: DataFrame, canonical: DataFrame, raw_units: DataFrame) -> DataFrame:
    """``prc_group_id, canonical_name, units, declared``: the units a canonical sensor should have.

    The catalog's own units if it names any, else the most frequent units of the raw sensors mapped
    to it, of equally frequent ones the first in code-point order. Votes are counted per sensor and
    unit before the most frequent is picked, so a name mapped on very many tools is combined on the
    map side. NULL where nothing names units.
    """
    names = ["prc_group_id", "canonical_name"]
    declared = canonical.groupBy(*names).agg(
        F.max_by("units", F.struct("ord", "pos")).alias("own"),
    )
    votes = (
        cells.where("raw_name IS NOT NULL")
        .join(_units(raw_units), ["tool_id", "raw_name"])
        .where("raw_unit IS NOT NULL")
        .groupBy(*names, "raw_unit")
        .agg(F.count("*").alias("n"))
        .groupBy(*names)
        .agg(F.min_by("raw_unit", F.struct(-F.col("n"), F.col("raw_unit"))).alias("usual"))
    )
    return declared.join(votes, names, "left").select(
        *names, F.coalesce("own", "usual").alias("units"), F.col("own").isNotNull().alias("declared")
    )


def _units(raw_units: DataFrame) -> DataFrame:
    """One row per tool and raw name; a name listed twice has its first units in code-point order."""
    return raw_units.groupBy("tool_id", "raw_name").agg(
        F.min(F.nullif("units", F.lit(""))).alias("raw_unit")
    )


def cell_indicators(cells: DataFrame, canonical: DataFrame, raw_units: DataFrame) -> DataFrame:
    """Every cell of the mapping matrix with ``state``: ``empty``, ``duplicate``, ``units_mismatch`` or ``ok``.

    ``cells(prc_group_id, canonical_name, tool_id, raw_name)`` as ``mapping_cells`` gives them,
    ``canonical`` and ``raw_units(tool_id, raw_name, units)`` as the catalogs do. ``duplicate``: the
    tool's raw name is mapped to several canonical names of the group. ``units_mismatch``: raw and
    expected units are both known and differ.
    """
    names = ["prc_group_id", "canonical_name"]
    used = (
        cells.where("raw_name IS NOT NULL")
        .groupBy("prc_group_id", "tool_id", "raw_name")
        .agg(F.count("*").alias("uses"))
    )
    expected = expected_units(cells, canonical, raw_units).withColumnRenamed("units", "expected")
    state = (
        F.when(F.col("raw_name").isNull(), "empty")
        .when(F.col("uses") > 1, "duplicate")
        .when(F.col("raw_unit") != F.col("expected"), "units_mismatch")
        .otherwise("ok")
    )
    return (
        cells.join(expected, names, "left")
        .join(_units(raw_units), ["tool_id", "raw_name"], "left")
        .join(used, ["prc_group_id", "tool_id", "raw_name"], "left")
        .select(*names, "tool_id", "raw_name", "raw_unit", "expected", state.alias("state"))
    )


def canonical_indicators(cells: DataFrame, canonical: DataFrame, raw_units: DataFrame) -> DataFrame:
    """Per canonical sensor how many cells have each state, and what its catalog entry lacks."""
    names = ["prc_group_id", "canonical_name"]
    states = cell_indicators(cells, canonical, raw_units).groupBy(*names).agg(
        F.count("*").alias("tools"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("empty", "duplicate", "units_mismatch", "ok")],
    )
    entries = canonical.groupBy(*names).agg(F.max_by("description", F.struct("ord", "pos")).alias("text"))
    return entries.join(states, names, "left").select(
        *names,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tools", "empty", "duplicate", "units_mismatch", "ok")],
        (F.coalesce("tools", F.lit(0)) == F.coalesce("empty", F.lit(0))).alias("unmapped"),
        F.col("text").isNull().alias("no_description"),
    )
