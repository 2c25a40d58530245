"""Saved selections: parsing, listing, expansion and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTS = ("tools", "sensors_canonical", "sensors_raw")


def parse_saved_sets(rows: DataFrame) -> DataFrame:
    """``set_id, name, payload`` to arrays; a part the payload lacks is empty."""
    parsed = rows.withColumn("doc", F.try_parse_json("payload"))
    parts = [
        F.coalesce(
            F.try_variant_get("doc", f"$.{part}", "array<string>"), F.array().cast("array<string>")
        ).alias(part)
        for part in PARTS
    ]
    return parsed.select("set_id", "name", *parts)


def encode_saved_sets(sets: DataFrame) -> DataFrame:
    """Arrays back to ``set_id, name, payload``, the text that :func:`parse_saved_sets` reads."""
    return sets.select("set_id", "name", F.to_json(F.struct(*PARTS)).alias("payload"))


def by_name() -> list[Column]:
    """Listing order: name without regard to case."""
    return [F.lower("name"), F.col("set_id")]


def tool_sensor_pairs(sets: DataFrame) -> DataFrame:
    """Every tool with every sensor of a set, from the set's own arrays."""
    per_tool = sets.select(
        "set_id",
        F.explode("tools").alias("tool_id"),
        F.size("sensors_canonical").alias("n_canonical"),
        F.concat("sensors_canonical", "sensors_raw").alias("names"),
    )
    return per_tool.select(
        "set_id", "tool_id", "n_canonical", F.posexplode("names").alias("ord", "sensor")
    ).select(
        "set_id",
        "tool_id",
        F.when(F.col("ord") < F.col("n_canonical"), "canonical").otherwise("raw").alias("kind"),
        "sensor",
    )


def add_set(current: DataFrame, sets: DataFrame) -> DataFrame:
    """Add a saved set to each current selection: sorted union of every part.

    ``current`` holds ``selection_id, set_id`` and the three array parts.
    """
    joined = current.alias("c").join(sets.alias("s"), "set_id")
    return joined.select(
        "selection_id",
        *[F.array_sort(F.array_union(f"c.{p}", f"s.{p}")).alias(p) for p in PARTS],
    )


def replace_with_set(current: DataFrame, sets: DataFrame) -> DataFrame:
    """Replace each current selection's parts by those of the chosen set."""
    return current.select("selection_id", "set_id").join(sets, "set_id").select(
        "selection_id", *PARTS
    )
