"""Sensor catalogs: mappings, process groups, categories, labels and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.text import display_label, fold_case

# Texts shown to the user.
UNMAPPED = "—"
NO_MAPPING = "(no mapping)"
RAW_CATEGORY = "All sensors (raw)"
NO_CATEGORY = "Other"
BREADCRUMB = "  /  "
SPREAD = 32


def latest_mapping(mappings: DataFrame) -> DataFrame:
    """The last entry per tool and canonical name, by document order, then position.

    An aggregate instead of a ranking window: a name repeated in a third of all entries is
    combined on the map side and never gathered in one task.
    """
    return mappings.groupBy("tool_id", "canonical_name").agg(
        F.max_by("raw_name", F.struct("ord", "pos")).alias("raw_name")
    )


def tool_groups(entries: DataFrame) -> DataFrame:
    """The first process group named for each tool."""
    return entries.groupBy("tool_id").agg(
        F.min_by("prc_group_id", F.struct("ord", "pos")).alias("prc_group_id")
    )


def latest_categories(categories: DataFrame) -> DataFrame:
    """The last entry per category id."""
    last = F.max_by(F.struct("name", "parent_id"), F.struct("ord", "pos")).alias("c")
    return categories.groupBy("category_id").agg(last).select(
        "category_id", "c.name", "c.parent_id"
    )


def process_groups(groups: DataFrame) -> DataFrame:
    return groups.select("prc_group_id").distinct()


def _with_tools(sensors: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Join sensors with the tools of their process group.

    Few groups hold all sensors, so a group's sensors are spread over ``SPREAD`` keys by the
    hash of their name, and its tools, the short side, go to every one of them.
    """
    spread = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_slot"))
    slot = F.pmod(F.hash(name), F.lit(SPREAD))
    return (
        sensors.withColumn("_slot", slot).join(spread, ["prc_group_id", "_slot"]).drop("_slot")
    )


def mapping_cells(canonical: DataFrame, groups: DataFrame, mapping: DataFrame) -> DataFrame:
    """The mapping matrix in long form: each group's canonical sensors by the group's tools."""
    return (
        canonical.select("prc_group_id", "canonical_name")
        .distinct()
        .transform(_with_tools, groups, "canonical_name")
        .join(mapping, ["tool_id", "canonical_name"], "left")
        .select("prc_group_id", "canonical_name", "tool_id", "raw_name")
    )


def mapping_matrix(
    canonical: DataFrame, mapping: DataFrame, tools: list[str]
) -> DataFrame:
    """One row per canonical sensor, one column per tool, ``—`` where unmapped.

    Only existing mappings are pivoted and the catalog is joined to the result, so empty cells
    cost nothing before the last projection. Name tools in blocks when they are very many, or
    use :func:`mapping_cells`, which has a row per tool.
    """
    known = (
        mapping.groupBy("canonical_name").pivot("tool_id", tools).agg(F.first("raw_name"))
    )
    return (
        canonical.select("canonical_name")
        .distinct()
        .join(known, "canonical_name", "left")
        .select("canonical_name", *[F.coalesce(f"`{t}`", F.lit(UNMAPPED)).alias(t) for t in tools])
    )


def mapping_lines(cells: DataFrame) -> DataFrame:
    """``tool → raw`` lines per canonical sensor, by tool; one line per tool of the group."""
    line = F.concat(
        F.col("tool_id"), F.lit(" → "), F.coalesce("raw_name", F.lit(NO_MAPPING))
    )
    return cells.groupBy("prc_group_id", "canonical_name").agg(
        F.concat_ws(
            "\n",
            F.transform(
                F.array_sort(F.collect_list(F.struct("tool_id", line.alias("line")))),
                lambda entry: entry["line"],
            ),
        ).alias("lines")
    )


def canonical_labels(canonical: DataFrame, categories: DataFrame) -> DataFrame:
    """Picker rows of canonical sensors with their category's name, or its id, or ``Other``."""
    names = categories.select("category_id", F.col("name").alias("category_name"))
    return canonical.join(names, "category_id", "left").select(
        "prc_group_id",
        F.col("canonical_name").alias("sensor"),
        display_label(F.col("canonical_name"), F.col("units")).alias("label"),
        F.coalesce("category_name", "category_id", F.lit(NO_CATEGORY)).alias("category"),
        F.col("category_id").isNull().alias("uncategorised"),
        F.coalesce("units", F.lit("")).alias("units"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def picker_order() -> list[Column]:
    """Categories by label with uncategorised last, then sensors by name."""
    return [F.col("tool_id"), F.col("uncategorised"), F.col("category"), F.col("sensor")]


def picker(
    tools: DataFrame, groups: DataFrame, labels: DataFrame, raw_catalog: DataFrame
) -> DataFrame:
    """Every tool's sensors: its group's canonical ones if there are any, else its raw columns."""
    canonical = (
        labels.transform(_with_tools, tools.select("tool_id").join(groups, "tool_id"), "sensor")
        .select(
            "tool_id", F.lit("canonical").alias("kind"), "sensor", "label", "category",
            "uncategorised", "units", "description",
        )
    )
    covered = groups.join(
        labels.select("prc_group_id").distinct(), "prc_group_id", "left_semi"
    ).select("tool_id")
    raw = (
        raw_catalog.join(tools.select("tool_id"), "tool_id", "left_semi")
        .join(covered, "tool_id", "left_anti")
        .select(
            "tool_id",
            F.lit("raw").alias("kind"),
            F.col("raw_name").alias("sensor"),
            display_label(F.col("raw_name"), F.col("units")).alias("label"),
            F.lit(RAW_CATEGORY).alias("category"),
            F.lit(False).alias("uncategorised"),
            F.coalesce("units", F.lit("")).alias("units"),
            F.lit("").alias("description"),
        )
    )
    return canonical.unionByName(raw)


def search(rows: DataFrame, needle: str) -> DataFrame:
    """Picker rows whose label, tool, sensor, units or description holds the text, caseless."""
    wanted = fold_case(F.lit(needle.strip()))
    hit = F.lit(not needle.strip())
    for column in ("label", "tool_id", "sensor", "units", "description"):
        hit = hit | F.contains(fold_case(F.coalesce(column, F.lit(""))), wanted)
    return rows.where(hit)


def search_results(rows: DataFrame, needle: str) -> DataFrame:
    """Hits with their ``tool / category / label`` path; a blank needle lists nothing."""
    hits = search(rows, needle) if needle.strip() else rows.where(F.lit(False))
    return hits.select(
        "tool_id",
        "sensor",
        F.concat_ws(BREADCRUMB, "tool_id", "category", "label").alias("breadcrumb"),
    )


def search_count(rows: DataFrame, needle: str) -> DataFrame:
    """How many rows the search lists, as one row ``hits``."""
    return search_results(rows, needle).agg(F.count("*").alias("hits"))


def selection_counts(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected and total sensors per tool, with the grand total on a NULL tool row.

    ``selected`` holds ``tool_id, kind, sensor``.
    """
    marks = selected.select("tool_id", "kind", "sensor", F.lit(True).alias("on")).distinct()
    return (
        rows.join(marks, ["tool_id", "kind", "sensor"], "left")
        .rollup("tool_id")
        .agg(F.count("on").alias("selected"), F.count("*").alias("total"))
    )
