"""Catalog and manifest JSON as tables.

Documents are parsed to VARIANT, so an element with a wrongly typed field drops out alone and
the rest of its document survives. Input frames hold the text in ``payload``; ``ord`` orders
documents and is carried along together with the element's own position ``pos``.

Fields are read in one projection and type-checked in the next, where only text that could stem
from a number, boolean, array or object has its JSON type looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

INTEGER_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT")


def parse_sensors(payloads: DataFrame) -> DataFrame:
    """``tool_id, payload`` with ``[{"name", "units"?}]`` to ``tool_id, raw_name, units``."""
    return _rows(
        payloads,
        "$",
        {"raw_name": "name", "units": "units"},
        required=("raw_name",),
        keep=("tool_id",),
    )


def parse_canonical(payloads: DataFrame) -> DataFrame:
    """``{"prc_group_id", "sensors": [...]}`` to one row per canonical sensor."""
    return _rows(
        payloads,
        "$.sensors",
        {
            "canonical_name": "name",
            "description": "description",
            "units": "units",
            "category_id": "category_id",
        },
        required=("canonical_name",),
        group=True,
    )


def parse_categories(payloads: DataFrame) -> DataFrame:
    """``{"categories": [{"id", "name", "parent_id"?}]}`` to one row per category."""
    return _rows(
        payloads,
        "$.categories",
        {"category_id": "id", "name": "name", "parent_id": "parent_id"},
        required=("category_id", "name"),
    )


def parse_mapping_entries(payloads: DataFrame) -> DataFrame:
    """``{"prc_group_id", "mappings": [...]}`` to one row per entry with a readable tool.

    Columns ``prc_group_id, tool_id, canonical_name, raw_name, ord, pos``, NULL where a field is
    absent or no text, ``raw_name`` also where it is empty. Mappings and process groups both come
    from here: store the entries once and take :func:`mappings_of` and :func:`tool_groups_of`.
    """
    return _rows(
        payloads,
        "$.mappings",
        {"tool_id": "tool_id", "canonical_name": "canonical_name", "raw_name": "raw_name"},
        required=("tool_id",),
        filled=("raw_name",),
        plain=("canonical_name",),
        group=True,
    )


def mappings_of(entries: DataFrame) -> DataFrame:
    """Entries that map a canonical name to a raw one."""
    return entries.where("canonical_name IS NOT NULL AND raw_name IS NOT NULL")


def tool_groups_of(entries: DataFrame) -> DataFrame:
    """``prc_group_id, tool_id`` of every entry of a document that names its group."""
    return entries.where("prc_group_id IS NOT NULL").select("prc_group_id", "tool_id", "ord", "pos")


def parse_mappings(payloads: DataFrame) -> DataFrame:
    """``{"prc_group_id", "mappings": [...]}`` to ``tool_id, canonical_name, raw_name``.

    Entries with an empty or wrongly typed name are dropped before any de-duplication.
    """
    return _rows(
        payloads,
        "$.mappings",
        {"tool_id": "tool_id", "canonical_name": "canonical_name", "raw_name": "raw_name"},
        required=("tool_id", "canonical_name", "raw_name"),
        filled=("raw_name",),
        group=True,
    )


def parse_tool_groups(payloads: DataFrame) -> DataFrame:
    """``tool_id, prc_group_id`` of every mapping entry with a readable tool, valid or not."""
    return _rows(
        payloads,
        "$.mappings",
        {"tool_id": "tool_id"},
        required=("tool_id",),
        group=True,
        grouped=True,
    )


def parse_manifest(payloads: DataFrame) -> DataFrame:
    """``{"files": [...]}`` to ``file_id, tool_id, url, sha256, size_bytes``."""
    entries = _rows(
        payloads,
        "$.files",
        {"declared": "file_id", "path": "path", "tool_id": "tool_id", "url": "url",
         "sha256": "sha256"},
        required=("tool_id",),
        extra={"blank_id": _is_blank_id, "size_bytes": _size},
    )
    file_id = F.when(F.col("blank_id"), F.col("path")).otherwise(F.col("declared"))
    fallback = F.concat(F.lit("/v1/data/"), F.ltrim(F.col("file_id"), F.lit("/")))
    return (
        entries.withColumn("file_id", file_id)
        .where(F.col("file_id").isNotNull())
        .select(
            "file_id", "tool_id", F.coalesce("url", fallback).alias("url"), "sha256",
            "size_bytes", "ord", "pos",
        )
    )


def _rows(
    payloads: DataFrame,
    path: str,
    texts: dict[str, str],
    *,
    required: tuple[str, ...],
    filled: tuple[str, ...] = (),
    plain: tuple[str, ...] = (),
    keep: tuple[str, ...] = (),
    group: bool = False,
    grouped: bool = False,
    extra: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One row per array element below ``path`` whose required fields are all readable.

    ``texts`` names the wanted text fields and their JSON keys. Optional fields, and those in
    ``filled``, read as NULL when empty, but not those in ``plain``. ``extra`` computes further
    fields from the element. With ``grouped`` the document has to name its process group.
    """
    extra = extra or {}
    parsed = payloads.select(*keep, "ord", F.try_parse_json("payload").alias("doc"))
    kept = [*keep, "ord"]
    if group:
        owner = F.try_variant_get("doc", "$.prc_group_id", "string")
        parsed = parsed.withColumn(
            "prc_group_id", _checked_text(owner, F.col("doc"), "prc_group_id")
        )
        kept.append("prc_group_id")
    items = F.try_variant_get("doc", path, "array<variant>")
    elements = parsed.select(*kept, F.posexplode(items).alias("pos", "element"))
    read = elements.select(
        *kept,
        "pos",
        "element",
        *[
            F.try_variant_get("element", f"$.{key}", "string").alias(name)
            for name, key in texts.items()
        ],
    )
    cells = []
    for name, key in texts.items():
        text = _checked_text(F.col(name), F.col("element"), key)
        optional = (name not in required or name in filled) and name not in plain
        cells.append((F.nullif(text, F.lit("")) if optional else text).alias(name))
    cells += [compute(F.col("element")).alias(name) for name, compute in extra.items()]
    checked = read.select(*kept, "pos", *cells)
    complete = F.col("prc_group_id").isNotNull() if grouped else F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    # As a generator the check stays above the projections; a filter would be pushed below them
    # and read every required field a second time.
    row = F.struct(*[c for c in checked.columns if c not in kept])
    return checked.select(*kept, F.inline(F.when(complete, F.array(row))))


def _checked_text(text: Column, element: Column, key: str) -> Column:
    """``text`` if the field it was read from is a JSON string, else NULL.

    Numbers start with a digit or minus, arrays and objects with a bracket.
    """
    first = F.ascii(text)
    certain = ~first.between(ord("-"), ord("9")) & ~first.isin(ord("["), ord("{"))
    certain = certain & ~text.isin("true", "false")
    declared = F.schema_of_variant(F.try_variant_get(element, f"$.{key}", "variant"))
    return F.when(certain, text).when(declared == "STRING", text)


def _is_blank_id(entry: Column) -> Column:
    """Whether ``file_id`` is absent or an empty, zero or false value, so ``path`` stands in.

    A filled ``file_id`` of another type makes the entry unusable.
    """
    declared = F.try_variant_get(entry, "$.file_id", "variant")
    text = F.to_json(declared)
    number = F.try_variant_get(entry, "$.file_id", "double")
    is_zero = ~text.startswith('"') & (text != "false") & (number == 0)
    blank = declared.isNull() | text.isin("null", '""', "false", "[]", "{}") | is_zero
    return F.coalesce(blank, F.lit(False))


def _size(entry: Column) -> Column:
    """``size_bytes`` truncated toward zero, true as 1, anything but a number as 0."""
    path = "$.size_bytes"
    kind = F.schema_of_variant(F.try_variant_get(entry, path, "variant"))
    number = (
        F.when(kind.isin(*INTEGER_TYPES), F.try_variant_get(entry, path, "bigint"))
        .when(kind == "BOOLEAN", F.try_variant_get(entry, path, "boolean").cast("long"))
        .when(
            kind.rlike("^(FLOAT|DOUBLE|DECIMAL)"),
            F.try_variant_get(entry, path, "double").cast("long"),
        )
    )
    return F.coalesce(number, F.lit(0).cast("long"))
