"""Keys held in file paths.

``<tool>.parquet`` is one file per tool; ``<tool>/<name>.parquet`` names an hour; and
``<tool>/YYYY/MM/DD/HH.parquet`` spells it out as folders. A folder may be named
``tool_id=<tool>``, as partitioned writes do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def relative_path(path: Column, root: str) -> Column:
    """The part of a file's path below ``root``."""
    base = re.sub(r"^file:/+", "/", root).rstrip("/") + "/"
    return F.substring(path, F.instr(path, base) + F.lit(len(base)), F.length(path))


def tool_of(relative: Column) -> Column:
    return F.regexp_replace(F.substring_index(relative, "/", 1), r"^tool_id=|\.parquet$", "")


def hour_bucket_of(relative: Column) -> Column:
    """Hour text of a nested file; NULL for one file per tool."""
    dated = r"/(\d{4})/(\d{2})/(\d{2})/(\d{2})\.parquet$"
    stem = F.regexp_replace(F.substring_index(relative, "/", -1), r"\.parquet$", "")
    return F.when(
        relative.rlike(dated),
        F.regexp_replace(F.regexp_substr(relative, F.lit(dated)), dated, "$1-$2-$3T$4"),
    ).when(F.contains(relative, F.lit("/")), stem)
