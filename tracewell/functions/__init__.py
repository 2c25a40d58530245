from tracewell.functions.numeric import is_finite
from tracewell.functions.text import display_label, fold_case
from tracewell.functions.time import (
    bucket_start,
    bucket_start_by,
    epoch_micros,
    hour_floor,
    in_range,
    iso_text,
    iso_text_ns,
    micros_to_ts,
    ns_to_ts,
    utc_literal,
)

__all__ = [
    "bucket_start",
    "bucket_start_by",
    "display_label",
    "epoch_micros",
    "fold_case",
    "hour_floor",
    "in_range",
    "is_finite",
    "iso_text",
    "iso_text_ns",
    "micros_to_ts",
    "ns_to_ts",
    "utc_literal",
]
