from tracewell.sources.checksum import audit_checksums, file_checksums
from tracewell.sources.files import (
    list_parquet,
    scan_changed,
    scan_files,
    scan_one,
    sensor_catalog,
)
from tracewell.sources.payloads import (
    parse_canonical,
    parse_categories,
    parse_manifest,
    parse_mappings,
    parse_sensors,
    parse_tool_groups,
)
from tracewell.sources.readings import (
    normalise_time,
    read_by_index,
    read_readings,
    read_selected,
)
from tracewell.sources.sinks import (
    read_partitioned,
    write_chart_csv,
    write_partitioned,
    write_report_json,
    write_table_csv,
)

__all__ = [
    "audit_checksums",
    "file_checksums",
    "list_parquet",
    "normalise_time",
    "parse_canonical",
    "parse_categories",
    "parse_manifest",
    "parse_mappings",
    "parse_sensors",
    "parse_tool_groups",
    "read_by_index",
    "read_partitioned",
    "read_readings",
    "read_selected",
    "scan_changed",
    "scan_files",
    "scan_one",
    "sensor_catalog",
    "write_chart_csv",
    "write_partitioned",
    "write_report_json",
    "write_table_csv",
]
