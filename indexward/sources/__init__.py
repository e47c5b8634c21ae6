"""Readers and writers."""

from .catalog import (
    load_activity, load_activity_jdbc, load_catalog, load_catalog_jdbc, load_catalog_tables, save_catalog_tables, with_scan_compat,
)
from .logs import read_log_json, read_log_text, to_log_json, to_log_text
from .plan_files import plan_csv_lines, write_plan, write_plan_csv, write_plan_json
from .scratch import drop_scratch, materialize, scratch_dir, scratch_path
from .tables import append_logbook, drop_old_versions, read_logbook, read_state, state_version, update_state, write_state

__all__ = [
    "append_logbook", "drop_old_versions", "drop_scratch", "load_activity", "load_activity_jdbc", "load_catalog", "load_catalog_jdbc", "load_catalog_tables", "materialize", "plan_csv_lines",
    "read_log_json", "read_log_text", "read_logbook", "read_state", "save_catalog_tables", "scratch_dir", "scratch_path", "state_version", "to_log_json",
    "to_log_text", "update_state", "with_scan_compat", "write_plan", "write_plan_csv", "write_plan_json", "write_state",
]
