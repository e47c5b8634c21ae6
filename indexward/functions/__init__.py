"""Scalar functions. All are built-in Catalyst expressions: Column in, Column out."""

from .args import (
    parse_criteria, parse_index_kind, parse_plan_format, parse_size_order, split_names, validate_bloat_threshold,
    validate_schemas, validate_size_band, validate_threads, validate_work_mem,
)
from .bloat import estimated_bloat, page_drift_bloat
from .errors import classify_error
from .names import analyze_command, csv_quote, is_temp_rebuild_name, rebuild_command, split_list
from .sizes import round1, size_change_pct, size_gb_text, size_pretty
from .times import as_epoch, as_timestamp, epoch_secs, last_scan_iso, log_timestamp
from .wal import lsn_bytes, lsn_diff

__all__ = [
    "analyze_command", "as_epoch", "as_timestamp", "classify_error", "csv_quote", "epoch_secs", "estimated_bloat",
    "is_temp_rebuild_name", "last_scan_iso", "log_timestamp", "lsn_bytes", "lsn_diff", "page_drift_bloat",
    "parse_criteria", "parse_index_kind", "parse_plan_format", "parse_size_order", "rebuild_command", "round1",
    "size_change_pct", "size_gb_text", "size_pretty", "split_list", "split_names", "validate_bloat_threshold",
    "validate_schemas", "validate_size_band", "validate_threads", "validate_work_mem",
]
