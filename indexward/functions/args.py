"""Checks on plain Python arguments."""

from __future__ import annotations

from collections.abc import Sequence

from ..schemas import MAX_SCHEMAS, MAX_THREADS, MAX_WORK_MEM_GB

# Names accepted by the arguments.
CRITERIA = ("bloat", "size", "scan-frequency", "age")
INDEX_KINDS = ("btree", "constraint", "all")
PLAN_FORMATS = ("json", "csv")
SIZE_ORDERS = ("asc", "desc")


def split_names(text: str | None) -> list[str]:
    """Trimmed, non-empty parts of a comma-separated argument."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def _one_of(value: str, allowed: Sequence[str], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"invalid {what} '{value}': must be one of {', '.join(allowed)}")
    return value


def parse_criteria(sort_by: str | Sequence[str]) -> list[str]:
    """Ranking criteria in the given order. Repeated names are kept and count again."""
    names = sort_by.split(",") if isinstance(sort_by, str) else sort_by
    return [_one_of(n.strip().lower(), CRITERIA, "sort criterion") for n in names]


def parse_index_kind(kind: str) -> str:
    return _one_of(kind.lower() or "all", INDEX_KINDS, "index kind")


def parse_plan_format(name: str) -> str:
    return _one_of(name.lower(), PLAN_FORMATS, "output format")


def parse_size_order(order: str | None) -> str | None:
    return None if order is None else _one_of(order.lower(), SIZE_ORDERS, "size order")


def validate_threads(threads: int, one_table: bool = False) -> int:
    """Lanes to use; a run on one table has a single lane."""
    if not 1 <= threads <= MAX_THREADS:
        raise ValueError(f"threads must be between 1 and {MAX_THREADS}, got {threads}")
    return 1 if one_table else threads


def validate_bloat_threshold(percent: int | None) -> int | None:
    if percent is not None and not 0 <= percent <= 100:
        raise ValueError(f"bloat threshold must be between 0 and 100, got {percent}")
    return percent


def validate_work_mem(gigabytes: int) -> int:
    if gigabytes > MAX_WORK_MEM_GB:
        raise ValueError(f"maintenance work mem must be at most {MAX_WORK_MEM_GB} GB, got {gigabytes}")
    return gigabytes


def validate_size_band(min_gb: int, max_gb: int | None) -> tuple[int, int | None]:
    """Bounds of a size band; no upper bound for None."""
    if min_gb < 0 or (max_gb is not None and min_gb > max_gb):
        raise ValueError(f"size band must satisfy 0 <= min <= max, got {min_gb} and {max_gb}")
    return min_gb, max_gb


def validate_schemas(schemas: Sequence[str]) -> list[str]:
    """A non-empty list of schema names within the limit (which also bounds what is broadcast)."""
    if not schemas:
        raise ValueError("at least one schema is needed")
    if len(schemas) > MAX_SCHEMAS:
        raise ValueError(f"at most {MAX_SCHEMAS} schemas are allowed, got {len(schemas)}")
    return list(schemas)
