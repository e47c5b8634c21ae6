"""Ranked plan: which indexes to rebuild first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..keys import fleet_keys
from ..operators.inventory import Catalog
from ..operators.ranking import plan_facts, rank_plan
from ..sources.plan_files import write_plan


def ranked_plan(
    cat: Catalog, schemas: str | Sequence[str] | None, sort_by: str | Sequence[str], now, never_scanned: str = "code",
    tool_schemas: Sequence[str] = (), in_order: bool = False,
) -> DataFrame:
    """Inventory of the schemas (all user schemas for None), ranked by the criteria; ``in_order`` as in ``rank_plan``."""
    return rank_plan(plan_facts(cat, schemas, tool_schemas), sort_by, now, never_scanned, in_order)


def write_ranked_plan(
    cat: Catalog, path: str, schemas: str | Sequence[str] | None, sort_by: str | Sequence[str], now, fmt: str = "json",
    never_scanned: str = "code", tool_schemas: Sequence[str] = (), compression: str | None = None,
) -> None:
    """The same, written as JSON Lines or CSV. A plan without leading keys is written as it was numbered, not sorted again."""
    plan = ranked_plan(cat, schemas, sort_by, now, never_scanned, tool_schemas, in_order=True)
    write_plan(plan, path, fmt, compression, in_order=bool(sort_by) and not fleet_keys(plan))
