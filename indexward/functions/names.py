"""Names, name lists, quoting and command texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the suffix a concurrent rebuild gives its temporary index.
TEMP_SUFFIX = "_ccnew"


def is_temp_rebuild_name(name: Column) -> Column:
    """True when everything after the first suffix is empty or ASCII digits.

    The pattern is anchored with ``\\A`` and ``\\z``: ``$`` would also accept a final newline.
    """
    prefix = F.substring_index(name, TEMP_SUFFIX, 1)
    rest = F.substr(name, F.length(prefix) + F.lit(len(TEMP_SUFFIX) + 1))
    return name.contains(TEMP_SUFFIX) & rest.rlike(r"\A[0-9]*\z")


def csv_quote(value: Column) -> Column:
    """Quote a field that holds a comma, a quote or a newline; double the inner quotes."""
    special = value.contains(",") | value.contains('"') | value.contains("\n")
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(special, quoted).otherwise(value)


def split_list(text: Column) -> Column:
    """Array of the trimmed, non-empty parts of a comma-separated list."""
    parts = F.transform(F.split(text, ","), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", ""))
    return F.filter(parts, lambda p: p != "")


def rebuild_command(schema: Column, index: Column, concurrently: bool = True) -> Column:
    """The statement that would rebuild one index."""
    verb = "REINDEX INDEX CONCURRENTLY" if concurrently else "REINDEX INDEX"
    return F.format_string(verb + ' "%s"."%s"', schema, index)


def analyze_command(schema: Column, table: Column, skip_locked: bool = True) -> Column:
    """The statement that would refresh the statistics of one table.

    ``skip_locked`` is for servers from version 14 on.
    """
    verb = "ANALYZE (SKIP_LOCKED)" if skip_locked else "ANALYZE"
    return F.format_string(verb + ' "%s"."%s"', schema, table)
