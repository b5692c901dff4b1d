"""Shared pieces of oracle SQL (DuckDB dialect)."""

from __future__ import annotations

from lodestrata.model import SYMBOL_TYPES


def type_sql(x: str) -> str:
    """Normalised symbol type."""
    bare = f"trim({x}, chr(39) || '\" ')"
    names = " ".join(f"when '{k}' then '{v}'" for k, v in sorted(SYMBOL_TYPES.items()))
    return f"case lower({bare}) {names} else {bare} end"


def path_sql(x: str) -> str:
    """Normalised path."""
    return f"regexp_replace(replace({x}, '\\', '/'), '^\\./', '')"


def key_sql(x: str) -> str:
    """Normalised key; null for null and blank ones."""
    kind, path = type_sql(f"split_part({x}, ':', 2)"), path_sql(f"split_part({x}, ':', 3)")
    return f"case when {x} is null or trim({x}) = '' then null else split_part({x}, ':', 1) || ':' || {kind} || ':' || {path} end"
