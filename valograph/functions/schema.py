"""Column lookup by name, for inputs whose headers vary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def find_column(
    df: DataFrame, names: Iterable[str] = (), contains: str | None = None, position: int | None = None
) -> str | None:
    """First column named in ``names`` (any case) or holding ``contains``; else the one at ``position``."""
    wanted = {n.lower() for n in names}
    for name in df.columns:
        if name.lower() in wanted or (contains is not None and contains.lower() in name.lower()):
            return name
    return df.columns[position] if position is not None else None


def first_existing(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First candidate that is a column, in candidate order and exact case."""
    return next((c for c in candidates if c in df.columns), None)


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
