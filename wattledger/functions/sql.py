"""Python values as SQL text."""

from __future__ import annotations

from collections.abc import Iterable


class Expr(str):
    """Text of an expression, such as a column's name, where a plain value is expected: used as it is."""


def string(value: str | None) -> str:
    if isinstance(value, Expr):
        return str(value)
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def quoted(values: Iterable[str]) -> str:
    """A comma list of string literals."""
    return ", ".join(string(v) for v in values)


def double(value: float | None) -> str:
    if isinstance(value, Expr):
        return str(value)
    return "CAST(NULL AS DOUBLE)" if value is None else f"{float(value)!r}D"


def name(column: str) -> str:
    """A column name as an identifier."""
    return "`" + column.replace("`", "``") + "`"
