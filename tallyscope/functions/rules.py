"""Rules as data: band tables, ordered rule lists and lookups compiled to one CASE expression.

Expressions are assembled as SQL text. Building the same CASE from ``Column`` objects costs a
round trip to the JVM per comparison, which for the long rule lists takes longer than planning.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import Decimal
from typing import NamedTuple


class Sql(str):
    """Text that is a SQL expression, as opposed to a constant."""


Value = int | Decimal | bool | str | Sql | None


class Cond(NamedTuple):
    """``column`` compared with a constant; a NULL column never passes."""

    column: str
    op: str
    value: Value


class Rule(NamedTuple):
    """``result`` applies when every condition holds."""

    result: Value
    tests: tuple[Cond, ...]


class Bands(NamedTuple):
    """Rungs ``(op, threshold, result)`` tried from the top, else ``default``."""

    column: str
    rungs: tuple[tuple[str, Value, Value], ...]
    default: Value


def sql(value: Value) -> Sql:
    """A constant as a SQL literal; SQL text as it is."""
    if isinstance(value, Sql):
        return value
    if value is None:
        return Sql("NULL")
    if isinstance(value, bool):
        return Sql(str(value).upper())
    if isinstance(value, str):
        quoted = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
        return Sql(f"'{quoted}'")
    return Sql(str(value))


def every(conditions: Iterable[str]) -> Sql:
    return Sql(" AND ".join(f"({c})" for c in conditions) or "TRUE")


def condition(tests: Iterable[Cond]) -> Sql:
    return every(f"{t.column} {t.op} {sql(t.value)}" for t in tests)


def first_match(choices: Iterable[tuple[str, Value]], default: Value) -> Sql:
    """CASE over ``(condition, result)`` pairs."""
    arms = " ".join(f"WHEN {when} THEN {sql(then)}" for when, then in choices)
    return Sql(f"CASE {arms} ELSE {sql(default)} END") if arms else sql(default)


def by_rules(rules: Iterable[Rule], default: Value) -> Sql:
    return first_match([(condition(r.tests), r.result) for r in rules], default)


def by_bands(bands: Bands) -> Sql:
    return first_match(
        [(f"{bands.column} {op} {sql(edge)}", result) for op, edge, result in bands.rungs],
        bands.default,
    )


def by_value(column: str, table: Mapping[str, Value], default: Value) -> Sql:
    return first_match([(f"{column} = {sql(k)}", v) for k, v in table.items()], default)


def by_prefix(column: str, table: Mapping[str, Value], default: Value) -> Sql:
    return first_match(
        [(f"startswith({column}, {sql(k)})", v) for k, v in table.items()], default
    )


def one_of(column: str, values: Iterable[str]) -> Sql:
    return Sql(f"{column} IN ({', '.join(map(sql, values))})")


def aliased(columns: Mapping[str, Value]) -> list[str]:
    """Arguments for ``selectExpr``."""
    return [f"{sql(value)} AS {name}" for name, value in columns.items()]
