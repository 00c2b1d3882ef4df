"""Evaluating derived columns once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tallyscope.functions.rules import Value, aliased


def bind_once(df: DataFrame, kept: tuple[str, ...], columns: Mapping[str, Value]) -> DataFrame:
    """``kept`` and ``columns``, such that everything downstream refers to the computed values.

    Catalyst substitutes aliases when it moves a filter below a projection. Scores feed tiers and
    tiers feed actions, so with plain projections a filter on a late label is rewritten into
    thousands of copies of the early CASE chains. Generating the values as a one-row list stops
    the substitution; it needs no shuffle and stays in generated code.
    """
    return df.selectExpr(*kept, f"inline(array(struct({', '.join(aliased(columns))})))")


def with_sql(df: DataFrame, columns: Mapping[str, Value]) -> DataFrame:
    """``withColumns`` for SQL text, in one call."""
    return df.selectExpr("*", *aliased(columns))
