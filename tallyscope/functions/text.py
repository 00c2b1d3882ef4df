"""Text building with the two NULL policies the reports need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscope.functions.rules import Sql, sql


def as_text(column: str) -> Sql:
    return Sql(f"CAST({column} AS STRING)")


def joined(*parts: str) -> Sql:
    """Concatenate constants and columns (given as ``Sql``), leaving out NULL parts."""
    texts = [as_text(p) if isinstance(p, Sql) else sql(p) for p in parts]
    return Sql(f"concat_ws('', {', '.join(texts)})")


def filled(template: str, values: str) -> Sql:
    """Fill a template, ``struct<fixed, pieces array<struct<text, field>>>``, from string values.

    Without fields the text is ``fixed``. A piece is literal text or the place of a value; a NULL
    value makes the whole text NULL.
    """
    piece = f"IF(p.field IS NULL, p.text, element_at({values}, p.field))"
    pieces = f"aggregate({template}.pieces, '', (done, p) -> concat(done, {piece}))"
    return Sql(f"coalesce({template}.fixed, {pieces})")


def whole_json(text: Column) -> Column:
    """The variant of a text that is one JSON value from end to end, else NULL.

    Parsing stops after the first value, whatever follows. What follows a value would have to end both
    a list and an object around it, which nothing can, so a text that parses inside either is whole.
    """
    listed = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & member.isNotNull(), F.try_parse_json(text))
