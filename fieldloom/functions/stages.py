"""Stage boundaries for long projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later filters and joins read as values.

    A filter on an ordinary derived column is pushed below its projection by
    substituting the whole expression, once per reference. For a verdict built
    from dozens of checks that multiplies the plan. A one-row generator keeps
    the expression in one place.

    The generator itself reads plain columns: where a stage is too long for
    whole-stage code, a generator's own expressions are interpreted, each
    repeated part anew, while a projection is compiled and shares its parts.
    """
    kept = [c for c in rows.columns if c not in columns]
    staged = rows.select(*kept, *[c.alias(f"_settled_{name}") for name, c in columns.items()])
    fields = [F.col(f"_settled_{name}").alias(name) for name in columns]
    return staged.select(*kept, F.inline(F.array(F.struct(*fields))))
