"""Shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written and computed once, however often body uses it.

    Expressions that use their argument several times would double with every level that nests them, also when
    the optimizer moves filters below projections; a bound variable keeps them as large as they read."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant_map(pairs: dict) -> Column:
    """A map of constants as one parsed expression: a call per entry to make it costs seconds where it is used often."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x)
    return F.expr("map(" + ", ".join(text(x) for pair in pairs.items() for x in pair) + ")")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once per row, as the one element of an array that is taken apart again.

    A column of withColumn is written out wherever a filter or projection above uses it, and made as often."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
