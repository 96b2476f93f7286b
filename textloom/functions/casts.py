"""Casts that never fail: numbers with what isn't one kept, lists of whatever a column holds, numbers for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_or_kept(c: Column, kind: str = "double") -> tuple[Column, Column]:
    """A string as a number, and the string itself where it is none."""
    number = c.try_cast(kind)
    return number, F.when(number.isNull(), c)


def as_list(df: DataFrame, name: str) -> Column:
    """A column's value as an array: arrays as they are, strings by characters, null as an empty one, anything else as its only element."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(c, F.array().cast(kind))
    if isinstance(kind, T.StringType):
        return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(T.ArrayType(kind)))


def shown(c: Column) -> Column:
    """A number with three decimals; null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.3f", c.cast("double")))
