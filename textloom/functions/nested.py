"""Nested columns as flat ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(kind: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found = []
    for field in kind.fields:
        at = (*path, field.name)
        found += _leaves(field.dataType, at) if isinstance(field.dataType, T.StructType) and field.dataType.fields else [at]
    return found


def _at(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in path))


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """df with one column per leaf of its structs, named by the path to it. A null struct has null leaves; arrays and maps
    stay as they are. Paths that give the same name raise."""
    paths = _leaves(df.schema)
    names = [separator.join(p) for p in paths]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"two leaves would have the same name: {sorted(names)}")
    return df.select(*(_at(p).alias(n) for p, n in zip(paths, names, strict=True)))
