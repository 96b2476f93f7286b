"""Random numbers as functions of keys: the same under any partitioning, retry or engine that has MD5."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) from the keys (columns, or literals other than column names)."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw(key: str) -> float:
    """The same number for one key, in Python."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 4294967296.0


def pareto(u: Column, scale: float, alpha: float) -> Column:
    """A Pareto draw by its inverse distribution."""
    return F.lit(scale) / F.pow(1 - u, F.lit(1.0 / alpha))


def poisson_table(mean: float, most: int = 400) -> list[float]:
    """Cumulative probabilities of a Poisson distribution; a draw is the number of entries that u reaches."""
    import math

    term, total, table = math.exp(-mean), 0.0, []
    for k in range(most):
        total += term
        table.append(total)
        term *= mean / (k + 1)
        if total >= 1 - 1e-15:
            break
    return table
