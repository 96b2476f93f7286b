"""Linking on tables: sorted runs, large groups dealt to cells, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import discard, scratch, stored

#: Fixed values of the splitmix64 generator: its step and the multipliers of its output.
STEP, MIX_ONE, MIX_TWO = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_ONE
    x = (x ^ (x >> np.uint64(27))) * MIX_TWO
    return x ^ (x >> np.uint64(31))


def whole_runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Sorted batches as arrays of whole runs of rows equal in `by`, and where runs begin (and the last ends)."""
    rest = None

    def cuts(part: dict[str, np.ndarray]) -> np.ndarray:
        n = len(part[by[0]])
        turn = np.zeros(n, dtype=bool)
        for c in by:
            turn[1:] |= part[c][1:] != part[c][:-1]
        return np.array([0, *np.flatnonzero(turn).tolist(), n])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if rest is not None:
            part = {c: np.concatenate([rest[c], v]) for c, v in part.items()}
        at = cuts(part)
        keep = int(at[-2])  # the last run may go on in the next batch
        if keep:
            yield {c: v[:keep] for c, v in part.items()}, at[:-1]
        rest = {c: v[keep:] for c, v in part.items()}
    if rest is not None:
        yield rest, cuts(rest)


def cells(rows: DataFrame) -> DataFrame:
    """Rows with `block` of `blocks` of their bucket, once for each pair of blocks (lo, hi) that they belong to."""
    pairs = F.expr("transform(sequence(0, blocks - 1), j -> named_struct('lo', least(j, block), 'hi', greatest(j, block)))")
    return rows.withColumn("cell", F.explode(pairs)).select(*(c for c in rows.columns if c != "blocks"), "cell.lo", "cell.hi")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) that is not the smallest of its component, which is the root.
    Rounds of large-star and small-star; each is one table in the shared folder, which the next replaces. Joins on the root of a large
    component rely on Spark's splitting of skewed partitions."""
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), path)
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        old, path = path, scratch(spark, "edges")
        now = stored(small, path)
        discard(spark, old)
        n, stars, total = now.agg(F.count(F.lit(1)), F.count_distinct("a"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if n == stars and before == (n, total):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (n, total)
    raise RuntimeError("the components did not settle")
