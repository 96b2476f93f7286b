"""Operator 10, approximate nearest neighbours: collision-counting hashing for the largest inner product.

Inner products become distances by one more coordinate, sqrt(R^2 - |x|^2), with R the largest norm (0 for a query). Each of
PROJECTIONS random lines maps vectors to numbers; within a block of vectors the numbers of a line are one sorted array. A query
opens a window around its own number on every line. Virtual rehashing widens all windows together by RATIO; a vector
collides once for each line whose window holds it, and one that collides on at least COLLISIONS lines is verified
by its exact inner product, unless an estimate, good to 1e-12 of the lengths, shows that k verified ones beat it. Windows widen until they reach REACH times as far as the k-th best verified vector, or hold all.
Lines and windows are worked out on vectors scaled by a power of two, so that no finite vector is too large or small.

Data lie in blocks and queries in groups of bounded size; a task holds one block and one group, gives its k best per query, and these
are merged. A group is large, so blocks travel once for each GROUP queries. A vector that many rows share is spread over the
blocks by id.

Defined results: vectors that are null, empty of numbers, zero, or hold null or non-finite numbers take no part, nor do
those of another length than the most frequent one, or with a null vec_id. Ties go to the smaller vec_id. Of rows that
share a vec_id, each is a candidate (not for queries of that id), and a query is answered once, by the row of the smallest hash.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm._common import read

K = 20
QUERY_EVERY = 20
#: A vector at distance d collides on a line whose half-width is w with probability 2 Phi(w / d) - 1. At w = REACH * d that is 0.6, so of 64
#: lines at least 34 hold a vector as near as the k-th best with probability 0.9, and nearer ones, or wider windows, more often. The small
#: RATIO keeps windows from growing far beyond the need.
PROJECTIONS = 64
COLLISIONS = 34
REACH = 0.85
RATIO = 1.12
#: First half-width of the windows, in units of the spread of a line.
FIRST_WIDTH = 0.6
#: Vectors in a block and queries in a group, about.
BLOCK, GROUP = 16_384, 8192
SEED = 7
#: Queries whose estimates are worked out together.
AT_ONCE = 64


def _lines(dim: int, n: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, n))


def _search(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, radius: float, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query, ids and scores of its k best vectors in one block; and how many vectors were verified in all."""
    shift = -math.frexp(radius)[1]
    small, asks, radius = np.ldexp(data, shift), np.ldexp(queries, shift), math.ldexp(radius, shift)
    rest = np.sqrt(np.maximum(radius**2 - (small * small).sum(axis=1), 0))
    lines = _lines(data.shape[1])
    places = (np.column_stack([small, rest]) @ lines).T
    order = np.argsort(places, axis=1, kind="stable").astype(np.int32)
    asked = np.column_stack([asks, np.zeros(len(asks))]) @ lines
    # the sorted arrays end to end, moved apart so that one search serves all lines
    gap = 4 * float(np.abs(places).max() + np.abs(asked).max()) + 1.0
    apart = gap * np.arange(len(places))
    spread = float(places.std()) or 1.0
    flat = (np.take_along_axis(places, order, axis=1) + apart[:, None]).ravel()
    order = order.ravel().astype(np.int64)
    n = len(data)
    first = n * np.arange(len(places))
    found, checked = [], 0
    plain = 1e-100 < math.ldexp(radius, -shift) < 1e100  # neither products nor their sums leave the range of numbers
    for j, (own, query, ask, at) in enumerate(zip(query_ids, queries, asks, asked, strict=True)):
        if j % AT_ONCE == 0:
            estimates = asks[j : j + AT_ONCE] @ small.T
        estimate = estimates[j % AT_ONCE]
        counts = np.zeros(n, dtype=np.int64)
        low = np.clip(np.searchsorted(flat, at + apart), first, first + n)
        high, width = low.copy(), FIRST_WIDTH * spread
        verified = np.zeros(n, dtype=bool)
        near_ids, near, close = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        length = float(ask @ ask)
        error = 1e-12 * len(ask) * radius * math.sqrt(length)  # far over the rounding of an estimate
        while True:
            reach = min(width, gap / 2)
            a, b = np.searchsorted(flat, at - reach + apart), np.searchsorted(flat, at + reach + apart, side="right")
            # only what a window gains is counted; a window doesn't leave its line
            a, b = np.clip(np.minimum(a, low), first, first + n), np.clip(np.maximum(b, high), first, first + n)
            gained = [order[x:y] for x, y in zip(np.concatenate([a, high]).tolist(), np.concatenate([low, b]).tolist(), strict=True) if x < y]
            low, high = a, b
            if gained:
                counts += np.bincount(np.concatenate(gained), minlength=n)
            new = np.flatnonzero((counts >= COLLISIONS) & ~verified)
            verified[new] = True
            new = new[ids[new] != own]
            if plain and length > 1e-100 and len(new) > k:  # those that k verified ones surely beat need no exact product
                about = estimate[new]
                new = new[about >= np.partition(about, -k)[-k] - 2 * error]
            near_ids = np.concatenate([near_ids, ids[new]])
            near = np.concatenate([near, (data[new] * query).sum(axis=1)])
            close = np.concatenate([close, (small[new] * ask).sum(axis=1)])
            best = np.lexsort((near_ids, -near))[:k]
            near_ids, near, close = near_ids[best], near[best], close[best]
            whole = bool((high - low == n).all())
            if whole or (len(best) == k and REACH * math.sqrt(max(0.0, radius**2 + length - 2 * close[-1])) <= width):
                found.append((near_ids, near))
                checked += int(verified.sum())
                break
            width *= RATIO
    return found, checked


def search(data: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds, among all other rows."""
    vec = F.col(vector).cast("array<double>")
    rows = data.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    # the largest number is taken out of the root, so that no square overflows
    norm = F.expr("element_at(transform(array(array_max(transform(v, x -> abs(x)))), m -> m * sqrt(aggregate(v, 0D, (a, x) -> a + (x / m) * (x / m)))), 1)")
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.max(norm).alias("far"))
    top = dims.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, radius = top["dim"], min(top["far"], 1.7e308)
    blocks, groups = max(1, math.ceil(top["n"] / block)), max(1, math.ceil(top["asks"] / group))
    rows = rows.where(F.size("v") == dim)
    # each block goes to every group of queries and each group to every block: a stated query set against all rows, in blocks
    members = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v")).withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(mine: pa.Table, queries: pa.Table) -> pa.Table:
        matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, dim)
        names = ["query_id", "vec_id", "score"]
        out = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        if mine.num_rows and queries.num_rows:
            asks = queries.column("vec_id").to_numpy()
            got, _ = _search(mine.column("vec_id").to_numpy(), matrix(mine), asks, matrix(queries), radius, k)
            out = [np.repeat(asks, [len(i) for i, _ in got]), np.concatenate([i for i, _ in got]), np.concatenate([s for _, s in got])]
        return pa.Table.from_arrays([pa.array(c) for c in out], names=names)

    best = members.select("block", "group", "vec_id", "v").groupBy("block", "group").cogroup(asked.select("block", "group", "vec_id", "v").groupBy("block", "group")).applyInArrow(run, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
