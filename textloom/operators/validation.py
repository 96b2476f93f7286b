"""Validation rows: texts drawn for each objective by its own seed, transformed with the whole length, unpacked and padded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import tokens
from textloom.functions.hashrand import uniform
from textloom.operators import examples, spans
from textloom.operators.config import Objective

PLAIN = ("next_token_prediction", "copying", "prefix_language_modeling", "deshuffling")


def drawn(texts: DataFrame, objectives: int, per_objective: int, order: str = "doc_id", seed: int = 0) -> DataFrame:
    """(obj_idx, key): for each objective, the texts with the least hashes of (seed, objective, key). One pass for all objectives; each task hands on
    no more than the least of its own."""
    keys = texts.where(tokens.not_blank(F.col("text"))).select(F.col(order).alias("key"))
    each = keys.withColumn("obj_idx", F.explode(F.sequence(F.lit(0), F.lit(objectives - 1)))).withColumn("u", uniform(seed, "validation", F.col("obj_idx"), F.col("key")))
    rank = F.row_number().over(Window.partitionBy("obj_idx").orderBy("u", "key"))
    return each.withColumn("rank", rank).where(F.col("rank") <= per_objective).select("obj_idx", "key")


def rows(texts: DataFrame, entries: list[Objective], per_objective: int, length: int, order: str = "doc_id", seed: int = 0) -> DataFrame:
    """obj_key, item, input_ids, label_ids, attention_mask, segment_ids: labels from position 0 and cut to the input, mask 1, segments 0."""
    found = None
    chosen = drawn(texts, len(entries), per_objective, order, seed)
    few = texts.select(order, "text").join(F.broadcast(chosen), F.col(order) == F.col("key")).select("obj_idx", order, "text")
    few = texts.sparkSession.createDataFrame(few.collect(), few.schema)  # per_objective rows of each objective, sorted out once
    for i, e in enumerate(entries):
        mine = few.where(F.col("obj_idx") == i).drop("obj_idx")
        made = examples.with_ids(examples.build(mine, e)) if e.name in PLAIN else spans.build(mine, e, order)
        ok = made.where((F.col("status") == "ok") & (F.size("input_ids") > 0)).select(F.lit(e.nickname).alias("obj_key"), F.lit(e.name).alias("objective"), F.col(order).alias("item"), "input_ids", "label_ids")
        found = ok if found is None else found.unionByName(ok)
    n = F.least(F.size("input_ids"), F.lit(length))
    cut = found.withColumn("n", n).withColumn("labels", F.slice("label_ids", F.lit(1), F.col("n")))
    pad = lambda ids, filler: F.concat(ids, F.array_repeat(F.lit(filler), F.lit(length) - F.size(ids)))
    return cut.select("obj_key", "objective", "item", pad(F.slice("input_ids", F.lit(1), F.col("n")), 0).alias("input_ids"), pad(F.col("labels"), tokens.IGNORE).alias("label_ids"), F.array_repeat(F.lit(1), length).alias("attention_mask"), F.array_repeat(F.lit(0), length).alias("segment_ids"))
