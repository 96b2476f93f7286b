"""Figures of packed rows: mixture, tokens by objective, fill, segments, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.tokens import IGNORE


def by_objective(examples: DataFrame) -> DataFrame:
    """Samples, tokens and averages by objective, for rows of objective, prompt, n_input, n_label. Of next-token prediction, only
    the prompt is context, as its input repeats the label."""
    context = F.when(F.col("objective") == "next_token_prediction", F.least("n_input", F.length("prompt"))).otherwise(F.col("n_input"))
    sums = examples.groupBy("objective").agg(F.count(F.lit(1)).alias("sample_count"), F.sum(context).alias("context_tokens"), F.sum("n_input").alias("input_tokens"), F.sum("n_label").alias("output_tokens"))
    total = F.sum("sample_count").over(Window.partitionBy())  # over one row per objective
    return sums.select(
        "objective", "sample_count", F.round(F.col("sample_count") / total, 6).alias("actual_rate"), "context_tokens", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        *(F.round(F.col(f"{k}_tokens") / F.col("sample_count"), 6).alias(f"avg_{k}_tokens") for k in ("context", "input", "output")),
    )


def fill(rows: DataFrame, length: int) -> DataFrame:
    """Of closed rows (used, n_segments): rows, samples, active and all slots, fill rate."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("n_segments"), F.lit(0)).alias("total_samples"), F.coalesce(F.sum("used"), F.lit(0)).alias("active_slots"), (F.count(F.lit(1)) * length).alias("total_slots")).withColumn("fill_rate", F.round(F.when(F.col("total_slots") > 0, F.col("active_slots") / F.col("total_slots")).otherwise(0.0), 6))


def _segments() -> Column:
    return F.array_remove(F.array_distinct("segment_ids"), F.lit(0))


def segment_starts(dense: DataFrame) -> DataFrame:
    """Where each segment of a packed row begins and its first token; within the row's own arrays, where a segment's positions are neighbours."""
    starts = F.transform(_segments(), lambda s: F.struct(s.alias("segment"), (F.array_position("segment_ids", s) - 1).cast("int").alias("pos")))
    return dense.select("shard", "pack_id", "input_ids", F.explode(starts).alias("s")).select("shard", "pack_id", "s.segment", "s.pos", F.get("input_ids", F.col("s.pos")).alias("token"))


def named(starts: DataFrame, markers: dict[int, str]) -> DataFrame:
    """Segments with the objective that their first token marks; null if none does. The markers are a handful of literals."""
    case = None
    for token, name in markers.items():
        case = F.when(F.col("token") == token, name) if case is None else case.when(F.col("token") == token, name)
    return starts.withColumn("objective", case)


def label_density(dense: DataFrame) -> DataFrame:
    return dense.select("shard", "pack_id", F.size(F.array_remove("label_ids", F.lit(IGNORE))).alias("n_labels"))


def efficiency(dense: DataFrame) -> DataFrame:
    """Per row: tokens other than padding, their share, and the largest ids."""
    used = F.size(F.array_remove("input_ids", F.lit(0)))
    return dense.select("shard", "pack_id", used.alias("used"), F.round(used / F.size("input_ids"), 6).alias("share"), F.array_max("input_ids").alias("max_input_id"), F.array_max("label_ids").alias("max_label_id"))


def masked_mean(loss: Column, label: Column) -> Column:
    """Mean loss over the positions that have a label."""
    has = (label != IGNORE).cast("double")
    return F.sum(loss * has) / F.greatest(F.lit(1.0), F.sum(has))


def attention_pairs(dense: DataFrame, causal: bool = False) -> DataFrame:
    """How many position pairs attend, per row: within a segment, forwards, and between input positions both ways unless causal.
    Counted from segment and input lengths within the row's own arrays, so no pair is formed."""
    count = lambda array, s: (F.size(array) - F.size(F.array_remove(array, s))).cast("long")
    half = lambda x: F.shiftright(x, 1)

    def total(inputs: Column) -> Column:
        """The pairs, from the segments of input positions."""
        forwards = F.transform(_segments(), lambda s: half(count(F.col("segment_ids"), s) * (count(F.col("segment_ids"), s) + 1)))
        both = F.array() if causal else F.transform(_segments(), lambda s: half(count(inputs, s) * (count(inputs, s) - 1)))
        return F.aggregate(F.concat(forwards, both.cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)

    inputs = F.zip_with("segment_ids", "attention_mask", lambda s, m: F.when(m == 1, s).otherwise(0))
    return dense.select("shard", "pack_id", F.get(F.transform(F.array(inputs), total), 0).alias("n_pairs"))


def attends(q: Column, k: Column, q_mask: Column, k_mask: Column, q_segment: Column, k_segment: Column, causal: bool = False) -> Column:
    """Whether position q sees position k: the condition that attention_pairs counts."""
    sees = q >= k if causal else ((q_mask == 1) & (k_mask == 1)) | (q >= k)
    return sees & (q_segment == k_segment) & (q_segment > 0)


def _tile_spans(segments: DataFrame, block: int) -> DataFrame:
    """Of segments(shard, pack_id, start_off, n_input, n_label): first and last block that they touch, the last that their inputs touch, and the
    first and last that they, and their inputs, fill."""
    s, t, e = F.col("start_off"), F.col("start_off") + F.col("n_input"), F.col("start_off") + F.col("n_input") + F.col("n_label")
    whole = lambda x: x.cast("long")
    last = lambda x: F.floor((x - 1) / block)
    return segments.where((F.col("n_input") + F.col("n_label")) > 0).select(
        "shard", "pack_id", "start_off", whole(F.floor(s / block)).alias("a"), whole(last(e)).alias("b"), whole(F.when(F.col("n_input") > 0, last(t)).otherwise(F.floor(s / block) - 1)).alias("c"),
        whole(F.ceil(s / block)).alias("fa"), whole(F.floor(e / block) - 1).alias("fb"), whole(F.floor(t / block) - 1).alias("fc"),
    )


def tile_counts(segments: DataFrame, block: int, length: int) -> DataFrame:
    """Per packed row, how many tiles of block x block positions attention fills, fills in part, and leaves empty, by the rule of `attends`. Segments
    are intervals, so their tiles are triangles and squares of blocks: they are counted, no tile or pair is formed."""
    touched, inputs = F.col("b") - F.col("a") + 1, F.greatest(F.lit(0), F.col("c") - F.col("a") + 1)
    filled, filled_inputs = F.greatest(F.lit(0), F.col("fb") - F.col("fa") + 1), F.greatest(F.lit(0), F.col("fc") - F.col("fa") + 1)
    some = F.expr("m * (m + 1) div 2 + p * (p - 1) div 2")  # from the diagonal on, and before it among inputs
    full = F.expr("f * (f - 1) div 2 + g * (g + 1) div 2")
    shared = (F.lag("b").over(Window.partitionBy("shard", "pack_id").orderBy("start_off")) == F.col("a")).cast("long")  # neighbours meet in a diagonal tile only
    per = _tile_spans(segments, block).select("shard", "pack_id", touched.alias("m"), inputs.alias("p"), filled.alias("f"), filled_inputs.alias("g"), F.coalesce(shared, F.lit(0)).alias("shared"))
    rows = per.groupBy("shard", "pack_id").agg(F.sum(some - F.col("shared")).alias("n_some"), F.sum(full).alias("n_full"))
    tiles = (-(-length // block)) ** 2
    return rows.select("shard", "pack_id", "n_full", (F.col("n_some") - F.col("n_full")).alias("n_partial"), (F.lit(tiles) - F.col("n_some")).alias("n_empty"))


def tile_map(segments: DataFrame, block: int) -> DataFrame:
    """shard, pack_id, query_block, key_block, full: the tiles that attention touches, for a kernel that skips the others."""
    spans = _tile_spans(segments, block)
    queries = spans.withColumn("query_block", F.explode(F.sequence("a", "b")))
    # keys up to the query's block, and beyond it those of the inputs, if the query's block has inputs
    last = F.when(F.col("query_block") <= F.col("c"), F.greatest("query_block", "c")).otherwise(F.col("query_block"))
    tiles = queries.withColumn("key_block", F.explode(F.sequence("a", last)))
    q, k = F.col("query_block"), F.col("key_block")
    inside = lambda x, end: (x >= F.col("fa")) & (x <= F.col(end))
    full = F.when(q > k, inside(q, "fb") & inside(k, "fb")).otherwise(inside(q, "fc") & inside(k, "fc"))
    return tiles.groupBy("shard", "pack_id", "query_block", "key_block").agg(F.max(full).alias("full"))
