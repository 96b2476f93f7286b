"""Packing examples into rows of fixed length, in order within each shard, and laying the rows out.

A shard is packed by one pass over its sorted rows; what is held between batches is the open rows, never the shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.functions.tokens import IGNORE, character_ids

#: Fixed values of the row layout: the token before the labels, and the attention marks of input, latent and label positions.
START_ID = 2
MASK_INPUT, MASK_LATENT, MASK_LABEL = 1, 2, 3
ARRAYS = ("input_ids", "label_ids", "segment_ids", "attention_mask")
MIN_ROOM = 64
#: Items that are laid out at once.
LAID = 1024


def _next_fit(length: int, min_room: int, most: int):
    """One open row: an item that doesn't fit closes it, and so does one that leaves min_room or less."""
    pack, used, count = 0, 0, 0

    def place(n: int) -> tuple[int, int, int]:
        nonlocal pack, used, count
        if n > length:
            raise ValueError(f"an example of {n} tokens does not fit a row of {length}")
        if count and (used + n > length or length - used <= min_room or count >= most):
            pack, used, count = pack + 1, 0, 0
        at, used, count = used, used + n, count + 1
        return pack, count, at

    return place


def row_for(n: int, used: list[int], count: list[int], length: int, min_room: int, most: int, best: bool) -> int | None:
    """The fullest (best) or emptiest of a set of open rows that takes n; none if the set is to be replaced."""
    takes = [i for i, u in enumerate(used) if count[i] < most and u + n <= length]
    if not takes or all(length - u <= min_room for u in used):
        return None
    return max(takes, key=lambda i: (used[i], -i)) if best else min(takes, key=lambda i: (used[i], i))


def _fit(length: int, min_room: int, most: int, rows: int, best: bool):
    """A set of open rows: the fullest (best) or emptiest that takes the item; all are replaced when none does."""
    base, used, count = 0, [0] * rows, [0] * rows

    def place(n: int) -> tuple[int, int, int]:
        nonlocal base, used, count
        if n > length:
            raise ValueError(f"an example of {n} tokens does not fit a row of {length}")
        i = row_for(n, used, count, length, min_room, most, best)
        if i is None:
            base, used, count, i = base + rows, [0] * rows, [0] * rows, 0
        at, used[i], count[i] = used[i], used[i] + n, count[i] + 1
        return base + i, count[i], at

    return place


PLACES = [T.StructField("pack_id", T.LongType()), T.StructField("segment", T.IntegerType()), T.StructField("start_off", T.IntegerType())]


def _places(batches: Iterator[pa.RecordBatch], shard: str, size: str, placer_of: Callable) -> Iterator[pa.RecordBatch]:
    """The batches of sorted shards with the places of their items."""
    at, placer = object(), None
    for batch in batches:
        out = []
        for s, n in zip(batch.column(shard).to_pylist(), batch.column(size).to_pylist(), strict=True):
            if s != at:
                at, placer = s, placer_of()
            out.append(placer(n))
        pack, segment, start = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack, type=pa.int64()), pa.array(segment, type=pa.int32()), pa.array(start, type=pa.int32())], names=[*batch.schema.names, *(f.name for f in PLACES)])


def in_order(items: DataFrame, order: tuple[str, ...] = ("ord",), shard: str = "shard") -> DataFrame:
    """Whole shards in partitions, sorted."""
    return items.repartition(shard).sortWithinPartitions(shard, *order)


def place(items: DataFrame, size: str, length: int = 1024, min_room: int = MIN_ROOM, order: tuple[str, ...] = ("ord",), shard: str = "shard", fit: str = "next", rows: int = 1, most: int = 1 << 31) -> DataFrame:
    """items with pack_id, segment (from 1) and start_off, by shard. fit: next, best or worst; rows: open rows of best and worst."""
    placer_of = lambda: _next_fit(length, min_room, most) if fit == "next" else _fit(length, min_room, most, rows, fit == "best")
    return in_order(items, order, shard).mapInArrow(lambda batches: _places(batches, shard, size, placer_of), T.StructType([*items.schema.fields, *PLACES]))


def _laid(items: pa.Table, length: int, start_id: int) -> pa.RecordBatch:
    """Whole packed rows of the items of character tokens that lie in them, in order."""
    inputs = [p + t for p, t in zip(items.column("prompt").to_pylist(), items.column("input_text").to_pylist(), strict=True)]
    labels = items.column("label_text").to_pylist()
    n, m = (np.fromiter(map(len, texts), np.int64, len(texts)) for texts in (inputs, labels))
    shard, pack, segment, start = (items.column(c).to_numpy() for c in ("shard", "pack_id", "segment", "start_off"))
    size, before = n + m, np.cumsum(n + m) - n - m
    first = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (pack[1:] != pack[:-1])]))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(shard))))
    at = np.repeat(row * length + start - before, size) + np.arange(size.sum())
    labelled = np.repeat(np.tile([False, True], len(n)), np.column_stack([n, m]).ravel())
    shown = character_ids("".join(c for i, t in zip(inputs, labels, strict=True) for c in ((i, "\0", t[:-1]) if t else (i,))))
    shown[(before + n)[m > 0]] = start_id
    wanted = np.full(len(at), IGNORE, dtype=np.int32)
    wanted[labelled] = character_ids("".join(labels))

    def spread(values: np.ndarray, pad: int) -> pa.ListArray:
        out = np.full(len(first) * length, pad, dtype=np.int32)
        out[at] = values
        return pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * length), pa.array(out))

    arrays = spread(shown, 0), spread(wanted, IGNORE), spread(np.repeat(segment, size), 0), spread(np.where(labelled, MASK_LABEL, MASK_INPUT), 0)
    return pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(pack[first]), *arrays], names=["shard", "pack_id", *ARRAYS])


def rows_of_texts(items: DataFrame, size: str, length: int = 1024, min_room: int = MIN_ROOM, start_id: int = START_ID, most: int = 1 << 31) -> DataFrame:
    """dense_rows of items(shard, prompt, input_text, label_text) that lie in order (see in_order), of character tokens and by next fit, made in the pass that places them: as
    a row's items are neighbours, none is exchanged for it. Between batches the items of the open row are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _places((b.slice(i, LAID) for b in batches for i in range(0, b.num_rows, LAID)), "shard", size, lambda: _next_fit(length, min_room, most)):
            items = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            shard, pack = items.column("shard").to_numpy(), items.column("pack_id").to_numpy()
            last = int(np.flatnonzero((shard != shard[-1]) | (pack != pack[-1])).max(initial=-1)) + 1
            if last:
                yield _laid(items.slice(0, last), length, start_id)
            held = items.slice(last)
        if held is not None:
            yield _laid(held, length, start_id)

    schema = T.StructType([items.schema["shard"], PLACES[0], *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ARRAYS)])
    return items.select("shard", size, "prompt", "input_text", "label_text").mapInArrow(run, schema)


def close_rows(placed: DataFrame, size: str, length: int = 1024, min_room: int = MIN_ROOM, keep_tail: bool = False) -> DataFrame:
    """One row per packed row: shard, pack_id, used, n_segments. A shard's last row, if still open, goes unless keep_tail."""
    rows = placed.groupBy("shard", "pack_id").agg(F.sum(size).cast("long").alias("used"), F.count(F.lit(1)).alias("n_segments"))
    if keep_tail:
        return rows
    last = rows.groupBy("shard").agg(F.max("pack_id").alias("last"))
    return rows.join(last, "shard").where((F.col("pack_id") < F.col("last")) | (length - F.col("used") <= min_room)).drop("last")


def readiness(open_rows: DataFrame, length: int, min_room: int = MIN_ROOM) -> DataFrame:
    """shard, max_room, min_room, ready of open rows (shard, used): the most and least room of a shard's rows, and whether all are full enough to go."""
    room = F.lit(length) - F.col("used")
    return open_rows.groupBy("shard").agg(F.max(room).alias("max_room"), F.min(room).alias("min_room"), F.max(room > min_room).alias("_some")).select("shard", "max_room", "min_room", (~F.col("_some")).alias("ready"))


def open_rows(placed: DataFrame, size: str, rows: int) -> DataFrame:
    """shard, pack_id, used, n_segments of each shard's last set of `rows` rows, as best and worst fit leave it; rows that hold nothing are among them."""
    held = placed.groupBy("shard", "pack_id").agg(F.sum(size).cast("long").alias("used"), F.count(F.lit(1)).alias("n_segments"))
    last = held.groupBy("shard").agg((F.floor(F.max("pack_id") / rows) * rows).cast("long").alias("base"))
    every = last.select("shard", F.explode(F.sequence(F.col("base"), F.col("base") + rows - 1)).alias("pack_id"))
    return every.join(held, ["shard", "pack_id"], "left").select("shard", "pack_id", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def popped(open_rows: DataFrame, length: int, min_room: int = MIN_ROOM, peek: bool = False) -> DataFrame:
    """The open rows (shard, pack_id, used, ...) that go now: sets whose rows are all full enough. peek: every one, with whether it would go as `popped`."""
    told = open_rows.join(readiness(open_rows, length, min_room).select("shard", F.col("ready").alias("popped")), "shard")
    return told if peek else told.where("popped").drop("popped")


def forced(placed: DataFrame, size: str, rows: int) -> DataFrame:
    """Every packed row as if the last sets were told to close as they are: shard, pack_id, used, n_segments, and whether it took that."""
    held = close_rows(placed, size, keep_tail=True)
    last = held.groupBy("shard").agg(F.max("pack_id").alias("_last"))
    return held.join(last, "shard").withColumn("forced", F.floor(F.col("pack_id") / rows) == F.floor(F.col("_last") / rows)).drop("_last")


def batches(rows: DataFrame, batch_size: int) -> DataFrame:
    """rows with batch_id and row_in_batch, in order within each shard."""
    n = F.row_number().over(Window.partitionBy("shard").orderBy("pack_id")) - 1
    return rows.withColumn("batch_id", F.floor(n / batch_size).cast("long")).withColumn("row_in_batch", (n % batch_size).cast("int"))


def segment_arrays(input_ids: Column, label_ids: Column, segment: Column, start_id: int = START_ID) -> dict[str, Column]:
    """An example as it lies in a row: N + M positions; labels begin at the start token, shifted by one."""
    n, m = F.size(input_ids), F.size(label_ids)
    return {
        "input_ids": F.concat(input_ids, F.array(F.lit(start_id)), F.slice(label_ids, F.lit(1), F.greatest(m - 1, F.lit(0)))),
        "label_ids": F.concat(F.array_repeat(F.lit(IGNORE), n), label_ids),
        "segment_ids": F.array_repeat(segment.cast("int"), n + m),
        "attention_mask": F.concat(F.array_repeat(F.lit(MASK_INPUT), n), F.array_repeat(F.lit(MASK_LABEL), m)),
    }


def separator_arrays(input_ids: Column, label_ids: Column, separator: list[int], segment: Column) -> dict[str, Column]:
    """An example whose labels follow a separator of several tokens, from the last of them on; all marks are 1, and labels may be missing."""
    n, m, p = F.size(input_ids), F.size(label_ids), len(separator)
    between = F.array(*(F.lit(t) for t in separator)).cast("array<int>")
    slots = separator_cost(n, m, p).cast("int")
    return {
        "input_ids": F.concat(input_ids, between, F.slice(label_ids, F.lit(1), F.greatest(m - 1, F.lit(0)))),
        "label_ids": F.concat(F.array_repeat(F.lit(IGNORE), slots - m), label_ids),
        "segment_ids": F.array_repeat(segment.cast("int"), slots),
        "attention_mask": F.array_repeat(F.lit(MASK_INPUT), slots),
    }


def dense_rows(placed: DataFrame, length: int = 1024, start_id: int = START_ID, separator: list[int] | None = None) -> DataFrame:
    """Packed rows as arrays of `length`; separator: the tokens before labels, if not the start token alone. A group is one row, at most
    `length` tokens."""
    given = F.col("input_ids"), F.col("label_ids")
    arrays = separator_arrays(*given, separator, F.col("segment")) if separator else segment_arrays(*given, F.col("segment"), start_id)
    parts = placed.select("shard", "pack_id", "segment", F.struct(*(c.alias(k) for k, c in arrays.items())).alias("part"))
    rows = parts.groupBy("shard", "pack_id").agg(F.array_sort(F.collect_list(F.struct("segment", "part"))).alias("parts"))
    flat = {k: F.flatten(F.col("parts.part").getField(k)) for k in ARRAYS}
    pad = {"input_ids": 0, "label_ids": IGNORE, "segment_ids": 0, "attention_mask": 0}
    return rows.select("shard", "pack_id", *(F.concat(v, F.array_repeat(F.lit(pad[k]), F.lit(length) - F.size(v))).alias(k) for k, v in flat.items()))


def linspace(start: Column, stop: Column, n: Column) -> Column:
    """n whole numbers evenly from start, stop excluded, rounded down."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.floor(start + i * (stop - start) / n).cast("int"))).otherwise(F.array().cast("array<int>"))


def latent_arrays(input_ids: Column, label_ids: Column, latents: int, latent_id: int, segment: Column, start_id: int = START_ID) -> dict[str, Column]:
    """An example with `latents` latent tokens between input and labels, and position ids that stretch over them."""
    n, m, z = F.size(input_ids), F.size(label_ids), F.lit(latents)
    wide = F.greatest(n, z)
    return {
        "input_ids": F.concat(input_ids, F.array_repeat(F.lit(latent_id), latents), F.array(F.lit(start_id)), F.slice(label_ids, F.lit(1), F.greatest(m - 1, F.lit(0)))),
        "label_ids": F.concat(F.array_repeat(F.lit(IGNORE), n + z), label_ids),
        "segment_ids": F.array_repeat(segment.cast("int"), n + z + m),
        "attention_mask": F.concat(F.array_repeat(F.lit(MASK_INPUT), n), F.array_repeat(F.lit(MASK_LATENT), latents), F.array_repeat(F.lit(MASK_LABEL), m)),
        "position_ids": F.when((n >= z) & (m > 0), F.concat(F.sequence(F.lit(0), n - 1), linspace(F.lit(0), wide, z), F.sequence(n, n + m - 1)))  # no stretch: steps of 1
        .otherwise(F.concat(linspace(F.lit(0), wide, n), linspace(F.lit(0), wide, z), linspace(wide, wide + F.greatest(m.cast("double"), m * (z / n)), m))),
    }


def separator_room(min_room: int, separator: int) -> int:
    """The room at which a row of examples with separators closes: min_room, or too little for a separator and a token."""
    return max(min_room, separator)


def separator_cost(n: Column, m: Column, separator: int) -> Column:
    """Slots of an example whose labels follow a separator of several tokens; labels may be missing."""
    return F.when(m > 0, n + separator + m - 1).otherwise(n + separator)


def alignment(rows: DataFrame) -> DataFrame:
    """Packed rows by position, one row each, without padding: a view for the eye."""
    return rows.select("shard", "pack_id", F.posexplode(F.arrays_zip("input_ids", "label_ids", "segment_ids", "attention_mask")).alias("pos", "at")).select("shard", "pack_id", "pos", "at.*").where("segment_ids > 0")
