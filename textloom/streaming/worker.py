"""Coupled building and packing: each example gets the room that the open row has left, and what it leaves of a text goes on to the
next drawn objective. Per shard this is a fold over ordered texts, in a batch or a stream.

What a shard holds between texts is four numbers; examples leave as soon as they are placed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions.hashrand import draw
from textloom.functions.tokens import Characters
from textloom.operators.config import OPTIONS, REGISTERED, Objective, normalised, objective
from textloom.operators.spans import CHARACTERS, example_at

PLACED = "shard int, doc_id long, ex_seq long, objective string, pack_id long, segment int, start_off int, n_input int, n_label int, input_ids array<int>, label_ids array<int>, unused long, status string"
MIXTURES = "mixture int, from_batch long, obj_idx int, name string, prob double, overrides string"
STATE = "seq long, pack long, used int, segment int"


class PipelineError(RuntimeError):
    """A text or example that stops a strict run; `reason` says why."""

    def __init__(self, reason: str, message: str):
        super().__init__(f"{reason}: {message}")
        self.reason = reason


@dataclass(frozen=True)
class Run:
    """What all shards share."""

    entries: tuple[Objective, ...]
    length: int = 1024
    min_room: int = 64
    seed: int = 0
    strict: bool = True
    tok: object = CHARACTERS
    #: Whether examples carry their ids, or only their sizes and places.
    ids: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.min_room < self.length:
            raise ValueError("min_room lies below length")
        if not self.entries:
            raise ValueError("a mixture has entries")


def _example(ids: list[int], at: int, chars: int, entry: Objective, room: int, key: str, tok) -> dict:
    options = entry.options
    if 0 <= room < int(options["minimum_remaining_space"]):
        return {"status": "not_enough_space"}
    if chars < int(options["minimum_sequence_length"]) or 0 <= int(options["maximum_sequence_length"]) < chars:
        return {"status": "error"}
    return example_at(ids, at, replace(entry, overrides=(*entry.overrides, ("remaining_space", room))), key, tok=tok)


class ShardFold:
    """One shard's fold; `state` is (examples so far, open row, slots used, segments)."""

    def __init__(self, run: Run, shard: int, state: tuple[int, int, int, int] = (0, 0, 0, 0)):
        self.run, self.shard = run, shard
        self.seq, self.pack, self.used, self.segment = state

    @property
    def state(self) -> tuple[int, int, int, int]:
        return self.seq, self.pack, self.used, self.segment

    def close(self) -> None:
        if self.used:
            self.pack, self.used, self.segment = self.pack + 1, 0, 0

    def choose(self) -> Objective:
        u = draw(f"{self.run.seed}:{self.shard}:{self.seq}")
        for e in self.run.entries[:-1]:
            if (u := u - e.prob) < 0:
                return e
        return self.run.entries[-1]

    def feed(self, doc_id: int, text: str | None) -> Iterator[tuple]:
        """Places all examples of one text."""
        run = self.run
        if not isinstance(text, str) or not text.strip():
            yield from self.failed(doc_id, "empty_text", "a text is blank or missing")
            return
        ids, at, chars = run.tok.encode(text), 0, len(text)  # a text is encoded once, whatever the number of its examples
        while at < len(ids):
            entry = self.choose()
            got = _example(ids, at, chars, entry, run.length - self.used, f"{self.shard}:{self.seq}", run.tok)
            if got["status"] == "not_enough_space" and self.used:
                self.close()
                continue
            self.seq += 1
            if got["status"] != "ok":
                yield from self.failed(doc_id, got["status"], f"{entry.name} can't use {chars} characters in {run.length - self.used} slots", entry.name, self.seq - 1)
                return
            n, m, used = len(got["input_ids"]), len(got["label_ids"]), got["used"]
            if not n or not m:
                yield from self.failed(doc_id, "empty_input_ids" if not n else "empty_label_ids", f"{entry.name} made an empty example", entry.name, self.seq - 1)
                return
            if n + m > run.length - self.used:
                self.close()
                if n + m > run.length:
                    yield from self.failed(doc_id, "sample_too_large_for_packer", f"{n + m} slots", entry.name, self.seq - 1)
                    return
            at += used
            chars = 0 if at >= len(ids) else max(1, chars - (used if isinstance(run.tok, Characters) else len(run.tok.decode(ids[at - used : at]))))
            self.segment += 1
            yield (self.shard, doc_id, self.seq - 1, entry.name, self.pack, self.segment, self.used, n, m, *((got["input_ids"], got["label_ids"]) if run.ids else (None, None)), chars, "ok")
            self.used += n + m
            if run.length - self.used <= run.min_room:
                self.close()
            if not used:
                return

    def told(self) -> list[tuple]:
        """The state as a row of status `state`."""
        return [(self.shard, None, self.seq, None, self.pack, self.segment, self.used, None, None, None, None, None, "state")]

    def failed(self, doc_id: int, reason: str, message: str, name: str | None = None, seq: int | None = None) -> Iterator[tuple]:
        """A failure as a row. seq: the number of the example that failed; without one, that of the next."""
        if self.run.strict:
            raise PipelineError(reason, message)
        yield (self.shard, doc_id, self.seq if seq is None else seq, name, None, None, None, None, None, None, None, None, reason)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.strip().split(" ")[0] for c in PLACED.split(",")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("doc_id", "ex_seq", "pack_id", "segment", "start_off", "n_input", "n_label", "unused")})


def fold(texts: DataFrame, run: Run, order: tuple[str, ...] = ("ord",), states: DataFrame | None = None) -> DataFrame:
    """Placed examples of texts(shard, doc_id, text, and the order columns). A shard is read as sorted batches, never as a whole. states: rows
    of status `state` from an earlier fold, where its shards go on; with them, the result ends each shard with such a row."""

    keeps = states is not None

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: ShardFold | None = None
        for frame in frames:
            rows: list[tuple] = []
            for shard, doc_id, text, state in zip(frame["shard"], frame["doc_id"], frame["text"], frame["state"], strict=True):
                if at is None or at.shard != shard:
                    rows += at.told() if at and keeps else ()
                    at = ShardFold(run, int(shard))
                if state is not None:
                    at = ShardFold(run, int(shard), tuple(map(int, state)))
                    continue
                rows += at.feed(int(doc_id), text)
                if len(rows) > 2000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)
        if at and keeps:
            yield _frame(at.told())

    keys = [c for c in dict.fromkeys([*order, "doc_id"]) if c != "text"]
    kept = texts.select("shard", *keys, "text").withColumn("state", F.lit(None).cast("array<long>"))
    if states is not None:  # a shard's state comes before its texts
        before = states.where("status = 'state'").select("shard", *(F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in keys), F.lit(None).cast("string").alias("text"), F.array("ex_seq", "pack_id", F.col("start_off").cast("long"), F.col("segment").cast("long")).alias("state"))
        kept = kept.unionByName(before)
    return kept.withColumn("_later", F.col("state").isNull()).repartition("shard").sortWithinPartitions("shard", "_later", *order).select("shard", "doc_id", "text", "state").mapInPandas(walk, PLACED)


def stream(texts: DataFrame, run: Run) -> DataFrame:
    """The same over a stream: a shard's four numbers are its state. Within a micro-batch, a shard's texts go by doc_id (then text), whatever the
    order they came in; so a micro-batch's texts of one shard are held together."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = ShardFold(run, int(key[0]), tuple(state.get) if state.exists else (0, 0, 0, 0))
        every = pd.concat(list(frames)).sort_values(["doc_id", "text"], kind="stable")
        rows: list[tuple] = []
        for doc_id, text in zip(every["doc_id"], every["text"], strict=True):
            rows += at.feed(int(doc_id), text)
            if len(rows) > 2000:
                yield _frame(rows)
                rows = []
        yield _frame(rows)
        state.update(at.state)

    return texts.select("shard", "doc_id", "text").groupBy("shard").applyInPandasWithState(step, PLACED, STATE, "append", GroupStateTimeout.NoTimeout)


def publish_mixture(spark: SparkSession, folder: str, entries: list[Objective], version: int, from_batch: int) -> None:
    """Adds a mixture to the table of mixtures in `folder`: micro-batches from `from_batch` on draw from it, until a later one takes over."""
    rows = [(version, from_batch, i, e.name, e.prob, json.dumps(dict(e.overrides), default=str)) for i, e in enumerate(normalised(entries))]
    spark.createDataFrame(rows, MIXTURES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/mixtures/version={version}")


def mixture_at(spark: SparkSession, folder: str, batch: int) -> tuple[int, tuple[Objective, ...]]:
    """The version and entries that a micro-batch draws from. A mixture has a few dozen rows."""
    rows = spark.read.schema(MIXTURES).parquet(f"{folder}/mixtures/version=*").where(F.col("from_batch") <= batch).orderBy("from_batch", "mixture", "obj_idx").collect()
    if not rows:
        raise PipelineError("no_mixture", f"none is published for micro-batch {batch}")
    last = rows[-1]["mixture"]
    missing = sorted({r["name"] for r in rows if r["mixture"] == last} - {*OPTIONS, *REGISTERED})
    if missing:
        raise PipelineError("unknown_objective", f"register {', '.join(missing)} in this driver before its mixture is read")
    return last, tuple(objective(r["name"], r["prob"], **json.loads(r["overrides"])) for r in rows if r["mixture"] == last)


def stream_with_mixtures(texts: DataFrame, run: Run, folder: str) -> DataStreamWriter:
    """A stream whose mixture may change between micro-batches. Each writes its rows, with the mixture's version, to `folder`/placed/batch=N,
    and its shards' states among them, from which the next goes on; a repeated micro-batch overwrites its own rows with the same ones."""

    def step(frame: DataFrame, batch: int) -> None:
        spark = frame.sparkSession
        version, entries = mixture_at(spark, folder, batch)
        states = spark.createDataFrame([], PLACED) if batch == 0 else spark.read.schema(PLACED).parquet(f"{folder}/placed/batch={batch - 1}")
        placed = fold(frame, replace(run, entries=entries), ("doc_id", "text"), states)
        placed.withColumn("mixture", F.lit(version)).write.mode("overwrite").parquet(f"{folder}/placed/batch={batch}")

    return texts.writeStream.foreachBatch(step)


def batches_of(rows: DataFrame, most: int = -1) -> Iterator[dict]:
    """Packed rows by batch on the driver, one batch at a time (rows sorted by shard, batch_id, row_in_batch); at most `most`."""
    import numpy as np

    held: list = []
    at, n = None, 0
    for row in rows.orderBy("shard", "batch_id", "row_in_batch").toLocalIterator(prefetchPartitions=True):
        key = (row["shard"], row["batch_id"])
        if at is not None and key != at:
            yield {k: np.array([r[k] for r in held], dtype=np.int32) for k in ("input_ids", "label_ids", "segment_ids", "attention_mask")}
            held, n = [], n + 1
            if 0 <= most <= n:
                return
        at = key
        held.append(row)
    if held and not 0 <= most <= n:
        yield {k: np.array([r[k] for r in held], dtype=np.int32) for k in ("input_ids", "label_ids", "segment_ids", "attention_mask")}
