"""Losses as they come in: an evaluation is told once it has all the losses that are expected of it, and the loop then turns.

`completed` is the batch version. `stream` keeps, by evaluation, counts and sums per objective as state, and tells the evaluation's means in the micro-batch in which
its last missing loss arrives, after which the sums are given up. Only the first expected losses of an objective count, in the order of their ids, so the result doesn't
depend on how the stream is cut, as long as an evaluation's losses come in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from textloom.operators import config, feedback
from textloom.streaming.worker import publish_mixture

MEANS = "evaluation long, obj_key string, mean_loss double, n long"


def completed(losses: DataFrame, expected: dict[str, int]) -> DataFrame:
    """evaluation, obj_key, mean_loss, n of the evaluations of losses(evaluation, loss_id, obj_key, loss) that have all expected losses: the mean over
    each objective's first expected ones. Null losses don't count. An evaluation's losses of one objective are ranked together."""
    wanted = F.create_map(*(F.lit(x) for pair in expected.items() for x in pair))
    kept = losses.where(F.col("obj_key").isin(*expected) & F.col("loss").isNotNull()).withColumn("wanted", wanted[F.col("obj_key")])
    rank = F.row_number().over(Window.partitionBy("evaluation", "obj_key").orderBy("loss_id"))
    means = kept.withColumn("rank", rank).where("rank <= wanted").groupBy("evaluation", "obj_key", "wanted").agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n"))
    full = means.where("n >= wanted").groupBy("evaluation").agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") == len([k for k, n in expected.items() if n > 0]))
    return means.join(full, "evaluation", "left_semi").select(F.col("evaluation").cast("long"), "obj_key", "mean_loss", "n")


class Fulfilment(StatefulProcessor):
    """An evaluation's counts and sums, and whether it was told."""

    def __init__(self, expected: dict[str, int]):
        self.expected = {k: n for k, n in expected.items() if n > 0}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "obj_key string", "total double, n long")
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.told.exists():
            return
        held = {k: (v[0], v[1]) for (k,), v in self.sums.iterator()}
        before = dict(held)
        for r in sorted((r for r in rows if r["loss"] is not None), key=lambda r: r["loss_id"]):
            total, n = held.get(r["obj_key"], (0.0, 0))
            if n < self.expected.get(r["obj_key"], 0):
                held[r["obj_key"]] = (total + r["loss"], n + 1)
        if all(held.get(k, (0.0, 0))[1] >= n for k, n in self.expected.items()):
            for k in before:
                self.sums.removeKey((k,))
            self.told.update((True,))
            yield from (Row(evaluation=key[0], obj_key=k, mean_loss=total / n, n=n) for k, (total, n) in sorted(held.items()))
            return
        for k, v in held.items():
            if before.get(k) != v:
                self.sums.updateValue((k,), v)

    def close(self) -> None:
        pass


def stream(losses: DataFrame, expected: dict[str, int]) -> DataFrame:
    """The same over a stream, with RocksDB as its state store (spark.sql.streaming.stateStore.providerClass)."""
    kept = losses.where(F.col("obj_key").isin(*expected)).select(F.col("evaluation").cast("long").alias("evaluation"), "loss_id", "obj_key", "loss")
    return kept.groupBy("evaluation").transformWithState(Fulfilment(expected), MEANS, "append", "none")


def turning(means: DataFrame, folder: str, entries: list[config.Objective], classes: DataFrame, turn: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, **options: object) -> DataStreamWriter:
    """Each completed evaluation of a stream of means turns the loop: its losses and the mixture that led to them go to tables in `folder`, and the next
    mixture is published for the micro-batches after. A repeated micro-batch overwrites its own tables. entries: in the order of classes(obj_idx, ...),
    named by nickname in the losses. turn: (losses, actions, step) -> (obj_idx, prob), by default `feedback.update_and_sample` with the options."""
    order = {e.nickname: i for i, e in enumerate(entries)}

    def step(frame: DataFrame, batch: int) -> None:
        spark = frame.sparkSession
        number = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
        told = frame.select(F.col("evaluation").alias("step"), number[F.col("obj_key")].cast("int").alias("obj_idx"), F.col("mean_loss").alias("loss")).where("obj_idx is not null")
        told.write.mode("overwrite").parquet(f"{folder}/losses/batch={batch}")
        new = [r["step"] for r in spark.read.parquet(f"{folder}/losses/batch={batch}").select("step").distinct().collect()]  # evaluations of a micro-batch
        before = [e.prob for e in entries] if batch == 0 else [r["prob"] for r in spark.read.parquet(f"{folder}/turns/batch={batch - 1}").orderBy("obj_idx").collect()]
        led = spark.createDataFrame([(int(s), i, float(p)) for s in new for i, p in enumerate(before)], "step long, obj_idx int, action double")
        led.write.mode("overwrite").parquet(f"{folder}/actions/batch={batch}")
        made = before
        if new:
            every = lambda what: spark.read.parquet(*(f"{folder}/{what}/batch={b}" for b in range(batch + 1)))
            last = int(max(new))
            got = turn(every("losses"), every("actions"), last) if turn else feedback.update_and_sample(spark, every("losses"), every("actions"), classes, last, **{"rate": 0.0, **options})
            made = [r["prob"] for r in got.orderBy("obj_idx").collect()]  # a row per objective
        spark.createDataFrame([(i, float(p)) for i, p in enumerate(made)], "obj_idx int, prob double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/turns/batch={batch}")
        if new:
            publish_mixture(spark, folder, [config.objective(e.name, p, **dict(e.overrides)) for e, p in zip(entries, made, strict=True)], batch + 1, batch + 1)

    return means.writeStream.foreachBatch(step)


def evaluation_of(at: Column) -> Column:
    """Days as evaluations."""
    return F.datediff(at, F.lit("1970-01-01")).cast("long")
