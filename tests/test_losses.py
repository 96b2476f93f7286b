"""A stream of losses tells the evaluations that the batch version tells, however it is cut, and turns the loop."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import config
from textloom.streaming import losses, worker

EXPECTED = {"click": 4, "view": 3, "error": 4, "absent": 0}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.select(losses.evaluation_of(F.col("ts")).alias("evaluation"), F.col("event_id").alias("loss_id"), F.col("event_type").alias("obj_key"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("loss"))


def files(spark, frame, folder, cuts):
    bounds = [0, *cuts, 1 << 40]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        frame.where((F.col("loss_id") >= a) & (F.col("loss_id") < b)).orderBy(F.desc("loss_id")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1 if k < len(cuts) else 0)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(frame):
    return sorted((r["evaluation"], r["obj_key"], round(r["mean_loss"], 9), r["n"]) for r in frame.collect())


@pytest.mark.parametrize("cuts", [[], [333], [100, 101, 640]])
def test_stream_equals_batch(spark, rocks, tmp_path, cuts):
    frame = events(spark)
    want = rows(losses.completed(frame, EXPECTED))
    days = {r[0] for r in want}
    assert 0 < len(days) < frame.select("evaluation").distinct().count() and len(want) == 3 * len(days)
    name = f"told{len(cuts)}"
    losses.stream(files(spark, frame, str(tmp_path / "in"), cuts), EXPECTED).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(180)
    assert rows(spark.table(name)) == want


def test_the_loop_turns(spark, tmp_path):
    """The first evaluation leaves the mixture alone; later ones publish a new one for the micro-batches after."""
    entries = config.normalised([config.objective("copying", 0.6), config.objective("next_token_prediction", 0.4)])
    names = [e.nickname for e in entries]
    means = spark.createDataFrame([(s, n, 2.0 - 0.1 * s * (i + 1), 3) for s in range(3) for i, n in enumerate(names)], losses.MEANS)
    folder, coming = str(tmp_path / "loop"), str(tmp_path / "in")
    for s in range(3):
        means.where(f"evaluation = {s}").coalesce(1).write.mode("append").parquet(coming)
        time.sleep(1.1)
    classes = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "obj_idx int, class_id int, weight double")
    read = spark.readStream.schema(means.schema).option("maxFilesPerTrigger", 1).parquet(coming)
    losses.turning(read, folder, list(entries), classes, n=32).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
    probs = [[round(e.prob, 4) for e in worker.mixture_at(spark, folder, b)[1]] for b in (1, 2, 3)]
    assert probs[0] == [0.6, 0.4] and probs[1] != probs[0] and all(abs(sum(p) - 1) < 1e-3 for p in probs)
