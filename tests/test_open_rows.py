"""Open rows as the state of a stream: the batch plan however the stream is cut, rows closed by their age, and a look at what is open."""

import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators import packing
from textloom.streaming import open_rows

LENGTH = 100


def items(spark, n=300):
    return spark.range(n).select((F.col("id") % 3).cast("int").alias("shard"), F.col("id").alias("ord"), (F.col("id") * 37 % 70 + 1).cast("int").alias("n"))


def run(told, folder, name):
    with open_rows.rocks(told.sparkSession):
        told.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(240)
    return told.sparkSession.table(name).collect()


def files(spark, frame, folder, cuts):
    bounds = [0, *cuts, 1 << 40]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        frame.where((F.col("ord") >= a) & (F.col("ord") < b)).orderBy(F.desc("ord")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1 if k < len(cuts) else 0)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize(("fit", "cuts"), [("best", []), ("best", [7, 8, 200]), ("worst", [150])])
def test_stream_equals_batch(spark, tmp_path, fit, cuts):
    frame = items(spark)
    batch = packing.place(frame, "n", LENGTH, 10, fit=fit, rows=3)
    want = sorted((r["shard"], r["ord"], r["pack_id"], r["segment"], r["start_off"]) for r in batch.collect())
    got = run(open_rows.rows_of(files(spark, frame, f"{tmp_path}/in", cuts), "n", LENGTH, 10, fit=fit, rows=3), tmp_path, f"rows_{fit}{len(cuts)}")
    assert sorted((r["shard"], r["ord"], r["pack_id"], r["segment"], r["start_off"]) for r in got if r["event"] == "placed") == want
    closed = {(r["shard"], r["pack_id"]): (r["used"], r["n_segments"]) for r in got if r["event"] == "closed"}
    every = {(r["shard"], r["pack_id"]): (r["used"], r["n_segments"], r["forced"]) for r in packing.forced(batch, "n", 3).collect()}
    assert closed == {k: v[:2] for k, v in every.items() if not v[2]} and not [r for r in got if r["event"] == "forced"]
    # what is open, from the batch plan and from the checkpoint
    still = {r["shard"]: tuple(r) for r in packing.readiness(packing.open_rows(batch, "n", 3), LENGTH, 10).collect()}
    assert {r["shard"]: tuple(r) for r in open_rows.peek(spark, f"{tmp_path}/state", LENGTH, 10).collect()} == still and len(still) == 3


def test_rows_close_by_age(spark, tmp_path):
    """The watermark (no delay) passes the age of a shard's rows: they close as they are, and later items open new ones."""
    start = datetime(2024, 1, 1, tzinfo=UTC)
    at = lambda s: start + timedelta(seconds=s)
    rows = [(1, 0, 30, at(0)), (1, 1, 30, at(5)), (2, 2, 30, at(55)), (2, 3, 10, at(70)), (1, 4, 20, at(80)), (2, 5, 5, at(81)), (3, 6, 1, at(200)), (1, 7, 1, at(201))]
    frame = spark.createDataFrame(rows, "shard int, ord int, n int, at timestamp")
    read = files(spark, frame, f"{tmp_path}/in", [2, 4, 6]).withWatermark("at", "0 seconds")
    got = run(open_rows.rows_of(read, "n", LENGTH, 10, rows=2, wait=60_000, event_time="at"), tmp_path, "aged")
    placed = {r["ord"]: (r["pack_id"], r["segment"], r["start_off"]) for r in got if r["event"] == "placed"}
    gone = sorted((r["shard"], r["pack_id"], r["used"], r["n_segments"]) for r in got if r["event"] == "forced")
    assert placed == {0: (0, 1, 0), 1: (0, 2, 30), 2: (0, 1, 0), 3: (0, 2, 30), 4: (0, 3, 60), 5: (0, 3, 40), 6: (0, 1, 0), 7: (2, 1, 0)}
    assert gone == [(1, 0, 80, 3), (2, 0, 45, 3)]


def test_too_long_an_item_fails_the_stream(spark, tmp_path):
    frame = spark.createDataFrame([(0, 0, LENGTH + 1)], "shard int, ord int, n int")
    with pytest.raises(Exception, match="does not fit"):
        run(open_rows.rows_of(files(spark, frame, f"{tmp_path}/in", []), "n", LENGTH), tmp_path, "long")


def test_readiness():
    assert packing.row_for(10, [0, 0], [0, 0], 100, 10, 9, True) == 0
    assert packing.row_for(10, [95, 92], [1, 1], 100, 10, 9, True) is None
    assert packing.row_for(10, [50, 92], [1, 1], 100, 10, 1, True) is None
