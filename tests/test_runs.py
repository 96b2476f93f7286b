"""Runs over one stream of lines, whatever the ranges; figures of a run as it is written."""

import itertools
import random
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from textloom.sources import text
from textloom.streaming import figures


def plain(lines):
    out, at = [], 0
    for value, group in itertools.groupby(lines):
        n = len(list(group))
        out.append((at, value, n))
        at += n
    return out


def collapsed(spark, lines):
    frame = spark.createDataFrame(list(enumerate(lines)), "i long, line string").repartition(5)
    return [tuple(r) for r in text.collapse_stream(frame, ("i",), "line").orderBy("i").collect()]


def test_runs_cross_ranges(spark):
    rng = random.Random(3)
    mixed = [x for _ in range(40) for x in [rng.choice(["a", "b", None, ""])] * rng.randint(1, 60)]
    for lines in (mixed, ["x"] * 500, ["a"] * 300 + ["b"] + ["a"] * 300, [None] * 9, ["one"], list("abcd" * 30)):
        assert collapsed(spark, lines) == plain(lines)


def test_no_lines(spark):
    assert text.collapse_stream(spark.createDataFrame([], "i long, line string"), ("i",), "line").count() == 0


def test_a_million_equal_lines_are_one_row_and_no_task_holds_them(spark):
    frame = spark.range(1_000_000).select(F.col("id").alias("i"), F.when(F.col("id") == 0, "first").otherwise("same").alias("line"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = text.ranged(frame, "i").groupBy(F.shiftright("_id", 33).alias("p")).count().collect()
        assert len(parts) == 16 and max(r["count"] for r in parts) < 150_000
        assert [tuple(r) for r in text.collapse_stream(frame, ("i",), "line").orderBy("i").collect()] == [(0, "first", 1), (1, "same", 999_999)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(spark, n):
    return spark.range(n).select((F.col("id") % 90 + 10).alias("used"), (F.col("id") % 3 + 1).alias("n_segments"), F.when(F.col("id") % 7 > 0, "x").alias("origin"))


def test_observed_while_written(spark, tmp_path):
    seen = Observation()
    figures.observed(rows(spark, 100), seen, "origin").write.parquet(f"{tmp_path}/rows")
    got = figures.of(seen, 128, 8, seconds=2.0)
    want = spark.read.parquet(f"{tmp_path}/rows").agg(F.sum("used"), F.sum("n_segments")).first()
    assert (got.n_rows, got.batches, got.active_slots, got.total_samples, got.unknown) == (100, 13, want[0], want[1], 15)
    assert got.rates()["token_slots_per_s"] == 6400 and got.fill_rate == round(want[0] / 12800, 6)
    none = Observation()
    figures.observed(rows(spark, 100).where("used < 0"), none).write.parquet(f"{tmp_path}/none")
    assert figures.of(none, 128, 8) == figures.Figures(0, 0, 0, 0, 128, 8) and figures.of(none, 128, 8).fill_rate == 0.0


def test_a_stream_reports_each_micro_batch_once(spark, tmp_path):
    frame = rows(spark, 60)
    for k in range(3):
        frame.where(F.col("used") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    listener = figures.RunFigures("packed", 128, 8)
    spark.streams.addListener(listener)
    try:
        read = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = figures.observed(read, "packed").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(50):
            if len(listener.seen) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got, want = listener.figures(), frame.agg(F.sum("used"), F.sum("n_segments")).first()
    assert len(listener.seen) == 3 and (got.n_rows, got.active_slots, got.total_samples) == (60, want[0], want[1]) and got.seconds > 0
