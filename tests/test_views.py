"""Looks at the state of a run, casts that don't fail, shuffles within shards, and odd rows of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import casts
from textloom.operators import feedback, packing
from textloom.sources import text as sources

OBJECTIVES = [(0, "a"), (1, None), (2, "c")]


@pytest.fixture
def objectives(spark):
    return spark.createDataFrame(OBJECTIVES, "obj_idx int, name string")


def history(spark, rows, value):
    return spark.createDataFrame(rows, f"step long, obj_idx int, {value} double")


def test_the_action_in_force(spark, objectives):
    prob = lambda rows: [r["prob"] for r in feedback.current_action(objectives, history(spark, rows, "action")).orderBy("obj_idx").collect()]
    assert prob([(1, 0, 0.9), (1, 1, 0.1), (1, 2, 0.0), (2, 0, 0.5), (2, 1, 0.2), (2, 2, 0.3)]) == [0.5, 0.2, 0.3]
    third = pytest.approx([1 / 3] * 3)
    assert prob([(1, 0, 0.9), (1, 1, 0.1), (1, 2, 0.0), (2, 0, 0.5), (2, 1, 0.5)]) == third  # one too few
    assert prob([(1, 0, 0.4), (1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.3)]) == third and prob([(1, 0, 0.4), (1, 1, None), (1, 2, 0.2)]) == third
    assert prob([]) == [None] * 3


def test_losses_and_what_people_read(spark, objectives):
    losses = history(spark, [(5, 0, 1.23456), (5, 1, 2.0), (5, 2, 10.0)], "loss")
    actions = history(spark, [(5, 0, 0.25), (5, 1, 0.25), (5, 2, 0.5)], "action")
    got = feedback.verbose_action(objectives, actions, losses, "name").orderBy("obj_idx").collect()
    assert [r["told"] for r in got] == ["a: 0.250 loss 1.235", "objective_1: 0.250 loss 2.000", "c: 0.500 loss 10.000"]
    short = feedback.verbose_action(objectives, actions, losses.where("obj_idx < 2"), "name").collect()
    assert {r["loss"] for r in short} == {None} and all("loss" not in r["told"] for r in short)
    assert feedback.verbose_action(objectives.limit(0), actions, losses, "name").count() == 0


def test_casts(spark):
    frame = spark.createDataFrame([("1.5", "héx", 3, [1, 2]), ("x", "", None, None), ("", None, 0, []), (None, "😀", 1, [None])], "raw string, s string, n int, a array<int>")
    number, kept = casts.number_or_kept(F.col("raw"))
    got = frame.select(number.alias("v"), kept.alias("k"), *(casts.as_list(frame, c).alias(c) for c in ("s", "n", "a")), casts.shown(F.col("n")).alias("t")).collect()
    assert [(r["v"], r["k"]) for r in got] == [(1.5, None), (None, "x"), (None, ""), (None, None)]
    assert [r["s"] for r in got] == [["h", "é", "x"], [], [], ["😀"]] and [r["n"] for r in got] == [[3], [], [0], [1]]
    assert [r["a"] for r in got] == [[1, 2], [], [], [None]] and [r["t"] for r in got] == ["3.000", None, "0.000", "1.000"]


def test_rows_that_go(spark):
    rows = spark.createDataFrame([(0, 0, 100), (0, 1, 96), (1, 0, 100), (1, 1, 10)], "shard int, pack_id long, used long")
    assert sorted((r["shard"], r["pack_id"]) for r in packing.popped(rows, 100, 8).collect()) == [(0, 0), (0, 1)]
    assert sorted((r["shard"], r["pack_id"], r["popped"]) for r in packing.popped(rows, 100, 8, peek=True).collect()) == [(0, 0, True), (0, 1, True), (1, 0, False), (1, 1, False)]
    assert packing.popped(rows.limit(0), 100).count() == 0


def test_shuffles_within_shards(spark):
    frame = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.lit(4)).otherwise(F.lit(11)).alias("shard"), F.lit(1).alias("pos_of_source"))
    got = sources.shuffled_within(frame, "shard", "id", 2).toPandas()
    for _, part in got.groupby("shard"):
        assert sorted(part["pos"]) == list(range(len(part))) and abs(np.corrcoef(part["id"], part["pos"])[0, 1]) < 0.1
    again = sources.shuffled_within(frame.repartition(7), "shard", "id", 2).toPandas()
    assert got.sort_values("id")["pos"].tolist() == again.sort_values("id")["pos"].tolist()
    assert got.columns.tolist() == ["id", "shard", "pos_of_source", "pos"]
    assert sources.shuffled_within(frame.limit(0), "shard", "id").count() == 0
