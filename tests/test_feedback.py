"""The loop from losses to mixtures: its turns, its switches and its predictor."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import feedback

CLASSES = "obj_idx int, class_id int, weight double"


def evaluations(spark, steps, k=3, seed=0):
    rng = np.random.default_rng(seed)
    losses = spark.createDataFrame([(s, i, float(rng.uniform(1, 3))) for s in range(steps) for i in range(k)], "step long, obj_idx int, loss double")
    tried = spark.createDataFrame([(s, i, float(rng.uniform(0, 1))) for s in range(steps) for i in range(k)], "step long, obj_idx int, action double")
    return losses, tried, spark.createDataFrame([(i, i % 2, 2 / (1 + (i % 2 == 0))) for i in range(k)], CLASSES)


def test_turns(spark):
    losses, tried, classes = evaluations(spark, 6)
    one = losses.where("step = 0")
    got = feedback.update_and_sample(spark, one, tried.where("step = 0"), classes, 1, 1.0).collect()
    assert {r["obj_idx"]: r["prob"] for r in got} == {r["obj_idx"]: round(r["action"], 4) for r in tried.where("step = 0").collect()} and not any(r["explored"] for r in got)
    none = feedback.update_and_sample(spark, losses.limit(0), tried.limit(0), classes, 1, 1.0)
    assert none.count() == 0
    for rate, explored in ((1.0, True), (0.0, False), (1e-4, False)):
        got = feedback.update_and_sample(spark, losses, tried, classes, 3, rate, n=64).collect()
        assert len(got) == 3 and abs(sum(r["prob"] for r in got) - 1) < 1e-3 and {r["explored"] for r in got} == {explored}


def test_explore_action_is_the_base_of_the_candidates(spark):
    losses, _, classes = evaluations(spark, 1)
    now = losses.select("obj_idx", "loss")
    base = feedback.explore_action(classes, 4, 9)
    made = feedback.candidates(spark, now, 50, 0, base).where("cand < 50").groupBy("obj_idx").agg(F.min("action").alias("a"), F.max("action").alias("b")).collect()
    action, loss = ({r["obj_idx"]: r[c] for r in f.collect()} for f, c in ((base, "action"), (now, "loss")))
    total = sum(action[i] * loss[i] for i in action)
    assert all(r["a"] == r["b"] == pytest.approx(action[r["obj_idx"]] * loss[r["obj_idx"]] / total) for r in made)


def test_exploring_is_switched_off(spark):
    at = spark.range(0, 4000, 500)
    on = lambda low, high: [r["e"] for r in at.select(feedback.explores(F.col("id"), F.lit(1.0), 2000, low, high).alias("e")).collect()]
    assert on(0.1, 0.9) == [True] * 8 and on(0.0, 0.9) == [True] * 5 + [False] * 3 and on(0.0, 1e-4) == [False] * 8


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, *map(float, rng.normal(size=2)), 0.0) for s in range(40) for i in range(2)]
    rows = [(*r[:4], 0.3 * r[2] - 0.8 * r[3] + 0.1 * r[1]) for r in rows]
    model = feedback.RidgePredictor(0.05).fit(spark.createDataFrame(rows, "step long, obj_idx int, old_loss double, action double, reward double")).model.collect()
    for r in model:
        x = np.array([row[2:4] for row in rows if row[1] == r["obj_idx"]])
        y = np.array([row[4] for row in rows if row[1] == r["obj_idx"]])
        c = x - x.mean(axis=0)
        want = np.linalg.solve(c.T @ c / len(c) + 0.05 * np.eye(2), c.T @ (y - y.mean()) / len(c))
        assert np.allclose([r["by_loss"], r["by_action"]], want) and np.isclose(r["level"], y.mean() - want @ x.mean(axis=0))
    with pytest.raises(ValueError):
        feedback.RidgePredictor().predict(None, None)
