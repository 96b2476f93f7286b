"""The predictor over history: gradients, what it learns that a line can't, odd rows, and its place in the loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import feedback, predictor
from textloom.plans import catalogue

HISTORY = "step long, obj_idx int, old_loss double, action double, reward double"


def planted(steps, k=2, seed=0, first=0):
    """Rewards that hang on action times loss, and on whether the loss before was higher."""
    rng = np.random.default_rng(seed)
    losses, actions = rng.uniform(1, 3, (steps, k)), rng.uniform(0, 1, (steps, k))
    before = np.vstack([losses[:1], losses[:-1]])
    reward = np.tanh(2.5 * (actions - 0.5) * (losses - 2) + 0.4 * np.sign(before - 2))
    return [(first + s, i, float(losses[s, i]), float(actions[s, i]), float(reward[s, i])) for s in range(steps) for i in range(k)]


def test_gradient_is_that_of_the_error():
    rng = np.random.default_rng(1)
    x, y, known = rng.normal(size=(9, 6)), rng.uniform(-1, 1, (9, 2)), rng.uniform(size=(9, 2)) < 0.8
    params = rng.normal(size=6 * 3 + 3 + 3 * 2 + 2) * 0.5
    total = predictor.summed_gradient(params, x, y, known, 3)
    for i in range(len(params)):
        up, down = (predictor.summed_gradient(params + e * np.eye(len(params))[i] * 1e-5, x, y, known, 3)[0] for e in (1, -1))
        assert np.isclose((up - down) / 2e-5, total[i + 1], atol=1e-7)


def test_partitions_sum_to_one_machine(spark):
    made = predictor.NetPredictor(hidden=5, lags=1)
    history = spark.createDataFrame(planted(700), HISTORY)
    examples = made.prepare(history)
    assert examples.rdd.getNumPartitions() == 3
    params = made.start()
    x, y, known = made._rows([r["told"] for r in examples.collect()])
    assert x.shape == (700, 6) and known.all()
    want = predictor.summed_gradient(params, x, y, known, 5)
    for n in (1, 3, 7):
        assert np.allclose(made.gradient(examples.repartition(n), params), want, rtol=1e-10, atol=1e-10)
    # the loss before is the one of the step before
    by_step = {r["step"]: r["told"] for r in examples.collect()}
    assert by_step[5][1]["losses"] == [by_step[5][1]["losses"][0], by_step[4][1]["losses"][0]] and by_step[0][0]["losses"][1] is None


def test_minimiser_finds_the_least_of_a_bowl():
    a = np.diag(np.arange(1.0, 21.0)) + 0.3
    b = np.arange(20.0)
    found = predictor.minimised(lambda p: (float(p @ a @ p / 2 - b @ p), a @ p - b), np.zeros(20), 200, still=1e-9)
    assert np.allclose(found, np.linalg.solve(a, b), atol=1e-6)


def test_beats_a_line_on_a_planted_interaction(spark):
    seen = planted(600)
    history = spark.createDataFrame(seen, HISTORY)
    net, line = predictor.NetPredictor(lags=1).fit(history), feedback.RidgePredictor().fit(history)
    last = {i: seen[-2 + i][2] for i in (0, 1)}
    assert net.last[:, 0].tolist() == [last[0], last[1]]
    actions = spark.createDataFrame([(c, i, float(a)) for c, (a, b) in enumerate(np.random.default_rng(3).uniform(0, 1, (200, 2))) for i, a in enumerate((a, b))], "cand long, obj_idx int, action double")
    error = {}
    for losses in ((1.2, 2.9), (2.8, 1.1), (2.0, 2.6)):
        now = spark.createDataFrame(list(enumerate(losses)), "obj_idx int, loss double")
        for name, model in (("net", net), ("line", line)):
            got = model.predict(now, actions).join(actions, ["cand", "obj_idx"]).collect()
            assert len(got) == 400
            error.setdefault(name, []).append(np.mean([(r["reward"] - np.tanh(2.5 * (r["action"] - 0.5) * (losses[r["obj_idx"]] - 2) + 0.4 * np.sign(last[r["obj_idx"]] - 2))) ** 2 for r in got]))
    assert np.mean(error["net"]) < 0.25 * np.mean(error["line"]), error


def test_odd_rows(spark):
    net = predictor.NetPredictor(hidden=3, rounds=5)
    actions = spark.createDataFrame([(0, 0, 0.5), (0, 7, 0.5), (1, 0, None)], "cand long, obj_idx int, action double")
    now = spark.createDataFrame([(0, 1.0), (7, None)], "obj_idx int, loss double")
    with pytest.raises(ValueError):
        net.predict(now, actions)
    nothing = spark.createDataFrame([], HISTORY)
    assert [r["reward"] for r in net.fit(nothing).predict(now, actions).collect()] == [0.0] * 3
    untold = spark.createDataFrame([(0, 0, 1.0, 0.5, None), (1, 0, 1.0, 0.5, float("nan"))], HISTORY)
    assert {r["reward"] for r in net.fit(untold).predict(now, actions).collect()} == {0.0}
    rows = [(0, 0, None, 0.5, 0.2), (1, 0, float("inf"), None, 0.1), (2, 0, 2.0, 0.4, float("nan")), (3, 0, 2.0, 0.3, 0.4), (3, 1, 2.0, 0.3, 0.4)]
    got = {(r["cand"], r["obj_idx"]): r["reward"] for r in net.fit(spark.createDataFrame(rows, HISTORY)).predict(now, actions).collect()}
    assert got[0, 7] == 0.0 and set(got) == {(0, 0), (0, 7), (1, 0)} and all(np.isfinite(list(got.values()))) and -1 <= got[0, 0] <= 1


def test_history_is_cut(spark):
    net = predictor.NetPredictor()
    long = spark.range(0, 5000).select(F.col("id").alias("step"), F.lit(0).alias("obj_idx"), F.lit(1.0).alias("old_loss"), F.lit(0.5).alias("action"), F.lit(0.1).alias("reward"))
    assert net.examples(long).count() == feedback.HISTORY


def test_the_loop_takes_it(spark):
    steps, k = 30, 3
    rng = np.random.default_rng(5)
    losses = spark.createDataFrame([(s, i, float(rng.uniform(1, 3))) for s in range(steps) for i in range(k)], "step long, obj_idx int, loss double")
    tried = spark.createDataFrame([(s, i, float(rng.uniform(0, 1))) for s in range(steps) for i in range(k)], "step long, obj_idx int, action double")
    classes = spark.createDataFrame([(i, i, 1.0) for i in range(k)], "obj_idx int, class_id int, weight double")
    got = feedback.update_and_sample(spark, losses, tried, classes, 3, 0.0, predictor.NetPredictor(rounds=8), n=64).collect()
    assert len(got) == k and abs(sum(r["prob"] for r in got) - 1) < 1e-3


def test_fit_over_events_equals_one_machine(spark):
    """The history of `history_mixture`, fitted over partitions and by one process."""
    daily, tried, _ = catalogue.daily_turns(spark, "/root/testdata/sf0.01")
    history = feedback.rewards(daily, "obj_idx").join(tried, ["step", "obj_idx"]).select("step", "obj_idx", "old_loss", "action", "reward")
    net = predictor.NetPredictor(rounds=12)
    x, y, known = net._rows([r["told"] for r in net.prepare(history).collect()])
    assert len(x) > 10 and x.shape[1] == 5 * 4 and known.sum() == history.count()

    def value(p):
        total = predictor.summed_gradient(p, x, y, known, net.hidden) / known.sum()
        return total[0] + net.decay / 2 * float(p @ p), total[1:] + net.decay * p

    want = predictor.minimised(value, net.start(), 12)
    got = net.fit(history).params
    assert np.allclose(got, want, atol=1e-6) and value(got)[0] < 0.9 * value(net.start())[0]
