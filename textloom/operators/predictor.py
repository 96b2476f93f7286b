"""A predictor of rewards that sees the whole mixture: one hidden layer over the last losses and the tried action of every objective, fitted by L-BFGS
on gradients that partitions of the history sum up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.feedback import HISTORY

#: Steps of history that a task of a gradient takes.
STEPS_PER_TASK = 256


def shapes(n_in: int, n_out: int, hidden: int) -> list[tuple[int, ...]]:
    return [(n_in, hidden), (hidden,), (hidden, n_out), (n_out,)]


def unpacked(params: np.ndarray, n_in: int, n_out: int, hidden: int) -> list[np.ndarray]:
    parts, at = [], 0
    for shape in shapes(n_in, n_out, hidden):
        size = int(np.prod(shape))
        parts.append(params[at : at + size].reshape(shape))
        at += size
    return parts


def outputs(params: np.ndarray, x: np.ndarray, n_out: int, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values and predicted rewards, the latter between -1 and 1."""
    w, b, v, c = unpacked(params, x.shape[1], n_out, hidden)
    h = np.tanh(x @ w + b)
    return h, np.tanh(h @ v + c)


def summed_gradient(params: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray, hidden: int) -> np.ndarray:
    """Half the squared error over the known rewards and its gradient, as one array: sums over rows, so those of parts add up to those of the whole."""
    h, out = outputs(params, x, y.shape[1], hidden)
    v = unpacked(params, x.shape[1], y.shape[1], hidden)[2]
    miss = np.where(known, out - y, 0.0)
    to_out = miss * (1 - out * out)
    to_hidden = to_out @ v.T * (1 - h * h)
    return np.concatenate([[(miss * miss).sum() / 2], (x.T @ to_hidden).ravel(), to_hidden.sum(axis=0), (h.T @ to_out).ravel(), to_out.sum(axis=0)])


def minimised(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, memory: int = 8, still: float = 1e-6) -> np.ndarray:
    """L-BFGS with backtracking; value: a point's value and gradient. Ends after `rounds`, where the gradient is small, or where no step helps."""
    at = start
    now, slope = value(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < still:
            break
        way, factors = slope.copy(), []
        for move, turn in reversed(moves):
            factors.append(move @ way / (move @ turn))
            way -= factors[-1] * turn
        if moves:
            way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1])
        else:
            way /= max(1.0, float(np.linalg.norm(way)))
        for (move, turn), factor in zip(moves, reversed(factors), strict=True):
            way += (factor - turn @ way / (move @ turn)) * move
        size, fall = 1.0, float(way @ slope)
        while size > 1e-4:
            there, slope_there = value(at - size * way)
            if there <= now - 1e-4 * size * fall:
                break
            size /= 3
        else:
            break
        move, turn = -size * way, slope_there - slope
        at, now, slope = at - size * way, there, slope_there
        if move @ turn > 1e-12:
            moves = [*moves, (move, turn)][-memory:]
    return at


class NetPredictor:
    """Rewards of all objectives from the losses of all of them (the present one and `lags` before it) and a tried action. The history has a row per
    evaluation and objective and is cut to its last HISTORY evaluations; the driver holds the network and a few numbers per objective. Null or
    non-finite losses and actions count as average ones; such rewards teach nothing; without a reward to learn from, none is predicted."""

    def __init__(self, hidden: int = 16, lags: int = 2, rounds: int = 100, decay: float = 1e-3, seed: int = 0):
        self.hidden, self.lags, self.rounds, self.decay, self.seed = hidden, lags, rounds, decay, seed
        self.fitted = False
        self.params: np.ndarray | None = None

    def examples(self, history: DataFrame) -> DataFrame:
        """step and, by obj_idx, losses (newest first), action and reward: a row per evaluation."""
        finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).cast("double")
        last = history.agg(F.max("step").alias("_last"))
        recent = history.crossJoin(F.broadcast(last)).where(F.col("step") > F.col("_last") - HISTORY)
        recent = recent.select("step", "obj_idx", *(finite(c).alias(c) for c in ("old_loss", "action", "reward")))
        before = Window.partitionBy("obj_idx").orderBy("step")
        losses = F.array("old_loss", *(F.lag("old_loss", k).over(before) for k in range(1, self.lags + 1)))
        told = recent.select("step", "obj_idx", losses.alias("losses"), "action", "reward")
        return told.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("obj_idx", "losses", "action", "reward"))).alias("told"))

    def _inputs(self, losses: np.ndarray, action: np.ndarray) -> np.ndarray:
        """losses[row, objective, age], action[row, objective]: standardised, unknown ones average."""
        x = np.concatenate([(losses - self.loss_mean[:, None]) / self.loss_scale[:, None], ((action - self.action_mean) / self.action_scale)[:, :, None]], axis=2)
        return np.nan_to_num(x.reshape(len(x), -1), nan=0.0, posinf=0.0, neginf=0.0)

    def _rows(self, told: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, rewards, and which of these are known."""
        losses = np.full((len(told), len(self.order), self.lags + 1), np.nan)
        action, reward = (np.full((len(told), len(self.order)), np.nan) for _ in range(2))
        place = {o: i for i, o in enumerate(self.order)}
        for row, entries in enumerate(told):
            for e in entries:
                i = place[e["obj_idx"]]
                losses[row, i] = [np.nan if v is None else v for v in e["losses"]]
                action[row, i], reward[row, i] = (np.nan if e[c] is None else e[c] for c in ("action", "reward"))
        return self._inputs(losses, action), np.nan_to_num(reward), ~np.isnan(reward)

    def gradient(self, examples: DataFrame, params: np.ndarray) -> np.ndarray:
        """The error's sum and its gradient over all examples: each partition sums its own into one row, of which there are HISTORY / STEPS_PER_TASK at most."""

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(params) + 1)
            for frame in frames:
                total += summed_gradient(params, *self._rows(list(frame["told"])), self.hidden)
            yield pd.DataFrame({"total": [total]})

        return np.sum([r["total"] for r in examples.select("told").mapInPandas(part, "total array<double>").collect()], axis=0)

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        k, n_in = len(self.order), len(self.order) * (self.lags + 2)
        return np.concatenate([(rng.normal(size=s) / np.sqrt(s[0]) if len(s) == 2 else np.zeros(s)).ravel() for s in shapes(n_in, k, self.hidden)])

    def prepare(self, history: DataFrame) -> DataFrame:
        """The examples, after taking the order and the scales of the objectives, and the last losses."""
        made = self.examples(history)
        each = made.select("step", F.inline("told"))
        scale = lambda c, name: (F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_scale"))
        newest = F.max_by("losses", "step").alias("losses")
        figures = each.groupBy("obj_idx").agg(*scale(F.col("losses")[0], "loss"), *scale("action", "action"), newest, F.count("reward").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("obj_idx").collect()
        self.order = [r["obj_idx"] for r in figures]
        self.n = sum(r["n"] for r in figures)
        for name in ("loss", "action"):
            setattr(self, f"{name}_mean", np.array([r[f"{name}_mean"] or 0.0 for r in figures]))
            setattr(self, f"{name}_scale", np.array([r[f"{name}_scale"] or 1.0 for r in figures]))
        self.last = np.array([[np.nan if v is None else v for v in r["losses"][: self.lags]] for r in figures]).reshape(len(figures), self.lags)
        steps = max((r["rows"] for r in figures), default=0)
        return made.repartition(max(1, -(-steps // STEPS_PER_TASK)), "step")

    def fit(self, history: DataFrame) -> NetPredictor:
        """history(step, obj_idx, old_loss, action, reward)"""
        examples = self.prepare(history).persist()
        self.fitted, self.params = True, None
        if self.n:

            def value(params: np.ndarray) -> tuple[float, np.ndarray]:
                total = self.gradient(examples, params) / self.n
                return total[0] + self.decay / 2 * float(params @ params), total[1:] + self.decay * params

            self.params = minimised(value, self.start(), self.rounds)
        examples.unpersist()
        return self

    def predict(self, losses: DataFrame, actions: DataFrame) -> DataFrame:
        """cand, obj_idx, reward for actions(cand, obj_idx, action) tried at losses(obj_idx, loss), which the history's last losses precede; an
        objective without history is predicted none."""
        if not self.fitted:
            raise ValueError("fit comes first")
        if self.params is None:
            return actions.select("cand", "obj_idx", F.lit(0.0).alias("reward"))
        now = {r["obj_idx"]: r["loss"] for r in losses.select("obj_idx", F.col("loss").cast("double").alias("loss")).collect()}  # a row per objective
        present = np.array([np.nan if now.get(o) is None else now[o] for o in self.order])
        known = np.concatenate([present[:, None], self.last], axis=1)
        place = {o: i for i, o in enumerate(self.order)}

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                action = np.full((len(frame), len(place)), np.nan)
                for row, entries in enumerate(frame["tried"]):
                    for e in entries:
                        if e["obj_idx"] in place and e["action"] is not None:
                            action[row, place[e["obj_idx"]]] = e["action"]
                x = self._inputs(np.broadcast_to(known, (len(frame), *known.shape)), action)
                got = outputs(self.params, x, len(place), self.hidden)[1]
                cells = [(c, e["obj_idx"], got[row, place[e["obj_idx"]]] if e["obj_idx"] in place else 0.0) for row, (c, entries) in enumerate(zip(frame["cand"], frame["tried"], strict=True)) for e in entries]
                yield pd.DataFrame(cells, columns=["cand", "obj_idx", "reward"])

        tried = actions.groupBy("cand").agg(F.collect_list(F.struct("obj_idx", F.col("action").cast("double").alias("action"))).alias("tried"))
        kinds = {f.name: f.dataType.simpleString() for f in actions.schema.fields}
        return tried.mapInPandas(part, f"cand {kinds['cand']}, obj_idx {kinds['obj_idx']}, reward double")
