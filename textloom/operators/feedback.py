"""From losses to the next mixture: means, completeness, rewards, candidates, a pluggable predictor, and the choice."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.casts import shown
from textloom.functions.hashrand import draw, pareto, uniform

#: Scale and shape of the candidates' Pareto draws, candidates of each kind, how many of the best are averaged,
#: history that a fit sees, steps of the explore table.
PARETO = ((5.0, 3.0), (3.0, 2.0), (2.0, 1.0))
CANDIDATES, BEST, HISTORY, EXPLORE_STEPS = 4096, 8, 2048, 128_000
#: Fixed value: exploration rates up to this count as none.
OFF = 1e-4


def mean_losses(losses: DataFrame, key: str = "obj_key", loss: str = "loss") -> DataFrame:
    return losses.groupBy(F.col(key).alias("obj_key")).agg(F.avg(loss).alias("mean_loss"), F.count(loss).alias("n"))


def fulfilled(means: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(obj_key, n_expected) with whether enough losses are there; nothing expected is enough."""
    return expected.join(means, "obj_key", "left").select("obj_key", "n_expected", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("n_expected")).alias("fulfilled"))


def loss_vector(objectives: DataFrame, means: DataFrame) -> DataFrame:
    """objectives(obj_idx, obj_key) with their mean losses, 0 where there is none."""
    return objectives.join(means, "obj_key", "left").select("obj_idx", "obj_key", F.coalesce("mean_loss", F.lit(0.0)).alias("loss"))


def reward(old: Column, new: Column) -> Column:
    """Between -1 and 1; positive if the loss fell. Undefined becomes 0."""
    n = F.sqrt(new * old) * F.pow((new - old) / (old + 1e-8), F.lit(3.0)) * math.e
    raw = -100 * F.tanh(n) * math.e
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(raw, F.lit(0.0)), F.lit(0.0))))


def rewards(losses: DataFrame, partition: str = "obj_key", step: str = "step", loss: str = "loss", reward_of: Callable[[Column, Column], Column] = reward) -> DataFrame:
    """The reward of every step after the first, per objective; the first evaluation is what the second is held against. reward_of: from old
    and new loss, as columns."""
    old = F.lag(loss).over(Window.partitionBy(partition).orderBy(step))
    return losses.withColumn("old_loss", old).where("old_loss is not null").withColumn("reward", reward_of(F.col("old_loss"), F.col(loss)))


def cosine_decay(step: Column, total: int, low: float, high: float, warmup: int = 0, decay: float = 1.0, cook: int = 0, cook_value: float = 1.0) -> Column:
    """A schedule: a fixed value while cooking, then half a cosine from high to low, clipped to them; 0 if high is."""
    if high <= 0:
        return F.lit(0.0)
    span = total - 1 - warmup
    at = F.least(F.greatest(step - warmup, F.lit(0)), F.lit(span))
    half = (high - low) / 2
    value = low + half + half * F.pow(F.lit(decay), at / (2 * total - 2)) * F.cos(math.pi * at / span)
    return F.when(step < cook, cook_value).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def explores(step: Column, rate: Column, total: int, low: float, high: float, seed: int = 0, steps: int = EXPLORE_STEPS) -> Column:
    """Whether a step explores, at its rate. Draws repeat after `steps`; there is none at a highest rate of OFF or less, or past the decay at such a
    lowest one."""
    drawn = uniform(seed, F.pmod(step, F.lit(steps))) < rate
    return drawn & F.lit(high > OFF) & ~((step > total) & F.lit(low <= OFF))


def explore_table(spark: SparkSession, total: int, low: float, high: float, steps: int = EXPLORE_STEPS, seed: int = 0, **schedule) -> DataFrame:
    """step, rate, explore: whether a step explores."""
    rate = cosine_decay(F.col("id"), total, low, high, **schedule)
    return spark.range(steps).select(F.col("id").alias("step"), rate.alias("rate"), explores(F.col("id"), rate, total, low, high, seed, steps).alias("explore"))


def class_scaling(objectives: DataFrame, name: str = "name") -> DataFrame:
    """objectives(obj_idx, name) with a dense class per name, in order of first appearance, and the weight n_classes / class size.
    A mixture has a few dozen rows."""
    classes = objectives.groupBy(name).agg(F.min("obj_idx").alias("first"), F.count(F.lit(1)).alias("size"))
    dense = classes.select(name, "size", (F.row_number().over(Window.orderBy("first")) - 1).alias("class_id"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n_classes"))
    return objectives.join(dense, name).select("obj_idx", name, "class_id", (F.col("n_classes") / F.col("size")).alias("weight"))


def scaled(action: Column, loss: Column, *over: str) -> Column:
    """Actions times losses, moved up if any is negative, summing to 1 within `over`."""
    window = Window.partitionBy(*over)
    value = action * loss
    least = F.min(value).over(window)
    value = F.when(least < 0, value - least).otherwise(value)
    return value / F.sum(value).over(window)


def candidates(spark: SparkSession, losses: DataFrame, n: int = CANDIDATES, seed: int = 0, base: DataFrame | None = None) -> DataFrame:
    """cand, obj_idx, action: n uniform draws (or the base action n times) and n of each Pareto kind, scaled by the losses.
    losses(obj_idx, loss) has a row per objective, which every candidate needs: rows are candidates times objectives."""
    draws = spark.range((1 + len(PARETO)) * n).withColumnRenamed("id", "cand").crossJoin(F.broadcast(losses.select("obj_idx", "loss")))
    u = uniform(seed, F.col("cand"), F.col("obj_idx"))
    first = u
    if base is not None:
        draws = draws.join(F.broadcast(base.select("obj_idx", F.col("action").alias("base"))), "obj_idx")
        first = F.col("base")
    value = F.when(F.col("cand") < n, first)
    for i, (scale, alpha) in enumerate(PARETO, start=1):
        value = value.when(F.col("cand") < (i + 1) * n, pareto(u, scale, alpha))
    return draws.select("cand", "obj_idx", value.alias("raw"), "loss").select("cand", "obj_idx", scaled(F.col("raw"), F.col("loss"), "cand").alias("action"))


def explore_action(classes: DataFrame, seed: int, step: int) -> DataFrame:
    """One or two classes, drawn, share the mass by drawn weights; the others get a small share each."""
    u = uniform(seed, "count", step)
    distinct = classes.select("class_id").distinct()
    ranked = distinct.withColumn("r", F.row_number().over(Window.orderBy(uniform(seed, step, "pick", F.col("class_id")), "class_id")))
    both = classes.join(ranked, "class_id").withColumn("n_pick", F.when(u < 0.5, 1).otherwise(2))
    chosen = F.col("r") <= F.col("n_pick")
    weight = uniform(seed, step, "weight", F.col("obj_idx"))
    by_class = Window.partitionBy("class_id")
    k = F.count(F.lit(1)).over(Window.partitionBy())
    rest = k / F.greatest(F.lit(1), k - F.col("n_pick")) * 0.005 * F.col("n_pick")
    return both.select("obj_idx", F.when(chosen, weight / F.sum(weight).over(by_class)).otherwise(rest / F.count(F.lit(1)).over(by_class)).alias("action"))


def best_mean(predicted: DataFrame, actions: DataFrame, best: int = BEST) -> DataFrame:
    """The mean action of the `best` candidates by their summed rewards. predicted(cand, obj_idx, reward), actions(cand, obj_idx, action)."""
    top = predicted.groupBy("cand").agg(F.round(F.sum("reward"), 9).alias("total")).orderBy(F.desc("total"), "cand").limit(best)
    return actions.join(F.broadcast(top.select("cand")), "cand").groupBy("obj_idx").agg(F.avg("action").alias("action"))


class RidgePredictor:
    """Rewards per objective as a linear function of old loss and action, by ridge regression on the last HISTORY steps. One aggregation gives the
    moments of all objectives; the fitted model is a table with a row per objective."""

    def __init__(self, strength: float = 0.1):
        self.strength = strength
        self.model: DataFrame | None = None

    def fit(self, history: DataFrame) -> RidgePredictor:
        """history(step, obj_idx, old_loss, action, reward)"""
        last = history.agg(F.max("step").alias("last"))
        recent = history.crossJoin(F.broadcast(last)).where(F.col("step") > F.col("last") - HISTORY)
        x, a, y = "old_loss", "action", "reward"
        means = {f"m{c[0]}": F.avg(c) for c in (x, a, y)}
        moments = {"xx": (x, x), "aa": (a, a), "xa": (x, a), "xy": (x, y), "ay": (a, y)}
        sums = recent.groupBy("obj_idx").agg(*(e.alias(k) for k, e in means.items()), *(F.covar_pop(*c).alias(k) for k, c in moments.items()))
        p, q = F.col("xx") + self.strength, F.col("aa") + self.strength
        det = p * q - F.col("xa") * F.col("xa")
        by_loss, by_action = (q * F.col("xy") - F.col("xa") * F.col("ay")) / det, (p * F.col("ay") - F.col("xa") * F.col("xy")) / det
        self.model = sums.select("obj_idx", by_loss.alias("by_loss"), by_action.alias("by_action"), (F.col("mr") - by_loss * F.col("mo") - by_action * F.col("ma")).alias("level"))
        return self

    def predict(self, losses: DataFrame, actions: DataFrame) -> DataFrame:
        """cand, obj_idx, reward; an objective without history is predicted none."""
        if self.model is None:
            raise ValueError("fit comes first")
        told = losses.select("obj_idx", "loss").join(self.model, "obj_idx", "left")
        value = F.tanh(F.col("by_loss") * F.col("loss") + F.col("by_action") * F.col("action") + F.col("level"))
        return actions.join(F.broadcast(told), "obj_idx").select("cand", "obj_idx", F.coalesce(value, F.lit(0.0)).alias("reward"))


def next_mixture(losses: DataFrame, predictor: RidgePredictor, actions: DataFrame, classes: DataFrame) -> DataFrame:
    """obj_idx, prob (4 decimals), loss: the mixture that the best candidates call for."""
    predicted = predictor.predict(losses, actions).join(F.broadcast(classes.select("obj_idx", "weight")), "obj_idx").select("cand", "obj_idx", (F.col("reward") * F.col("weight")).alias("reward"))
    chosen = best_mean(predicted, actions).join(losses, "obj_idx")
    return chosen.select("obj_idx", F.round(scaled(F.col("action"), F.col("loss")), 4).alias("prob"), F.round("loss", 4).alias("loss"))


def due(step: Column, every: int, last: Column) -> Column:
    """Whether a step evaluates: a multiple of `every` that hasn't been rewarded yet (null: none has)."""
    return (step % every == 0) & ~step.eqNullSafe(last)


def remap(x: Column, in_min: Column, in_max: Column, out_min: float, out_max: float) -> Column:
    """x, from [in_min, in_max] to [out_min, out_max] in a line."""
    return F.lit(out_min) + (x - in_min) / (in_max - in_min + 1e-8) * (out_max - out_min)


def stretched(x: Column, low: float, high: float, *over: str) -> Column:
    """Numbers remapped from their own least and largest within `over` to [low, high]."""
    window = Window.partitionBy(*over)
    return remap(x, F.min(x).over(window), F.max(x).over(window), low, high)


def update_and_sample(spark: SparkSession, losses: DataFrame, actions: DataFrame, classes: DataFrame, step: int, rate: float, predictor: RidgePredictor | None = None, seed: int = 0, reward_of: Callable[[Column, Column], Column] = reward, n: int = CANDIDATES) -> DataFrame:
    """One turn of the loop: obj_idx, prob, explored. losses(step, obj_idx, loss) are the evaluations so far, actions(step, obj_idx, action) the
    mixtures that led to them, classes(obj_idx, class_id, weight). The first evaluation is only what the second is held against: it leaves the mixture as it is.
    From the second on, the predictor learns from all rewards and picks among candidates, of which the first n are uniform draws, or, in a turn that
    explores (at `rate`), the drawn explore action, so that this is tried against the others."""
    seen = losses.agg(F.count_distinct("step"), F.max("step")).first()
    if seen[0] < 2:
        last = actions.agg(F.max("step")).first()[0]
        return actions.where(F.col("step") == last).select("obj_idx", F.round("action", 4).alias("prob"), F.lit(False).alias("explored"))
    exploring = rate > OFF and draw(f"{seed}:explore:{step}") < rate
    history = rewards(losses, "obj_idx", reward_of=reward_of).join(actions, ["step", "obj_idx"]).select("step", "obj_idx", "old_loss", "action", "reward")
    now = losses.where(F.col("step") == seen[1]).select("obj_idx", "loss")
    base = explore_action(classes, seed, step) if exploring else None
    made = next_mixture(now, (predictor or RidgePredictor()).fit(history), candidates(spark, now, n, seed, base), classes)
    return made.select("obj_idx", "prob", F.lit(exploring).alias("explored"))


def losses_by_name(objectives: DataFrame, means: DataFrame, *names: str) -> DataFrame:
    """objectives with the mean loss under the first of their names that they have (nickname, hash, name; null: has none), 0 if there is none under it."""
    key = F.coalesce(*(F.col(c) for c in names))
    found = means.select(F.col("obj_key").alias("_key"), "mean_loss")
    return objectives.withColumn("_found", key).join(found, F.col("_found") == F.col("_key"), "left").withColumn("loss", F.coalesce("mean_loss", F.lit(0.0))).drop("_found", "_key", "mean_loss")


def status_json(objectives: DataFrame, *columns: str) -> DataFrame:
    """objectives with `status`, the given columns as one JSON object; nulls are left out."""
    return objectives.withColumn("status", F.to_json(F.struct(*columns)))


def _latest(objectives: DataFrame, history: DataFrame, value: str) -> DataFrame:
    """objectives with the latest step's values, `_n` (how many there are) and `_whole` (whether they are those of exactly these objectives). A mixture
    has a few dozen rows."""
    now = history.join(F.broadcast(history.agg(F.max("step").alias("step"))), "step").select("obj_idx", value)
    every = Window.partitionBy()
    told = objectives.join(now, "obj_idx", "left").crossJoin(F.broadcast(now.agg(F.count(F.lit(1)).alias("_n"))))
    size = F.count(F.lit(1)).over(every)
    return told.withColumn("_size", size).withColumn("_whole", (F.count(value).over(every) == size) & (F.col("_n") == size))


def current_action(objectives: DataFrame, actions: DataFrame) -> DataFrame:
    """objectives(obj_idx, ...) with `prob`, the latest of actions(step, obj_idx, action): equal shares if that doesn't fit the objectives, null if there is none."""
    told = _latest(objectives, actions, "action")
    prob = F.when(F.col("_whole"), F.col("action")).when(F.col("_n") > 0, 1 / F.col("_size"))
    return told.withColumn("prob", prob.cast("double")).drop("action", "_n", "_size", "_whole")


def current_losses(objectives: DataFrame, losses: DataFrame) -> DataFrame:
    """objectives(obj_idx, ...) with `loss`, the latest of losses(step, obj_idx, loss); null for all if those don't fit the objectives."""
    told = _latest(objectives, losses, "loss")
    return told.withColumn("loss", F.when(F.col("_whole"), F.col("loss")).cast("double")).drop("_n", "_size", "_whole")


def verbose_action(objectives: DataFrame, actions: DataFrame, losses: DataFrame, *names: str) -> DataFrame:
    """obj_idx, obj_key (the first of an objective's names that it has, else its number), prob, loss, and both `told` for people."""
    key = F.coalesce(*(F.col(c) for c in names), F.concat(F.lit("objective_"), F.col("obj_idx").cast("string")))
    state = current_losses(current_action(objectives, actions), losses)
    told = F.concat_ws(" ", F.concat(F.col("obj_key"), F.lit(":")), shown(F.col("prob")), F.concat(F.lit("loss "), shown(F.col("loss"))))
    return state.withColumn("obj_key", key).select("obj_idx", "obj_key", "prob", "loss", told.alias("told"))
