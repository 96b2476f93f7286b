"""Examples made text by text, over any tokenizer: the objectives that walk a text and cut spans out of it (infilling, autoencoding,
selective copying), shuffling with drawn numbers, those of the user, and the plain ones where tokens are not characters.

Each example is a function of its text, options and random numbers. `exact` takes seeded NumPy generators, `hashed` takes
numbers from hashes of (seed, key, attempt, step), which SQL can draw as well. Spark deals the rows; a walk holds one text.
"""

from __future__ import annotations

import gc
import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textloom.functions.hashrand import draw, poisson_table
from textloom.functions.tokens import Characters
from textloom.operators.config import Objective

EXAMPLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("objective", "status")]
    + [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("input_ids", "label_ids")]
    + [T.StructField("unused_text", T.StringType()), T.StructField("masked_count", T.IntegerType()), T.StructField("original_length", T.IntegerType()), T.StructField("spans", T.IntegerType()), T.StructField("attempts", T.IntegerType())]
)
#: Room that the budgets of both walks leave free.
SLACK = 16
CHARACTERS = Characters()


@lru_cache(maxsize=64)
def skip_tables(mean: float, shortest: float, longest: float, low: float, high: float) -> tuple[list[float], list[list[float]]]:
    """What a walk that skips draws from. A token starts a hole with chance rate / span, for a uniform rate and a clipped Poisson span that ends with
    the text; so, by the number of tokens left: the hazards of a hole, summed up to there, and the cumulative chances of spans given a hole. From the longest span on both
    stay as they are: sums grow by the last difference."""
    chances: dict[int, float] = {}
    reached = [0.0, *poisson_table(mean), 1.0]
    for k, (before, upto) in enumerate(zip(reached, reached[1:], strict=False)):
        span = int(max(1, shortest, min(k, longest)))
        chances[span] = chances.get(span, 0.0) + upto - before
    hazard, spans = [0.0], []
    for left in range(1, max(chances) + 1):
        weights = [0.0] * left
        for span, p in chances.items():
            weights[min(span, left) - 1] += p / min(span, left)
        total = sum(weights)
        hazard.append(hazard[-1] - math.log1p(-(low + high) / 2 * total))
        spans.append([w / total for w in accumulate(weights)][:-1])
    return hazard, spans


def _next_hole(left: int, u: float, hazard: list[float]) -> int:
    """How many tokens are left where the next hole starts (0: there is none), from how many are left now."""
    most = len(hazard) - 1
    growth = hazard[most] - hazard[most - 1]
    at = (hazard[most] + (left - most) * growth if left > most else hazard[left]) + math.log(1 - u)
    return min(left, most + math.ceil((at - hazard[most]) / growth) if at > hazard[most] else bisect_left(hazard, at))


def _plain(units: list[int], entry: Objective, prompt: list[int], tok) -> dict:
    """Next token prediction, copying and prefix language modelling. What is used ends between characters."""
    room, p = int(entry.options["remaining_space"]), len(prompt)
    if entry.name == "prefix_language_modeling":
        m = tok.whole(units, min(len(units), max(0, room - p)))
        if m < 2:
            return _nothing()
        k = max(1, min(int(m * float(entry.options["prefix_fraction"])), m - 1))
        return _made(prompt + units[:k], units[k:m], m, original_length=m, attempts=1)
    used = units[: tok.whole(units, min(len(units), max(0, (room - p) // 2)))]
    return _made(prompt + used, used, len(used), original_length=len(used), attempts=1)


def _made(inputs: list[int], labels: list[int], used: int, **figures) -> dict:
    """An example that uses so many of the units that it was given."""
    return {"status": "ok", "input_ids": inputs, "label_ids": labels, "used": used, "masked_count": None, "original_length": None, "spans": None, "attempts": None} | figures


def _nothing(attempts: int = 0) -> dict:
    return {"status": "fail", "input_ids": [], "label_ids": [], "used": 0, "masked_count": 0, "original_length": 0, "spans": 0, "attempts": attempts}


class Walk:
    """Infilling, and with keep_prefix autoencoding (whose label is the text itself up to the furthest consumed token): budgets, what has been made
    so far, and its steps. A token that is kept costs a place in the input, and one in the label if that is the text."""

    def __init__(self, units: list[int], options: dict, prompt: list[int], keep_prefix: bool, tok):
        self.units, self.options, self.prompt, self.keep_prefix, self.tok = units, options, prompt, keep_prefix, tok
        rate = float(options["corruption_rate"])
        self.mean = float(options["tokens_per_mask"] if keep_prefix else options["mean_tokens_per_span"])
        self.low, self.high = max(0.0, rate * 0.5), min(0.95, 2 * rate)
        self.shortest, self.longest = (max(1, int(self.mean) // 3), max(1, 3 * int(self.mean))) if keep_prefix else (max(1.0, self.mean / 3), max(1.0, 3 * self.mean))
        self.end = tok.encode(str(options["paradigm_end"]))
        self.room = int(options["remaining_space"]) - len(self.end)
        self.limit = min(len(units), int(options["remaining_space"]) - len(prompt) - SLACK)
        self.most = 1 << 31 if keep_prefix else int(options["max_mask_spans"])
        self.cost = 2 if keep_prefix else 1
        self.holes: list[list[int]] = []

    def begin(self) -> None:
        self.inp, self.lab, self.n_lab, self.at, self.spans, self.masked = [*self.prompt], [], 0, 0, 0, 0

    def free(self) -> int:
        return self.room - len(self.inp) - self.n_lab

    def going(self) -> bool:
        return self.at < self.limit and self.spans < self.most and self.free() > 0

    def keep(self, n: int) -> bool:
        """Keeps so many tokens, or as many as there is room for; whether there was room for all."""
        fit = min(n, self.free() // self.cost)
        self.inp += self.units[self.at : self.at + fit]
        self.n_lab, self.at = self.n_lab + (self.cost - 1) * fit, self.at + fit
        return fit == n

    def mask(self, span: int) -> bool:
        """Makes a hole if there is room for it."""
        if self.spans == len(self.holes):
            self.holes.append(self.tok.encode(f"{self.options['mask_prefix']}{self.spans}{self.options['mask_suffix']}"))
        hole = self.holes[self.spans]
        added = span if self.keep_prefix else len(hole) + span
        if self.limit - self.at < span or len(hole) + added > self.free():
            return False
        self.inp += hole
        if not self.keep_prefix:
            self.lab += hole + self.units[self.at : self.at + span]
        self.n_lab, self.at, self.spans, self.masked = self.n_lab + added, self.at + span, self.spans + 1, self.masked + span
        return True

    def made(self, attempts: int) -> dict:
        label = self.units[: self.at] if self.keep_prefix else self.lab
        if len(self.inp) + len(label) <= self.room:
            label = label + self.end
        return _made(self.inp, label, self.at, masked_count=self.masked, original_length=self.at, spans=self.spans, attempts=attempts)

    def exact(self, seed: int):
        """Three numbers of a seeded generator for each token, one stream for all attempts."""
        rng = np.random.default_rng(seed)

        def walk(attempt: int) -> None:
            while self.going():
                chance, drawn, u = rng.uniform(self.low, self.high), int(rng.poisson(self.mean)), rng.uniform(0.0, 1.0)
                span = int(max(1, min(max(self.shortest, min(drawn, self.longest)), self.limit - self.at)))
                if not (u < chance / span and self.mask(span)) and not self.keep(1):
                    break

        return walk

    def hashed(self, key: str):
        """Two numbers for each hole, from hashes of key, attempt and step: the way to it and its span. Examples are distributed as those of `exact`."""
        hazard, spans = skip_tables(self.mean, self.shortest, self.longest, self.low, self.high)

        def walk(attempt: int) -> None:
            step = 0
            while self.going():
                digest = hashlib.md5(f"{key}:{attempt}:{step}".encode()).hexdigest()
                step += 1
                left = _next_hole(self.limit - self.at, int(digest[:8], 16) / 4294967296.0, hazard)
                if not self.keep(self.limit - left - self.at) or not left:
                    break
                span = 1 + bisect_right(spans[min(left, len(spans)) - 1], int(digest[8:16], 16) / 4294967296.0)
                if not self.mask(span) and not self.keep(1):
                    break

        return walk

    def run(self, walk) -> dict:
        """The first attempt that makes a hole."""
        if self.limit <= 0:
            return _nothing()
        tries = int(self.options["max_attempts"])
        for attempt in range(tries):
            self.begin()
            walk(attempt)
            if self.spans:
                return self.made(attempt + 1)
        return _nothing(tries)


def _shuffled(units: list[int], options: dict, prompt: list[int], rng: np.random.Generator, tok) -> dict:
    room = int(options["remaining_space"])
    used = units[: tok.whole(units, max(0, int((room // 2) * 0.90 - len(prompt))))]
    mixed = np.array(used, dtype=np.int64)
    chosen = rng.choice(len(mixed), int(len(mixed) * float(options["percentage_to_shuffle"])), replace=False) if len(mixed) else []
    mixed[chosen] = rng.permutation(mixed[chosen])
    if len(prompt) + 2 * len(used) > room:
        return _made([], [], len(used), original_length=len(used), attempts=1) | {"status": "error"}
    return _made(prompt + mixed.tolist(), used, len(used), original_length=len(used), attempts=1)


# The texts around queries, answers and the context of selective copying.
QUERY, BETWEEN, QUERY_END = "\n\n[find {}]\n", "\n[sep]\n", "\n[/find {}]"
FIRST_ANSWER, ANSWER = "[res 0]\n", "\n\n[res {}]\n"
CONTEXT, CONTEXT_END, DONE = "\n\n[ctx]\n", "\n[/ctx]", "\n\n[done]"
OVERHEAD_SLACK = 38


def _copied(units: list[int], options: dict, prompt: list[int], rng: np.random.Generator, tok) -> dict:
    """Questions by the text around a passage, answered by the passage. `spans` counts the questions."""
    room, mean = int(options["remaining_space"]), int(options["tokens_per_mask"])
    least, most = max(1, mean // 3), max(1, 3 * mean)
    rate = float(options["corruption_rate"])
    low, high = rate * 0.5, min(0.95, 2 * rate)
    pre, pre_most, suf, suf_most = (int(options[f"{a}_delimiter_{b}_length"]) for b in ("prefix", "suffix") for a in ("min", "max"))
    context, context_end, done, end = (tok.encode(t) for t in (CONTEXT, CONTEXT_END, DONE, str(options["paradigm_end"])))
    around: list[tuple[list[int], ...]] = []  # of the k-th question: before it, between its ends, behind it, before the answer
    fixed = len(prompt) + len(context) + len(context_end) + len(done) + OVERHEAD_SLACK
    reach = min(len(units), room - fixed)
    if reach < pre + least + suf:
        return _nothing()
    floor = int(options["min_context_content_length"])
    for attempt in range(int(options["max_attempts"])):
        at, cost, found = pre, 0, []
        while at <= reach - suf - least:
            span = max(least, min(int(np.clip(rng.poisson(mean), least, most)), reach - suf - at))
            chance = rng.uniform(low, high)
            if rng.uniform() >= chance:
                at += int(rng.integers(1, least + 1))
                continue
            before = int(rng.integers(pre, max(pre, min(at, pre_most)) + 1))
            left = reach - at - span
            if left < suf:
                at += 1
                continue
            behind = int(rng.integers(suf, max(suf, min(left, suf_most)) + 1))
            k = len(found)
            if k == len(around):
                around.append(tuple(tok.encode(t) for t in (QUERY.format(k), BETWEEN, QUERY_END.format(k), ANSWER.format(k))))
            extra = sum(map(len, around[k])) + before + behind + span
            if fixed + floor + cost + extra > room:
                break
            cost += extra
            found.append((units[at - before : at], units[at : at + span], units[at + span : at + span + behind]))
            at += span + behind + int(rng.integers(1, max(1, pre // 2) + 1))
        if not found:
            continue
        order = rng.permutation(len(found)) if options["shuffle"] else range(len(found))
        first = tok.encode(FIRST_ANSWER)
        queries = [t for i, j in enumerate(order) for part in (around[i][0], found[j][0], around[i][1], found[j][2], around[i][2]) for t in part]
        answers = [t for i, j in enumerate(order) for part in (around[i][3] if i else first, found[j][1]) for t in part] + done + end
        shown = min(reach, room - len(prompt) - len(queries) - len(answers) - len(context) - len(context_end))
        if shown < floor:
            continue
        body = context + units[:shown] + context_end
        body = queries + body if options["format_style"] == "query_context" else body + queries
        return _made(prompt + body, answers, shown, masked_count=sum(len(f[1]) for f in found), original_length=shown, spans=len(found), attempts=attempt + 1)
    return _nothing(int(options["max_attempts"]))


def example_at(units: list[int], at: int, entry: Objective, key: str, exact: bool = False, tok=CHARACTERS) -> dict:
    """The example of a text's units from a place on, and how many of them are `used`. Objectives other than the user's look at no more units than
    they have room for, so a long text costs no more than a short one. key: what hashed draws, or the seed of exact ones, follow from."""
    options = entry.options
    seed, room = int(options["rng_seed"]), int(options["remaining_space"])
    mixed = seed if exact else int(draw(f"{seed}:{key}") * (1 << 32))
    prompt = tok.encode(entry.prompt)
    if entry.make:
        rest = units[at:]
        made = entry.make(rest, options, prompt, tok, np.random.default_rng(mixed))
        if made is None or len(made[0]) + len(made[1]) > room:
            got = _nothing()
        else:
            got = _made(list(made[0]), list(made[1]), min(len(rest), made[2]), original_length=made[2], attempts=1)
        return {"objective": entry.name} | got
    some = units[at : at + max(0, room) + 1]  # one more, to tell whether a cut lies within a character
    if entry.name in ("infilling", "autoencoding", "autoencoding_with_deshuffling"):
        walk = Walk(some, options, prompt, entry.name != "infilling", tok)
        got = walk.run(walk.exact(seed) if exact else walk.hashed(f"{seed}:{key}"))
    elif entry.name == "deshuffling":
        got = _shuffled(some, options, prompt, np.random.default_rng(mixed), tok)
    elif entry.name == "selective_copying":
        got = _copied(some, options, prompt, np.random.default_rng(mixed), tok)
    else:
        got = _plain(some, entry, prompt, tok)
    return {"objective": entry.name} | got


def one_example(text: str, entry: Objective, key: str, exact: bool = False, tok=CHARACTERS) -> dict:
    """The example of one text by any objective, with the text that it leaves."""
    if isinstance(tok, Characters) and not entry.make:  # a unit is a character
        got = example_at(tok.encode(text[: max(0, int(entry.options["remaining_space"])) + 1]), 0, entry, key, exact, tok)
        return got | {"unused_text": text[got.pop("used") :]}
    units = tok.encode(text)
    got = example_at(units, 0, entry, key, exact, tok)
    return got | {"unused_text": tok.decode(units[got.pop("used") :])}


def build(df: DataFrame, entry: Objective, key: str, text: str = "text", exact: bool = False, tok=CHARACTERS) -> DataFrame:
    """The columns of df other than the text, and those of EXAMPLE; null texts count as empty. Errors of a walk fail the task."""
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, *EXAMPLE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [one_example(t or "", entry, str(k), exact, tok) for t, k in zip(part.column(text).to_pylist(), part.column(key).to_pylist(), strict=True)]
                kinds = {"input_ids": pa.list_(pa.int32()), "label_ids": pa.list_(pa.int32()), "masked_count": pa.int32(), "original_length": pa.int32(), "spans": pa.int32(), "attempts": pa.int32()}
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), *(pa.array([r[n] for r in rows], type=kinds.get(n, pa.string())) for n in EXAMPLE.names)], names=schema.names)

    return df.mapInArrow(run, schema)
