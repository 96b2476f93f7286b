"""Walks that skip to the next hole make what walks over every token make, in distribution."""

import math

import numpy as np
import pytest

from textloom.functions.hashrand import poisson_table
from textloom.operators import config, spans


def test_hazards_equal_sums_over_every_length():
    mean, low, high = 3.0, 0.075, 0.3
    hazard, chances = spans.skip_tables(mean, 1.0, 9.0, low, high)
    table = poisson_table(mean)
    for left in range(1, 10):
        p = {}
        for k, (a, b) in enumerate(zip([0.0, *table], table, strict=False)):
            span = int(max(1, min(max(1.0, min(k, 9.0)), left)))
            p[span] = p.get(span, 0.0) + b - a
        start = (low + high) / 2 * sum(q / s for s, q in p.items())
        assert math.isclose(hazard[left] - hazard[left - 1], -math.log(1 - start), rel_tol=1e-9)
        given = [sum(q / s for s, q in p.items() if s <= upto) / sum(q / s for s, q in p.items()) for upto in range(1, left)]
        assert np.allclose(chances[left - 1], given)


def test_the_next_hole_of_certain_draws():
    hazard, _ = spans.skip_tables(3.0, 1.0, 9.0, 0.075, 0.3)
    assert spans._next_hole(500, 0.0, hazard) == 500  # at once
    assert spans._next_hole(500, 1 - 2**-32, hazard) in range(0, 420)
    assert spans._next_hole(3, 1 - 2**-32, hazard) == 0  # none in what is left
    assert spans._next_hole(20, 0.5, spans.skip_tables(3.0, 1.0, 9.0, 0.0, 0.0)[0]) == 0  # a rate of nothing
    far = 1 - math.exp(-(hazard[9] - hazard[8]) * 7.5)  # the eighth token starts it
    assert spans._next_hole(400, far, hazard) == 393


@pytest.mark.parametrize(
    ("name", "n", "options"),
    [("infilling", 25, {}), ("infilling", 300, {}), ("infilling", 600, {"remaining_space": 260}), ("autoencoding", 25, {}), ("autoencoding", 300, {"remaining_space": 401}), ("infilling", 60, {"corruption_rate": 0.85, "mean_tokens_per_span": 4.0})],
)
def test_skips_are_distributed_as_single_steps(name, n, options):
    text = "abcdefghij" * 60
    figures = {exact: np.array([[got[c] for c in ("spans", "masked_count", "original_length", "attempts")] + [len(got["input_ids"]), len(got["label_ids"])] for got in (spans.one_example(text[:n], config.objective(name, rng_seed=k, **options), str(k), exact) for k in range(3000))], dtype=float) for exact in (False, True)}
    for power in (1, 2):
        a, b = figures[False] ** power, figures[True] ** power
        error = np.sqrt((a.var(axis=0) + b.var(axis=0)) / len(a)) + 1e-9
        assert (np.abs(a.mean(axis=0) - b.mean(axis=0)) < 4.5 * error).all(), (power, a.mean(axis=0), b.mean(axis=0))


def test_no_room_and_full_rows():
    for name in ("infilling", "autoencoding"):
        for room in range(20, 120):
            got = spans.one_example("abcdefghij" * 30, config.objective(name, remaining_space=room, corruption_rate=0.6), "k")
            assert len(got["input_ids"]) + len(got["label_ids"]) <= room and got["status"] in ("ok", "fail")
    assert spans.one_example("abc" * 50, config.objective("infilling", corruption_rate=0.0, max_attempts=3), "k")["attempts"] == 3
