"""Objectives, their options, and ready mixtures."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

# Names of objectives with their options and defaults.
OPTIONS: dict[str, dict[str, object]] = {
    "next_token_prediction": {"paradigm": "<|NTP|>"},
    "copying": {"paradigm": "<|COPY|>", "paradigm_suffix": ""},
    "prefix_language_modeling": {"paradigm_str": "<|PREFIX LM|>", "prefix_fraction": 0.75},
    "deshuffling": {"paradigm": "<|DESHUFFLE|>", "paradigm_suffix": "", "percentage_to_shuffle": 0.75},
    "infilling": {"paradigm": "<|INFILL|>", "paradigm_end": "", "corruption_rate": 0.15, "mean_tokens_per_span": 3.0, "max_mask_spans": 20, "mask_prefix": " [[mask_", "mask_suffix": "]]", "max_attempts": 100},
    "autoencoding": {"paradigm_prompt": "<|AUTOENCODE|>", "paradigm_end": "", "corruption_rate": 0.5, "tokens_per_mask": 3, "mask_prefix": " [[mask_", "mask_suffix": "]]", "max_attempts": 100},
    "autoencoding_with_deshuffling": {"paradigm_prompt": "<|AUTOENCODE + DESHUFFLE|>", "paradigm_end": "", "corruption_rate": 0.5, "tokens_per_mask": 3, "mask_prefix": " [[mask_", "mask_suffix": "]]", "max_attempts": 100, "deshuffle": False},
    "selective_copying": {
        "paradigm_prompt": "<|Selective Copying|>", "paradigm_end": "", "corruption_rate": 0.5, "tokens_per_mask": 8, "shuffle": True, "format_style": "query_context",
        "min_delimiter_prefix_length": 8, "max_delimiter_prefix_length": 64, "min_delimiter_suffix_length": 8, "max_delimiter_suffix_length": 64, "min_context_content_length": 10, "max_attempts": 100,
    },
}
#: Options that every objective has.
COMMON = {"remaining_space": 1024, "minimum_remaining_space": 0, "minimum_sequence_length": -1, "maximum_sequence_length": -1, "rng_seed": 0}


#: Objectives of the user: options, and the function that makes an example (see `register`).
REGISTERED: dict[str, tuple[dict[str, object], Callable]] = {}


def register(name: str, make: Callable, **options: object) -> None:
    """Adds an objective. make(ids, options, prompt_ids, tokenizer, rng) gets a text's ids, and returns (input_ids, label_ids, ids used), or None
    if it can't use the text; the prompt is the option paradigm. It travels with the entries, so executors need not know it."""
    if name in OPTIONS:
        raise ValueError(f"{name} is an objective already")
    REGISTERED[name] = ({"paradigm": "", **options}, make)


def prompt_of(name: str, options: dict[str, object]) -> str:
    return str(next(options[k] for k in ("paradigm", "paradigm_str", "paradigm_prompt") if k in options))


@dataclass(frozen=True)
class Objective:
    """One entry of a mixture."""

    name: str
    prob: float = 1.0
    overrides: tuple[tuple[str, object], ...] = field(default=())
    #: Of an objective of the user: its function and default options.
    make: Callable | None = field(default=None, compare=False, repr=False)
    defaults: tuple[tuple[str, object], ...] = field(default=(), repr=False)

    def __post_init__(self) -> None:
        if self.name not in OPTIONS and self.make is None:
            raise ValueError(f"unknown objective {self.name!r}; there are {', '.join([*OPTIONS, *REGISTERED])}")
        rate = self.options["corruption_rate"] if "corruption_rate" in self.options else 0
        if not 0 <= float(rate) <= 1:
            raise ValueError("corruption_rate lies between 0 and 1")
        for k in ("mean_tokens_per_span", "tokens_per_mask"):
            if k in self.options and float(self.options[k]) <= 0:
                raise ValueError(f"{k} is over 0")

    @property
    def options(self) -> dict[str, object]:
        """Defaults with this entry's overrides; overrides that the objective doesn't have take no effect."""
        known = self._known
        return known | {k: v for k, v in self.overrides if k in known}

    @property
    def dropped(self) -> list[str]:
        return [k for k, _ in self.overrides if k not in self._known]

    @property
    def _known(self) -> dict[str, object]:
        return (dict(self.defaults) if self.make else OPTIONS[self.name]) | COMMON

    @property
    def prompt(self) -> str:
        return prompt_of(self.name, self.options)

    @property
    def hash_str(self) -> str:
        return hashlib.sha256(json.dumps({"name": self.name, "prob": self.prob, "overrides": self.overrides}, sort_keys=True, default=str).encode()).hexdigest()[:8]

    @property
    def nickname(self) -> str:
        return f"{self.name}_{self.hash_str}"


def objective(name: str, prob: float = 1.0, **overrides: object) -> Objective:
    """An entry; options are given flat or as config_overrides, which win."""
    nested = overrides.pop("config_overrides", {})
    defaults, make = REGISTERED.get(name, ({}, None))
    return Objective(name, prob, tuple(sorted({**overrides, **nested}.items())), make, tuple(defaults.items()))


def normalised(entries: list[Objective]) -> list[Objective]:
    """Probabilities that sum to 1; all alike if they sum to 0 or less."""
    total = sum(e.prob for e in entries)
    return [replace(e, prob=e.prob / total if total > 0 else 1 / len(entries)) for e in entries]


def _span(prob: float, rate: float, mean: float) -> Objective:
    return objective("infilling", prob, corruption_rate=rate, mean_tokens_per_span=mean)


def _copy(mean: int, style: str) -> Objective:
    return objective("selective_copying", 1.0, tokens_per_mask=mean, shuffle=True, format_style=style, min_delimiter_prefix_length=2, max_delimiter_prefix_length=16, min_delimiter_suffix_length=2, max_delimiter_suffix_length=16)


def uniform_mixture() -> list[Objective]:
    """Every objective alike."""
    return [objective(name) for name in OPTIONS]


def denoiser_mixture(scale: float = 1.0, x_prob: float = 0.25, last_rate: float = 0.5, first_x_rate: float = 0.5) -> list[Objective]:
    """Sequential, regular and extreme denoisers; `scale` multiplies span lengths, as for characters."""
    return [
        objective("prefix_language_modeling", 1.0, prefix_fraction=0.75),
        _span(0.5, 0.15, 3 * scale), _span(0.5, 0.15, 9 * scale),
        _span(x_prob, first_x_rate, 3 * scale), _span(x_prob, 0.15, 8 * scale), _span(x_prob, 0.15, 64 * scale), _span(x_prob, last_rate, 64 * scale),
    ]


def character_denoiser_mixture() -> list[Objective]:
    """The denoisers for characters; its last two entries are equal."""
    return denoiser_mixture(4.0, 0.5, 0.15)


def decoder_mixture() -> list[Objective]:
    return [objective("next_token_prediction", 0.6), objective("prefix_language_modeling", 0.2, prefix_fraction=0.75), _span(0.1, 0.15, 3.0), _span(0.1, 0.5, 32.0)]


def light_mixture() -> list[Objective]:
    """Fifteen entries over six objectives."""
    return [
        objective("prefix_language_modeling", prefix_fraction=0.75),
        _span(1.0, 0.15, 3.0), _span(0.5, 0.15, 9.0), _span(1.0, 0.5, 3.0), _span(1.0, 0.15, 8.0), _span(1.0, 0.15, 64.0), _span(1.0, 0.5, 64.0),
        objective("next_token_prediction"),
        _copy(16, "context_query"), _copy(16, "query_context"), _copy(8, "context_query"), _copy(8, "query_context"),
        objective("copying"),
        objective("deshuffling", percentage_to_shuffle=0.75), objective("deshuffling", percentage_to_shuffle=0.25),
    ]


def small_mixture() -> list[Objective]:
    return [_span(1.0, 0.15, 3.0), objective("next_token_prediction")]
