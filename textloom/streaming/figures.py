"""Figures of a run, taken while its packed rows are written: totals, fill, and rates by the second. Nothing is scanned again.

A batch run is observed by `observed` and read by `of`; a stream's micro-batches report to `RunFigures`. Metrics count what reached the observed place of the plan, so
observe rows right before they are written: there a task that is tried again counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass(frozen=True)
class Figures:
    """Totals of packed rows of `length` slots, `batch_size` of them a batch, and the seconds that they took. Rates are 0 where no time has passed."""

    n_rows: int
    total_samples: int
    active_slots: int
    unknown: int
    length: int
    batch_size: int
    seconds: float = 0.0

    @property
    def total_slots(self) -> int:
        return self.n_rows * self.length

    @property
    def batches(self) -> int:
        """Batches, a short last one included."""
        return -(-self.n_rows // self.batch_size)

    @property
    def fill_rate(self) -> float:
        return round(self.active_slots / self.total_slots, 6) if self.total_slots else 0.0

    def rates(self) -> dict[str, float]:
        """Batches, samples, active tokens and token slots a second."""
        per = lambda n: n / self.seconds if self.seconds > 0 else 0.0
        return {"batches_per_s": per(self.batches), "samples_per_s": per(self.total_samples), "active_tokens_per_s": per(self.active_slots), "token_slots_per_s": per(self.total_slots)}


def observed(rows: DataFrame, name: str | Observation, known: str | None = None) -> DataFrame:
    """rows(used, n_segments) as they are, with their totals observed under a name. known: a column that is null in rows of unknown origin."""
    unknown = F.count_if(F.col(known).isNull()) if known else F.count_if(F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias
    return rows.observe(name, F.count(F.lit(1)).alias("n_rows"), total("n_segments")("total_samples"), total("used")("active_slots"), unknown.alias("unknown"))


def of(observation: Observation, length: int, batch_size: int, seconds: float = 0.0) -> Figures:
    """The figures of a run that has ended; before that, this waits for it."""
    got = observation.get
    return Figures(*(int(got.get(k) or 0) for k in ("n_rows", "total_samples", "active_slots", "unknown")), length, batch_size, seconds)


class RunFigures(StreamingQueryListener):
    """Adds up what a stream's micro-batches observed under a name. A micro-batch that is repeated after a restart counts once."""

    def __init__(self, name: str, length: int, batch_size: int):
        self.name, self.length, self.batch_size = name, length, batch_size
        self.seen: dict[tuple[str, int], tuple[int, int, int, int, float]] = {}
        self.failure: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        got = p.observedMetrics.get(self.name)
        if got is not None:
            self.seen[str(p.id), p.batchId] = (*(int(got[k] or 0) for k in ("n_rows", "total_samples", "active_slots", "unknown")), p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failure = event.exception

    def figures(self) -> Figures:
        sums = [sum(c) for c in zip(*self.seen.values(), strict=True)] or [0, 0, 0, 0, 0.0]
        return Figures(*sums[:4], self.length, self.batch_size, sums[4])
