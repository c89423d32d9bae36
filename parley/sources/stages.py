"""Counts, times and failures of a run's stages, taken while they run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "place int, stage string, rows bigint, ms bigint, failure string, counts map<string,bigint>"


@dataclass
class Stages:
    """A log of stages. Counts come out of the stage's own action by ``DataFrame.observe``: no job runs for them alone."""

    spark: SparkSession
    records: list[tuple] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def run(self, stage: str, rows: DataFrame, action: Callable[[DataFrame], object], counts: dict[str, Column] | None = None, needed: bool = True) -> object:
        """Run ``action`` on ``rows``, an action such as a write, and keep its rows, milliseconds and further ``counts``
        (aggregates by name). A failure is kept, then raised if the stage is ``needed``, else a warning is left; what the
        action returns is given back."""
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.cast("long").alias(n) for n, c in (counts or {}).items()])
        start = time.monotonic()
        try:
            out = action(watched)
        except Exception as e:
            self._keep(stage, None, start, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", {})
            if needed:
                raise
            self.warnings.append(f"{stage} failed and was left out")
            return None
        found = dict(seen.get)
        self._keep(stage, found.pop("rows"), start, None, found)
        return out

    def _keep(self, stage: str, rows: int | None, start: float, failure: str | None, counts: dict[str, int]) -> None:
        self.records.append((len(self.records), stage, rows, round((time.monotonic() - start) * 1000), failure, counts))

    def table(self) -> DataFrame:
        """A row for each stage in order: (place, stage, rows, ms, failure, counts)."""
        return self.spark.createDataFrame(self.records, RECORD)

    def report(self) -> dict[str, object]:
        """Times by stage, failures and warnings, for a quality report."""
        return {"timings_ms": {r[1]: r[3] for r in self.records}, "rows": {r[1]: r[2] for r in self.records}, "failures": [{"stage": r[1], "error": r[4]} for r in self.records if r[4]], "warnings": list(self.warnings)}


def run_report(quality: DataFrame, stages: Stages) -> DataFrame:
    """The rows of ``sinks.quality_report`` with what the run says of itself: timings_ms, failures and warnings.

    The log is a few values of the driver, so they stand in every row as literals.
    """
    said = stages.report()
    times = F.create_map(*[x for k, v in said["timings_ms"].items() for x in (F.lit(k), F.lit(v).cast("long"))]).cast("map<string,bigint>")
    texts = lambda found: F.array(*map(F.lit, found)).cast("array<string>")
    return quality.withColumns({"timings_ms": times, "failures": texts([f"{f['stage']}: {f['error']}" for f in said["failures"]]), "warnings": texts(said["warnings"])})
