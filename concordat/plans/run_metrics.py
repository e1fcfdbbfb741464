"""What a run spends, stage by stage, while it runs (L4)."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from concordat.sources.tables import Tables

STAGES = ("ingest", "classify", "extract", "detect", "adjudicate", "compose", "examine", "verify")


@dataclass
class Spent:
    """A stage's figures.  One that had nothing to do stays at zero, marked skipped."""

    stage: str
    model: str = ""
    skipped: bool = True
    seconds: float = 0.0
    tokens_in: int = 0
    tokens_out: int = 0
    cache_hits: int = 0
    cache_misses: int = 0

    def observed(self, answers: DataFrame) -> tuple[DataFrame, Observation]:
        """Answers with their tokens counted as they are written; the figures come with the write."""
        seen = Observation()
        total = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(c)
        return answers.observe(seen, total("tokens_in"), total("tokens_out")), seen

    def add(self, seen: Observation) -> None:
        figures = seen.get
        self.tokens_in += figures["tokens_in"]
        self.tokens_out += figures["tokens_out"]


class RunMetrics:
    """Rows of ``stage_metrics`` for one run: all stages from the start, brought up to date as each ends."""

    def __init__(self, tables: Tables, corpus: str, run_id: str):
        self.tables, self.corpus, self.run_id = tables, corpus, run_id
        self.stages = {name: Spent(name) for name in STAGES}

    def store(self) -> None:
        schema = self.tables.schema("stage_metrics")
        rows = [{**asdict(s), "corpus": self.corpus, "run_id": self.run_id} for s in self.stages.values()]
        self.tables.write_run(self.tables.spark.createDataFrame(rows, schema).coalesce(1), "stage_metrics", self.corpus, self.run_id)

    @contextmanager
    def stage(self, name: str) -> Iterator[Spent]:
        """Time a stage; its row is stored whether it ends or breaks off."""
        spent, began = self.stages[name], time.monotonic()
        spent.skipped = False
        try:
            yield spent
        finally:
            spent.seconds += time.monotonic() - began
            self.store()
