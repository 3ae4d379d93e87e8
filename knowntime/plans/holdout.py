"""A reserved season that is scored once: freeze a candidate, forecast without outcomes, claim, score.

Everything lies in the run's folder, whose path the caller fixes, so the claim holds for every job and cluster that shares it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knowntime.sources.tables import claim, exists, write_once

OUTCOMES = ("y", "home_score", "away_score", "is_tie")


class Consumed(RuntimeError):
    """The holdout has been claimed before."""


class Holdout:
    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run = spark, run.rstrip("/")

    def freeze(self, record: dict) -> None:
        """Write down what is to be scored; a run frozen before must have been frozen alike."""
        text = json.dumps(record, sort_keys=True)
        if not claim(self.spark, f"{self.run}/freeze.json", text):
            frozen = "".join(r.value for r in self.spark.read.text(f"{self.run}/freeze.json").collect())     # one small file
            if frozen != text:
                raise ValueError("differs from the frozen record")

    def dry_run(self, forecast: Callable[[], DataFrame]) -> DataFrame:
        """The forecasts without any outcome; claims nothing."""
        out = forecast()
        return out.drop(*[c for c in OUTCOMES if c in out.columns])

    def score(self, forecast: Callable[[], DataFrame], outcomes: Callable[[], DataFrame], key: str) -> DataFrame:
        """Claim the one use, then read the outcomes. A job that fails after its claim has used it up all the same."""
        if not exists(self.spark, f"{self.run}/freeze.json"):
            raise ValueError("freeze the run first")
        if not claim(self.spark, f"{self.run}/HOLDOUT_CONSUMED.json", json.dumps({"run": self.run})):
            raise Consumed(self.run)
        write_once(self.dry_run(forecast).join(outcomes(), key), f"{self.run}/holdout")
        return self.scored()

    def scored(self) -> DataFrame:
        """What the one scoring has written."""
        return self.spark.read.parquet(f"{self.run}/holdout")
