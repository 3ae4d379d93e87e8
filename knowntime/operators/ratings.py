"""Order-dependent rating fold and the probabilities derived from it.

The fold is serial inside a rating pool by definition (every update depends on the two
ratings before it), so pools x scenarios are the parallel units. Within a pool the rows
stream through a task in sorted order: the task keeps one number per competitor and one
Arrow batch, never the pool's rows. Only the narrow update columns take this path; ratings
are attached to decisions by the chunked as-of join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from knowntime.operators.asof import CHUNK_DAYS, asof_last

INITIAL = 1500.0


def win_probability(diff: Column, advantage: Column | float, scale: float = 400.0) -> Column:
    """Logistic win chance of the home side for a rating difference."""
    lead = diff + (advantage if isinstance(advantage, Column) else F.lit(float(advantage)))
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), -lead / F.lit(scale)))


def rating_fold(results: DataFrame, pool: Sequence[str], *, k: float = 20.0, scale: float = 400.0,
                advantage: float = 65.0, time: str = "available_at", order: str = "contest_id",
                home: str = "home_id", away: str = "away_id", outcome: str = "outcome",
                neutral: str = "neutral", carry: Sequence[str] = ()) -> DataFrame:
    """Ratings after every result, revealed in ``(time, order)``.

    Adds ``home_rating`` and ``away_rating`` (after the update) to the update columns and those of ``carry``.
    """
    pool = list(pool)
    cols = [*pool, time, order, home, away, outcome, neutral, *carry]
    rows = (results.select(*pool, time, order, home, away, F.col(outcome).cast("double").alias(outcome),
                           F.col(neutral).cast("int").alias(neutral), *carry)
            .repartition(*pool).sortWithinPartitions(*pool, time, order))
    schema = rows.limit(0).withColumn("home_rating", F.lit(0.0)).withColumn(
        "away_rating", F.lit(0.0)).schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, r = None, {}                     # the pool being streamed, and its ratings
        for batch in batches:
            keys = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in pool]))
            numbers = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).tolist()
                       for c in (home, away, outcome, neutral)]
            home_after, away_after = [], []
            for key, h, w, result, away_ground in zip(keys, *numbers):
                if key != now:
                    now, r = key, {}
                a, b = r.get(h, INITIAL), r.get(w, INITIAL)
                expected = 1.0 / (1.0 + 10.0 ** (-(a - b + advantage * (1 - away_ground)) / scale))
                move = k * (result - expected)
                r[h], r[w] = a, b = a + move, b - move
                home_after.append(a)
                away_after.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home_after, pa.float64()), pa.array(away_after, pa.float64())],
                                             names=[*batch.schema.names, "home_rating", "away_rating"])

    return rows.mapInArrow(stream, schema).select(*cols, "home_rating", "away_rating")


def rating_probes(rated: DataFrame, probes: DataFrame, pool: Sequence[str], *,
                  chunk_days: float | None = CHUNK_DAYS) -> DataFrame:
    """Attach each side's rating just before its decision (``probes`` has team and side)."""
    both = rated.withColumn("_s", F.explode(F.array(
        F.struct(F.col("home_id").alias("team"), F.col("home_rating").alias("rating")),
        F.struct(F.col("away_id").alias("team"), F.col("away_rating").alias("rating")))))
    facts = both.select(*pool, "available_at", "contest_id", "_s.*")
    out = asof_last(facts, probes, [*pool, "team"], fact_time="available_at",
                    probe_time="decision_at", order=["contest_id"], values=["rating"],
                    chunk_days=chunk_days)
    return out.fillna({"rating": INITIAL})


def with_outcome(contests: DataFrame) -> DataFrame:
    """Result as seen by the fold: 1, 0, or one half for a tie."""
    margin = F.col("home_score") - F.col("away_score")
    return contests.withColumn(
        "outcome", F.when(margin > 0, 1.0).when(margin < 0, 0.0).otherwise(0.5))
