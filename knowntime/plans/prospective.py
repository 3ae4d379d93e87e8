"""Paired prospective forecasts: one immutable record per game, made in the minutes before its cutoff and never after."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from knowntime.operators.splits import prewindow
from knowntime.plans.logit import materialize
from knowntime.sources.tables import exists, insert_only

#: Minutes of the window before a cutoff, and between a cutoff and the start.
WINDOW_MINUTES, LEAD_MINUTES = 5, 60


class Refused(ValueError):
    """The poll must not record anything."""


def _moment(at: dt.datetime):
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def due_games(schedule: DataFrame, issued_at: dt.datetime) -> DataFrame:
    """Games whose cutoff lies within the window after ``issued_at``; a schedule that cannot be trusted is refused.

    ``schedule``: game_id, home_id, away_id, scheduled_at, decision_at, schedule_observed_at. One aggregate row reaches the driver.
    """
    due = schedule.where(prewindow(_moment(issued_at), WINDOW_MINUTES))
    lead = F.col("scheduled_at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(LEAD_MINUTES))
    unassigned = F.col("home_id").isNull() | F.col("away_id").isNull() | (F.col("home_id") == F.col("away_id"))
    bad = due.agg(F.count("*").alias("n"), F.countDistinct("game_id").alias("ids"), F.count_if(unassigned).alias("unassigned or identical teams"),
                  F.count_if(F.col("decision_at") != lead).alias("cutoffs at another time before the start"),
                  F.count_if(F.col("schedule_observed_at") > _moment(issued_at)).alias("games observed after the issue")).first().asDict()
    if bad.pop("n") != bad.pop("ids"):
        raise Refused("a game is listed twice")
    for what, count in bad.items():
        if count:
            raise Refused(f"{what}: {count}")
    return due


def poll(schedule: DataFrame, forecast: Callable[[DataFrame], DataFrame], path: str, *, issued_at: dt.datetime, clock: Callable[[], dt.datetime],
         provenance: Mapping[str, str], frozen: Mapping[str, str], record: bool = False) -> int:
    """Forecast the games due now and record those not recorded before; returns how many games were forecast.

    ``forecast`` takes the due games, with ``decision_at`` moved to ``issued_at`` (inputs are what is known now, not at the cutoff
    to come), and returns game_id, predictions and features (maps) and selected_reports (array). Fingerprints that differ
    from the ``frozen`` ones are refused. So are all games if the calculation ends after a cutoff: nothing is backdated. Simulations
    and records go to tables of their own under ``path``.
    """
    drifted = sorted(k for k in {**frozen, **provenance} if frozen.get(k) != provenance.get(k))
    if drifted:
        raise Refused(f"changed since freezing: {', '.join(drifted)}")
    spark, mode = schedule.sparkSession, "prospective" if record else "simulation"
    table = f"{path}/{'recorded' if record else 'simulated'}"
    due = due_games(schedule, issued_at)
    if exists(spark, table):
        due = due.join(spark.read.parquet(table).select("game_id"), "game_id", "left_anti")
    due = materialize(due, "due-games")
    last = due.agg(F.min("decision_at")).first()[0]
    if last is None:
        return 0
    made = materialize(forecast(due.withColumn("cutoff", F.col("decision_at")).withColumn("decision_at", _moment(issued_at))), "due-forecasts")
    completed = clock() if record else issued_at
    if last < completed:
        raise Refused("the calculation crossed a cutoff")
    facts = F.create_map(*[F.lit(x) for kv in sorted(provenance.items()) for x in kv])
    rows = due.select("game_id", "scheduled_at", F.col("decision_at").alias("cutoff")).join(made, "game_id").select(
        "game_id", F.lit(mode).alias("mode"), _moment(completed).alias("issued_at"), _moment(issued_at).alias("inputs_observed_at"), "scheduled_at", "cutoff",
        "predictions", "features", "selected_reports", facts.alias("provenance"))
    insert_only(spark, rows, table, ["game_id"])
    return made.count()
