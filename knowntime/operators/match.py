"""Match provider events to scheduled contests by name tokens and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from knowntime.functions.times import micros
from knowntime.operators.asof import CHUNK_DAYS, asof_cumulative, asof_nearest


def match_unique(events: DataFrame, games: DataFrame, keys: Sequence[str], *, tolerance_us: int,
                 event_time: str = "commence_time", game_time: str = "scheduled_at",
                 game_id: str = "game_id", chunk_days: float | None = CHUNK_DAYS) -> DataFrame:
    """Give each event the one game within ``+- tolerance`` (inclusive), or a reason.

    The number of candidates is a difference of two running counts, and when it is one that
    game is the latest at or before the upper end: no candidate pairs are formed.
    """
    t = micros(event_time)
    e = events.withColumn("_hi", t + F.lit(tolerance_us)).withColumn("_lo", t - F.lit(tolerance_us))
    g = games.select(*keys, micros(game_time).alias("_gt"), F.col(game_id).alias("_gid"))
    one = F.lit(1)
    e = asof_cumulative(g, e, keys, fact_time="_gt", probe_time="_hi", sums={"_upto": one},
                        maxima={"_latest": F.struct("_gt", "_gid")}, strict=False, chunk_days=chunk_days)
    e = asof_cumulative(g, e, keys, fact_time="_gt", probe_time="_lo", sums={"_below": one},
                        strict=True, chunk_days=chunk_days)
    known = g.select(*keys).distinct().withColumn("_known", F.lit(True))
    e = e.join(known, list(keys), "left")
    near = F.col("_upto") - F.col("_below")
    reason = (F.when(F.col("_known").isNull(), "no schedule match")
              .when(near != 1, F.concat(near.cast("string"), F.lit(" schedule candidates"))))
    return e.select(*events.columns, F.when(near == 1, F.col("_latest._gid")).alias(game_id),
                    reason.alias("reason"))


def match_nearest(events: DataFrame, games: DataFrame, keys: Sequence[str], *, tolerance_us: int,
                  event_id: str = "event_id", sighting: str = "sighting",
                  event_time: str = "commence_time", game_time: str = "scheduled_at",
                  game_id: str = "game_id", chunk_days: float | None = CHUNK_DAYS) -> DataFrame:
    """Nearest game in time within the tolerance; an event seen twice keeps its first match."""
    near = asof_nearest(games, events, keys, fact_time=game_time, probe_time=event_time,
                        order=[game_id], value=game_id, tolerance_us=tolerance_us,
                        chunk_days=chunk_days)
    hit = near.where(F.col(game_id).isNotNull())
    first = hit.groupBy(event_id).agg(F.min_by(
        F.struct(game_id, "distance_us", event_time), F.col(sighting)).alias("_m"))
    return first.select(event_id, "_m.*")
