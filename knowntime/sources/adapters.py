"""Provider rows to the canonical schedule and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from knowntime.functions.times import local_to_utc, shift, utc_to_local

NEW_YORK = "America/New_York"


def stamped(frame: DataFrame, start: str = "scheduled_at", *, observed_hours: int = 48,
            lead_minutes: int = 60) -> DataFrame:
    """Add the reconstructed observation time and the decision cutoff."""
    return (frame.withColumn("observed_at", shift(start, hours=-observed_hours))
            .withColumn("decision_at", shift(start, minutes=-lead_minutes)))


def canonical_schedule(raw: DataFrame) -> DataFrame:
    """Regular-season games that are neither postponed nor exhibitions, one per id."""
    status = F.lower("status")
    keep = (F.startswith("game_id", F.lit("002")) & F.coalesce("postponed_status", F.lit("")).isin("", "N", "None")
            & ~status.contains("preseason") & ~status.contains("all-star"))
    rows = raw.where(keep)
    first = rows.groupBy("game_id").agg(F.min_by(F.struct(*[c for c in raw.columns if c != "game_id"]),
                                                 F.col("row_no")).alias("_r"))
    return stamped(first.select("game_id", "_r.*"))


def wall_clock_to_utc(wall: str | Column, zone: str = NEW_YORK) -> Column:
    """Local kickoff to UTC. A repeated hour is read as daylight time; a skipped wall clock
    moves to the first one that exists (gaps start on the hour)."""
    c = F.col(wall) if isinstance(wall, str) else wall
    utc = local_to_utc(c, zone)
    exists = utc_to_local(utc, zone) == c
    return F.when(exists, utc).otherwise(local_to_utc(F.date_trunc("hour", c).cast("timestamp_ntz"), zone))


def tie_track_schedule(raw: DataFrame) -> DataFrame:
    """Regular-season rows with a usable local kickoff, with UTC times."""
    day = F.concat_ws(" ", "gameday", "gametime")
    wall = F.try_to_timestamp(day, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    rows = raw.where("game_type = 'REG'").withColumn("_wall", wall).where("_wall IS NOT NULL")
    return stamped(rows.withColumn("scheduled_at", wall_clock_to_utc("_wall")).drop("_wall"))


def played_results(games: DataFrame, lag_hours: int = 24) -> DataFrame:
    """Result rows of played games; knowledge time is the start plus a lag."""
    return (games.where("home_score IS NOT NULL AND away_score IS NOT NULL")
            .select("game_id", F.col("home_score").cast("int").alias("home_score"),
                    F.col("away_score").cast("int").alias("away_score"),
                    F.coalesce("overtime", F.lit(0)).cast("int").alias("overtime"),
                    shift("scheduled_at", hours=lag_hours).alias("available_at")))


def results_from_team_log(games: DataFrame, log: DataFrame, lag_hours: int = 24) -> DataFrame:
    """Exactly one home and one away line per game; anything else names a ``problem``."""
    j = games.join(log, "game_id", "left")
    home, away = F.col("team_id") == F.col("home_id"), F.col("team_id") == F.col("away_id")
    g = j.groupBy("game_id", "scheduled_at").agg(
        F.count_if(home).alias("_h"), F.count_if(away).alias("_a"),
        F.max(F.when(home, F.col("pts"))).alias("home_score"), F.max(F.when(away, F.col("pts"))).alias("away_score"))
    ok = (F.col("_h") == 1) & (F.col("_a") == 1)
    return g.select("game_id", F.when(ok, F.col("home_score").cast("int")).alias("home_score"),
                    F.when(ok, F.col("away_score").cast("int")).alias("away_score"),
                    F.when(ok, shift("scheduled_at", hours=lag_hours)).alias("available_at"),
                    F.when(~ok, "need exactly two lines").alias("problem"))


def results_from_schedule(games: DataFrame, cache: DataFrame, lag_hours: int = 24) -> DataFrame:
    """Scores from cached schedule rows, with identity, integer and tie checks."""
    one = cache.groupBy("game_id").agg(F.min_by(F.struct(*[c for c in cache.columns if c not in ("game_id", "row_no")]),
                                                F.col("row_no")).alias("_c"))
    j = games.join(one, "game_id", "left")
    h, a = F.col("_c.home_score"), F.col("_c.away_score")
    bad = lambda v: (v < 0) | (v != F.round(v))
    problem = (F.when(h.isNull() | a.isNull(), "no cached score")
               .when((F.col("home_id") != F.col("_c.home_team")) | (F.col("away_id") != F.col("_c.away_team")), "team identity differs")
               .when(bad(h) | bad(a), "not a whole score").when(h == a, "tied"))
    return j.select("game_id", F.when(problem.isNull(), h.cast("int")).alias("home_score"),
                    F.when(problem.isNull(), a.cast("int")).alias("away_score"),
                    F.when(problem.isNull(), shift("scheduled_at", hours=lag_hours)).alias("available_at"), problem.alias("problem"))
