"""Status reports: snapshots, as-of selection, counts, states and player impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from knowntime.functions.times import HOUR_US, micros
from knowntime.operators.asof import CHUNK_DAYS, asof_last, asof_rolling
from knowntime.operators.form import home_minus_away

# Declared statuses, the marker of a missing filing, and snapshot states.
STATUSES = ("Out", "Doubtful", "Questionable", "Probable", "Available")
NOT_SUBMITTED = "NotSubmitted"
WEIGHTED = ("Out", "Doubtful", "Questionable", "Probable")
STATES = ("missing", "stale", "not_submitted", "invalid")
COUNTS = [s.lower() for s in STATUSES]


def alias_lookup(teams: DataFrame) -> DataFrame:
    """``(alias, team_id)``: every team under its squashed name and under its short code."""
    return (teams.withColumn("alias", F.explode(F.array(
        F.regexp_replace("name", " ", ""), F.col("code")))).select("alias", "team_id").distinct())


def identify_reports(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve team, home and away of raw report rows; NULL reason means the row is usable."""
    pair = F.split("matchup", "@")
    two = F.size(pair) == 2
    rows = (raw.withColumn("_a", F.when(two, pair[0])).withColumn("_h", F.when(two, pair[1]))
            .withColumn("_team", F.regexp_replace("team", " ", ""))
            .withColumn("game_day", F.to_date(F.try_to_timestamp("game_date", F.lit("MM/dd/yyyy")))))
    for column, out in (("_team", "team_id"), ("_h", "home_id"), ("_a", "away_id")):
        side = aliases.select(F.col("alias").alias(column), F.col("team_id").alias(out))
        rows = rows.join(side, column, "left")
    reason = (F.when(F.col("team_id").isNull(), "unmapped team")
              .when(F.col("game_day").isNull(), "invalid date")
              .when(F.col("home_id").isNull() | F.col("away_id").isNull(), "invalid matchup")
              .when(F.col("report_at").isNull(), "missing report time")
              .when((F.col("team_id") != F.col("home_id")) & (F.col("team_id") != F.col("away_id")),
                    "team not in matchup")
              .when(~F.coalesce(F.col("status").isin(*STATUSES, NOT_SUBMITTED), F.lit(False)),
                    "unknown status"))
    return rows.withColumn("reason", reason).drop("_team", "_h", "_a")


def snapshots(reports: DataFrame, keys: Sequence[str], *, player: str = "player_id",
              source: str = "source") -> DataFrame:
    """One row per (key, report time): status counts and whether the rows conflict.

    Two aggregations with map-side partials; all rows at a time belong to one snapshot,
    whatever file they came from. A second file or a player listed twice is a conflict.
    """
    keys = [*keys, "report_at"]
    per_player = reports.groupBy(*keys, player).agg(
        F.count("*").alias("_n"), F.min(source).alias("_s0"), F.max(source).alias("_s1"),
        F.count_if(F.col("status") == NOT_SUBMITTED).alias("_ns"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    g = per_player.groupBy(*keys).agg(
        F.min("_s0").alias("source"), (F.min("_s0") != F.max("_s1")).alias("_many"),
        F.coalesce(F.max(F.when(F.col(player).isNotNull(), F.col("_n"))) > 1, F.lit(False)).alias("_dup"),
        (F.sum("_ns") > 0).alias("not_submitted"), *[F.sum(c).alias(c) for c in COUNTS])
    return g.withColumn("conflict", F.col("_many") | F.col("_dup")).drop("_many", "_dup")


def snapshot_states(games: DataFrame, snaps: DataFrame, keys: Sequence[str], *,
                    max_age_hours: float = 48, chunk_days: float | None = CHUNK_DAYS) -> DataFrame:
    """The latest snapshot strictly before each decision, its state and usable counts.

    ``games`` has one row per game and side. Precedence: missing, invalid, stale,
    not_submitted, usable. Only usable snapshots contribute counts.
    """
    s = snaps.withColumn("snapshot_at", F.col("report_at"))
    j = asof_last(s, games, list(keys), fact_time="report_at", probe_time="decision_at", order=[],
                  values=["snapshot_at", "source", "conflict", "not_submitted", *COUNTS],
                  chunk_days=chunk_days)
    age = (micros("decision_at") - micros("snapshot_at")) / F.lit(float(HOUR_US))
    state = (F.when(F.col("snapshot_at").isNull(), "missing").when(F.col("conflict"), "invalid")
             .when(F.col("age_hours") > max_age_hours, "stale")
             .when(F.col("not_submitted"), "not_submitted").otherwise("usable"))
    j = j.withColumn("age_hours", age).withColumn("state", state)
    usable = F.col("state") == "usable"
    return j.select(*games.columns, "snapshot_at", "age_hours", "state",
                    *[F.when(usable, F.col(c)).otherwise(0).cast("bigint").alias(c) for c in COUNTS],
                    (F.col("state") == "not_submitted").cast("bigint").alias("notsubmitted"))


def nested_states(games: DataFrame, *, max_age_hours: float = 48) -> DataFrame:
    """``snapshot_states`` of games and sides that carry their reports as an array ``reports`` (report_at, player_id, status, source).

    Nothing outside the row is needed, so nothing is joined or shuffled. Adds ``listed``, the weighted player rows (player_id, status) of a
    usable snapshot, as ``listed_players`` finds them.
    """
    visible = F.filter("reports", lambda r: r["report_at"] < F.col("decision_at"))
    g = games.withColumn("snapshot_at", F.array_max(F.transform(visible, lambda r: r["report_at"])))
    g = g.withColumn("_snap", F.filter("reports", lambda r: r["report_at"] == F.col("snapshot_at")))
    count = lambda s: F.size(F.filter("_snap", lambda r: r["status"] == s))
    sources = F.transform("_snap", lambda r: r["source"])
    players = F.filter(F.transform("_snap", lambda r: r["player_id"]), lambda p: p.isNotNull())
    conflict = (F.array_min(sources) != F.array_max(sources)) | (F.size(players) > F.size(F.array_distinct(players)))
    age = (micros("decision_at") - micros("snapshot_at")) / F.lit(float(HOUR_US))
    g = g.withColumn("age_hours", age).withColumn("state", F.when(F.col("snapshot_at").isNull(), "missing").when(conflict, "invalid")
                                                  .when(F.col("age_hours") > max_age_hours, "stale")
                                                  .when(count(NOT_SUBMITTED) > 0, "not_submitted").otherwise("usable"))
    usable = F.col("state") == "usable"
    listed = F.transform(F.filter("_snap", lambda r: r["status"].isin(*WEIGHTED) & r["player_id"].isNotNull()),
                         lambda r: F.struct(r["player_id"].alias("player_id"), r["status"].alias("status")))
    return g.select(*[c for c in games.columns if c != "reports"], "snapshot_at", "age_hours", "state",
                    *[F.when(usable, count(s)).otherwise(0).cast("bigint").alias(c) for s, c in zip(STATUSES, COUNTS)],
                    (F.col("state") == "not_submitted").cast("bigint").alias("notsubmitted"), F.when(usable, listed).alias("listed"))


def availability_features(states: DataFrame, key: Sequence[str] = ("game_id",)) -> DataFrame:
    """Home minus away counts (the Available status excluded), coverage and state flags."""
    counted = [s.lower() for s in WEIGHTED] + ["notsubmitted"]
    wide = home_minus_away(states, list(key), {
        **{c: F.col(c) for c in counted}, "state": F.col("state")})
    covered = (F.col("state_home") == "usable") & (F.col("state_away") == "usable")
    return wide.select(
        *key, *[(F.col(f"{c}_home") - F.col(f"{c}_away")).alias(
            ("not_submitted" if c == "notsubmitted" else c) + "_diff") for c in counted],
        covered.cast("int").alias("availability_covered"),
        *[(F.col(f"state_{side}") == st).cast("int").alias(f"{side}_{st}")
          for side in ("home", "away") for st in STATES])


def player_prior(logs: DataFrame, probes: DataFrame, keys: Sequence[str], *, window: int = 10,
                 chunk_days: float | None = CHUNK_DAYS) -> DataFrame:
    """Mean minutes and points over a player's last ``window`` known games (NULL: no history)."""
    return asof_rolling(logs, probes, list(keys), fact_time="available_at", probe_time="decision_at",
                        order=["log_id"], window=window, measures=["minutes", "points"],
                        aggs={"prior_minutes": F.avg("minutes"), "prior_points": F.avg("points")},
                        chunk_days=chunk_days)


def listed_players(states: DataFrame, reports: DataFrame, keys: Sequence[str],
                   player: str = "player_id") -> DataFrame:
    """The weighted player rows of every usable selected snapshot."""
    rows = reports.where(F.col("status").isin(*WEIGHTED) & F.col(player).isNotNull()).select(
        *keys, F.col("report_at").alias("snapshot_at"), player, "status")
    return states.where("state = 'usable'").join(rows, [*keys, "snapshot_at"])


def impact_features(games: DataFrame, listed: DataFrame, key: Sequence[str] = ("game_id",)) -> DataFrame:
    """Prior minutes of the listed players per status, home minus away, and unmatched counts.

    ``listed`` carries prior_minutes/prior_points; games without listed players get zeros.
    """
    sign = F.when(F.col("side") == "home", 1).otherwise(-1)
    hit = F.col("prior_minutes").isNotNull()
    per = listed.groupBy(*key).agg(
        *[F.sum(F.when(hit & (F.col("status") == s), sign * F.col("prior_minutes")).otherwise(0.0))
          .alias(f"{s.lower()}_minutes_diff") for s in WEIGHTED],
        F.sum(F.when(hit & (F.col("status") == "Out"), sign * F.col("prior_points")).otherwise(0.0))
        .alias("out_points_diff"),
        F.sum(F.when(~hit, sign).otherwise(0)).alias("unmatched_listed_diff"))
    return games.select(*key).distinct().join(per, list(key), "left").fillna(0)


def match_rate(listed: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("prior_minutes").isNotNull())
    return listed.agg(hit.alias("matched"), (F.count("*") - hit).alias("unmatched"),
                      (hit / F.greatest(F.count("*"), F.lit(1))).alias("match_rate"))
