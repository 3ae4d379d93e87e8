"""Data-quality rules: violations are counted in distributed passes, never row by row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def row_rules(frame: DataFrame, rules: Mapping[str, Column], *, unknown: bool) -> DataFrame:
    """All row-level rules of a table in one scan: ``(rule, violations)``.

    A rule is the condition that marks a bad row. ``unknown`` says whether a row counts where the condition
    is NULL; suites say no, as a rule of their own counts the missing fields (so the suite still fails).
    """
    counts = frame.agg(*[F.count_if(F.coalesce(c, F.lit(unknown))).alias(f"_r{i}")
                         for i, c in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_r{i}").alias("violations"))
                      for i, n in enumerate(rules)])
    return counts.select(F.explode(pairs).alias("_p")).select("_p.*")


def bad(condition: Column) -> Column:
    """A condition that marks a bad row, also where it is NULL."""
    return F.coalesce(condition, F.lit(True))


def unique_rule(frame: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    per = frame.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("rule"), "violations")


def subset_rule(frame: DataFrame, reference: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is absent from the reference table."""
    per = frame.groupBy(*keys).agg(F.count("*").alias("_n"))      # one row per key before the join
    missing = per.join(reference.select(*keys), list(keys), "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("rule"), "violations")


def suite(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_clean(report: DataFrame) -> None:
    """Raise when any rule is violated (the report has one row per rule)."""
    bad = report.where("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in bad))


def not_whole(*columns: str) -> Column:
    """A score that is missing, negative, not finite or not an integer."""
    def broken(c):
        v = F.col(c).cast("double")
        return v.isNull() | F.isnan(v) | (v < 0) | (F.abs(v) == float("inf")) | (v != F.floor(v))
    return reduce(lambda a, b: a | b, [broken(c) for c in columns])


def any_null(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def flag(column: str) -> Column:
    """Booleans spelled true/false/1/0 in any case; anything else is NULL."""
    v = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(v.isin("true", "1"), 1).when(v.isin("false", "0"), 0)


def market_suite(games: DataFrame, results: DataFrame, odds: DataFrame, *, cutoff_minutes: int) -> DataFrame:
    """Rules of the market track: schedule, results and price revisions."""
    from knowntime.functions.times import micros
    lead = micros("scheduled_at") - micros("decision_at")
    started = results.join(games.select("game_id", "scheduled_at").dropDuplicates(["game_id"]), "game_id")
    price = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) <= 1) | (F.col(c) == float("inf"))
    return suite(
        row_rules(games, {
            "games_null_field": any_null("game_id", "home_id", "away_id", "scheduled_at",
                                         "observed_at", "decision_at"),
            "identical_teams": F.col("home_id") == F.col("away_id"),
            "schedule_after_decision": F.col("observed_at") > F.col("decision_at"),
            "cutoff_differs": lead != F.lit(cutoff_minutes * 60_000_000)}, unknown=False),
        unique_rule(games, "duplicate_game", ["game_id"]),
        row_rules(results, {
            "results_null_field": any_null("game_id", "home_score", "away_score", "available_at"),
            "invalid_score": not_whole("home_score", "away_score"),
            "tied_score": F.col("home_score") == F.col("away_score")}, unknown=False),
        unique_rule(results, "duplicate_result", ["game_id"]),
        subset_rule(results, games, "unmapped_result", ["game_id"]),
        row_rules(started, {"result_before_start": F.col("available_at") <= F.col("scheduled_at")}, unknown=False),
        row_rules(odds, {
            "odds_null_field": any_null("game_id", "book", "quote_at", "available_at", "home_odds", "away_odds"),
            "invalid_price": price("home_odds") | price("away_odds"),
            "quote_after_available": F.col("quote_at") > F.col("available_at")}, unknown=False),
        unique_rule(odds, "duplicate_revision", ["game_id", "book", "quote_at", "available_at"]),
        subset_rule(odds, games, "unmapped_quote", ["game_id"]))


def _season_rules(df: DataFrame, extra: Mapping[str, Column]) -> DataFrame:
    return row_rules(df, {
        "missing_time": any_null("scheduled_at", "decision_at", "available_at", "observed_at"),
        "decision_not_before_start": F.col("decision_at") >= F.col("scheduled_at"),
        "result_not_after_start": F.col("available_at") <= F.col("scheduled_at"),
        "schedule_after_decision": F.col("observed_at") > F.col("decision_at"),
        "invalid_teams": any_null("home_id", "away_id") | (F.col("home_id") == F.col("away_id")),
        "invalid_score": not_whole("home_score", "away_score"),
        "not_regular": F.coalesce(F.col("season_type"), F.lit("")) != "regular",
        "invalid_neutral_flag": flag("is_neutral").isNull(), **extra}, unknown=False)


def binary_suite(games: DataFrame, results: DataFrame) -> DataFrame:
    """Rules of the two-outcome track: identical id sets, final scores, no ties."""
    df = games.join(results, "game_id")
    return suite(
        unique_rule(games, "duplicate_game", ["game_id"]),
        unique_rule(results, "duplicate_result", ["game_id"]),
        subset_rule(results, games, "result_without_game", ["game_id"]),
        subset_rule(games, results, "game_without_result", ["game_id"]),
        _season_rules(df, {"tied_score": F.col("home_score") == F.col("away_score"),
                           "not_final": bad(~F.startswith(F.trim("source_status"), F.lit("Final")))}))


def tie_suite(games: DataFrame, results: DataFrame, contract: str) -> DataFrame:
    """Rules of the tie-aware track: results within the schedule, ties legal, one contract."""
    df = games.join(results, "game_id")
    return suite(
        unique_rule(games, "duplicate_game", ["game_id"]),
        unique_rule(results, "duplicate_result", ["game_id"]),
        subset_rule(results, games, "result_without_game", ["game_id"]),
        _season_rules(df, {"other_contract": F.coalesce(F.col("contract"), F.lit("")) != contract}))


def labels(frame: DataFrame) -> DataFrame:
    """Outcome columns: y, is_tie, rating score and the 0/1 flags."""
    return (frame.withColumn("is_tie", (F.col("home_score") == F.col("away_score")).cast("int"))
            .withColumn("y", (F.col("home_score") > F.col("away_score")).cast("int"))
            .withColumn("rating_score", F.when(F.col("is_tie") == 1, 0.5)
                        .otherwise(F.col("y").cast("double")))
            .withColumn("neutral", flag("is_neutral"))
            .withColumn("div_game", F.coalesce(F.col("div_game"), F.lit(0)).cast("int")))


def degenerate_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value: equal extremes in one scan, each in its own type, no distinct sets."""
    ends = frame.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("constant")) for c in columns])
    return ends.select(F.explode(rows).alias("_r")).select("_r.*")


def settled_class() -> Column:
    """Class of a schedule row: the first matching reason to skip it, or 'settled'."""
    home, away = F.col("home_id").cast("string"), F.col("away_id").cast("string")
    return (F.when(bad(~F.startswith("game_id", F.lit("002"))), "not_regular_season")
            .when(bad((home == "0") | (away == "0") | (home == away)), "unassigned_teams")
            .when(bad(~F.startswith(F.trim("status"), F.lit("Final"))), "not_final")
            .when(F.col("home_score").isNull() | F.col("away_score").isNull(), "missing_score")
            .when(F.col("home_score") == F.col("away_score"), "tied").otherwise("settled"))


# How sources write a team that is not known yet.
PLACEHOLDERS = ("", "None", "nan", "TBD")


def unassigned() -> Column:
    """Placeholder teams: id zero or a name not known yet."""
    blank = [F.trim(c).isin(*PLACEHOLDERS) for c in ("home_name", "away_name")]
    return ((F.col("home_id").cast("string") == "0") | (F.col("away_id").cast("string") == "0")
            | blank[0] | blank[1])


def apply_overrides(frame: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed corrections, applied only where the recorded 'before' state still holds.

    Returns the corrected table and one audit row per override. Overrides are a small reviewed
    list; the join is left to the optimizer, which broadcasts it only by its size.
    """
    j = frame.join(overrides, "game_id", "left")
    hit = F.col("after").isNotNull()
    same = ((F.col("is_neutral") == F.col("before")) & (F.col("home_id") == F.col("expected_home"))
            & (F.col("away_id") == F.col("expected_away")))
    fixed = j.withColumn("is_neutral", F.when(hit & same, F.col("after")).otherwise(F.col("is_neutral")))
    audit = overrides.join(frame, "game_id", "left").select(
        "game_id", "before", "after", F.when(F.col("home_id").isNull(), "unknown game")
        .when(same, "applied").otherwise("state differs").alias("outcome"))
    return fixed.select(*frame.columns), audit


def contract_of() -> Column:
    """Rules are chosen by what the row declares, never by where it came from."""
    declared = F.lower(F.col("sport"))
    return (F.when(declared.isin("nba", "nfl"), declared)
            .when(F.startswith("contract", F.lit("nfl_")), "nfl").otherwise("nba"))


# Annotation kinds, and the key pattern of forecasts and stakes.
ANNOTATION_KINDS = ("evidence", "quality", "scenario", "narrative")
FORECAST_KEY = r"(?i)(^|_)(p|prob|probability|odds|price|stake|kelly|ev|edge|wager|bet)($|_)"


def annotation_reason() -> Column:
    """Why an annotation is refused, NULL when it may be stored."""
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    return (F.when(bad(~F.col("kind").isin(*ANNOTATION_KINDS)), "unknown kind")
            .when(bad(F.exists(F.map_keys("body"), lambda k: k.rlike(FORECAST_KEY))), "forecast or stake field")
            .when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no source")
            .when(F.exists("sources", lambda s: blank(s["url"]) | blank(s["retrieved_at"])), "incomplete source")
            .when(F.coalesce("adopted", F.lit(False)), "self-adopted"))


def source_reason(at: Column, hours: int = 48) -> Column:
    """Why a captured source is not eligible at ``at``; needs a ``copies`` count per file name."""
    start = at - F.make_dt_interval(F.lit(0), F.lit(hours))
    return (F.when(bad(F.col("filename").contains("/") | F.col("filename").isin("", ".", "..")), "unsafe name")
            .when(bad(F.col("copies") > 1), "duplicate name")
            .when(bad(F.col("capture") != "prospective"), "not prospective")
            .when(F.col("retrieved_at").isNull(), "no retrieval time")
            .when(bad((F.col("retrieved_at") < start) | (F.col("retrieved_at") >= at)), "outside window")
            .when(bad(F.col("nominal_at") > F.col("retrieved_at")), "report after retrieval"))


def with_copies(frame: DataFrame, key: str) -> DataFrame:
    """Attach the size of each key's group; only repeated keys are joined back."""
    many = frame.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
    return frame.join(many, key, "left").fillna({"copies": 1})


def coverage_gate(frame: DataFrame, split: str, *, covered: str, label: str = "y",
                  min_rows: int = 30, min_coverage: float = 0.8) -> DataFrame:
    """Per split: rows, both classes, mean coverage, and whether fitting may go ahead."""
    g = frame.groupBy(split).agg(
        F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("both_classes"),
        F.avg(F.col(covered).cast("double")).alias("coverage"))
    return g.withColumn("passes", (F.col("n") >= min_rows) & F.col("both_classes")
                        & (F.col("coverage") >= min_coverage))
