"""Nested provider payloads: parse once, explode, keep valid two-sided winner markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from knowntime.functions.times import parse_tolerant

OUTCOME = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
MARKET = T.StructType([T.StructField("key", T.StringType()), T.StructField("last_update", T.StringType()),
                       T.StructField("outcomes", T.ArrayType(OUTCOME))])
BOOK = T.StructType([T.StructField("key", T.StringType()), T.StructField("last_update", T.StringType()),
                     T.StructField("markets", T.ArrayType(MARKET))])
EVENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("home_team", T.StringType()),
                      T.StructField("away_team", T.StringType()),
                      T.StructField("commence_time", T.StringType()),
                      T.StructField("bookmakers", T.ArrayType(BOOK))])
BODY = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("data", T.ArrayType(EVENT))])
WINNER_MARKET = "h2h"


def parse_body(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to (snapshot time, event) rows."""
    return (raw.select(F.from_json(column, BODY).alias("b"))
            .select(F.col("b.timestamp").alias("snapshot"), F.explode("b.data").alias("e")))


def unreadable_bodies(raw: DataFrame, column: str = "value") -> DataFrame:
    """Rows whose text is no payload: what ``parse_body`` cannot turn into events, for a quarantine and its count."""
    body = F.from_json(column, BODY)
    return raw.where(body.isNull() | body["data"].isNull())


def _last_prices(outcomes: str) -> Column:
    """name -> price; of a name that a market repeats, the last price. A market with a nameless outcome has no prices."""
    names = F.array_distinct(F.transform(outcomes, lambda o: o["name"]))
    last = F.transform(names, lambda n: F.struct(n, F.try_element_at(F.filter(outcomes, lambda o: o["name"].eqNullSafe(n)), F.lit(-1))["price"]))
    return F.map_from_entries(F.when(F.exists(names, lambda n: n.isNull()), F.slice(last, 1, 0)).otherwise(last))


def winner_markets(events: DataFrame) -> DataFrame:
    """One row per (event, book, winner market) with outcomes as a name -> price map."""
    return (events.select("snapshot", "e", F.explode("e.bookmakers").alias("b"))
            .select("snapshot", "e", "b", F.explode("b.markets").alias("m"))
            .where(F.col("m.key") == WINNER_MARKET)
            .select("snapshot", "e", "b", "m", _last_prices("m.outcomes").alias("prices")))


def archived_quotes(events: DataFrame, mapping: DataFrame, contract: str) -> DataFrame:
    """Quotes from archived snapshots, joined to contests through the event map.

    Only markets with exactly the two mapped names survive; the market's own update time wins
    over the book's; a quote newer than its snapshot is dropped; revisions are unique.
    """
    rows = winner_markets(events).withColumn("event_id", F.col("e.id")).join(mapping, "event_id")
    exact = (F.size("prices") == 2) & F.map_contains_key("prices", F.col("home_name")) \
        & F.map_contains_key("prices", F.col("away_name"))
    out = rows.where(exact).select(
        "contest_id", F.col("b.key").alias("book"),
        parse_tolerant(F.coalesce("m.last_update", "b.last_update")).alias("quote_at"),
        parse_tolerant("snapshot").alias("available_at"),
        F.col("prices")[F.col("home_name")].alias("home_odds"),
        F.col("prices")[F.col("away_name")].alias("away_odds"), F.lit(contract).alias("contract"))
    return (out.where(F.col("quote_at") <= F.col("available_at"))
            .groupBy("contest_id", "book", "quote_at", "available_at", "contract")
            .agg(F.min(F.struct("home_odds", "away_odds")).alias("_o"))        # of several, the least: no run differs from another
            .select("contest_id", "book", "quote_at", "available_at", "_o.home_odds", "_o.away_odds", "contract"))


def unmapped_events(events: DataFrame, mapping: DataFrame) -> DataFrame:
    return (events.select(F.col("e.id").alias("event_id")).distinct()
            .join(mapping.select("event_id"), "event_id", "left_anti"))


def renamed_events(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped events whose team names differ from the map: the mapping needs review first."""
    names = events.select(F.col("e.id").alias("event_id"), F.col("e.home_team").alias("seen_home"),
                          F.col("e.away_team").alias("seen_away")).distinct()
    return names.join(mapping, "event_id").where(
        "seen_home <> home_name OR seen_away <> away_name").select("event_id", "seen_home", "seen_away")


def live_quotes(events: DataFrame) -> DataFrame:
    """Live snapshot: the book's update time wins; invalid or one-sided prices are skipped."""
    rows = winner_markets(events).select(
        F.col("e.id").alias("event_id"), F.col("b.key").alias("book"),
        F.col("prices")[F.col("e.home_team")].alias("home_odds"),
        F.col("prices")[F.col("e.away_team")].alias("away_odds"),
        parse_tolerant(F.coalesce("b.last_update", "m.last_update")).alias("updated_at"))
    from knowntime.operators.quotes import fair_home, overround, valid_prices
    return (rows.where(valid_prices()).withColumn("q_home", fair_home())
            .withColumn("overround", overround()))
