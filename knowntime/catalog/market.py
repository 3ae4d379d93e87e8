"""Registered queries: quotes, consensus, payloads and event matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.catalog.features import r6
from knowntime.catalog.registry import query
from knowntime.functions.text import last_token, squash_name
from knowntime.functions.times import DAY_US, HOUR_US, MINUTE_US, micros, shift
from knowntime.operators import match, quotes as Q
from knowntime.operators.asof import asof_cumulative
from knowntime.sources import payload

# The given events are sparse (about two per user and day), hence a long quote age and delay.
AGE_US, LATER_MIN = 7 * DAY_US, 24 * 60

LATEST_SQL = V.QUOTES + ", " + V.DECISIONS + """, latest AS (
  SELECT * FROM (
    SELECT d.contest_id, d.decision_at, q.book, q.quote_id, q.quote_at, q.available_at, q.home_odds, q.away_odds,
           row_number() OVER (PARTITION BY d.contest_id, d.decision_at, q.book
                              ORDER BY q.available_at DESC, q.quote_at DESC, q.quote_id DESC) AS rn
    FROM decisions d JOIN quotes q ON q.contest_id = d.contest_id AND q.quote_at <= d.decision_at
         AND q.available_at <= d.decision_at AND q.quote_at >= d.decision_at - INTERVAL 7 DAY) WHERE rn = 1),
later AS (
  SELECT * FROM (
    SELECT d.contest_id, d.decision_at, q.book, q.quote_id, q.quote_at, q.available_at, q.home_odds, q.away_odds,
           row_number() OVER (PARTITION BY d.contest_id, d.decision_at, q.book
                              ORDER BY q.available_at DESC, q.quote_at DESC, q.quote_id DESC) AS rn
    FROM decisions d JOIN quotes q ON q.contest_id = d.contest_id
         AND q.quote_at <= d.decision_at + INTERVAL 24 HOUR AND q.available_at <= d.decision_at + INTERVAL 24 HOUR
         AND q.quote_at >= d.decision_at + INTERVAL 24 HOUR - INTERVAL 7 DAY) WHERE rn = 1 AND available_at > decision_at),
cons AS (
  SELECT contest_id, decision_at, count(*) AS books, quantile_cont(q, 0.5) AS q, stddev_pop(q) AS dispersion,
         max(q) - min(q) AS spread, avg(over) AS mean_overround, max(age) AS age_minutes
  FROM (SELECT *, (1 / home_odds) / (1 / home_odds + 1 / away_odds) AS q, 1 / home_odds + 1 / away_odds - 1 AS over,
               (epoch_us(decision_at) - epoch_us(quote_at)) / 60000000.0::DOUBLE AS age
        FROM latest WHERE book IN ('click', 'error', 'purchase')) GROUP BY ALL),
offers AS (
  SELECT contest_id, decision_at, arg_min(struct_pack(o := home_odds, b := book), struct_pack(x := -home_odds, b := book)) AS h,
         arg_min(struct_pack(o := away_odds, b := book), struct_pack(x := -away_odds, b := book)) AS a
  FROM latest WHERE book IN ('signup', 'view') GROUP BY ALL)"""


def latest(spark, sf_dir):
    return Q.latest_quotes(V.quotes(spark, sf_dir), V.quote_decisions(spark, sf_dir), max_age_us=AGE_US)


@query("latest_quote_per_book", "WITH " + LATEST_SQL + """
SELECT contest_id, decision_at, book, quote_id, quote_at, round(home_odds, 6) AS home_odds,
       round(away_odds, 6) AS away_odds FROM latest""")
def latest_quote_per_book(spark, sf_dir):
    """As-of latest revision per decision and book, inclusive, bounded age."""
    return latest(spark, sf_dir).select("contest_id", "decision_at", "book", "quote_id", "quote_at",
                                        r6("home_odds"), r6("away_odds"))


@query("later_quote_per_book", "WITH " + LATEST_SQL + """
SELECT contest_id, decision_at, book, quote_id, round(home_odds, 6) AS home_odds,
       round(away_odds, 6) AS away_odds FROM later""")
def later_quote_per_book(spark, sf_dir):
    """The revision seen by a slower reader."""
    return Q.later_quotes(V.quotes(spark, sf_dir), V.quote_decisions(spark, sf_dir), max_age_us=AGE_US,
                          delay_minutes=LATER_MIN).select(
        "contest_id", "decision_at", "book", "quote_id", r6("home_odds"), r6("away_odds"))


@query("devig", "WITH " + V.QUOTES + """
SELECT quote_id, round((1 / home_odds) / (1 / home_odds + 1 / away_odds), 6) AS q_home,
       round(1 / home_odds + 1 / away_odds - 1, 6) AS overround FROM quotes WHERE home_odds > 1 AND away_odds > 1""")
def devig(spark, sf_dir):
    """Proportional de-vig of every quote."""
    return V.quotes(spark, sf_dir).where(Q.valid_prices()).select(
        "quote_id", r6("q_home", Q.fair_home()), r6("overround", Q.overround()))


@query("consensus_reference", "WITH " + LATEST_SQL + """, used AS (
  SELECT contest_id, decision_at, (1 / home_odds) / (1 / home_odds + 1 / away_odds) AS q, 1 / home_odds + 1 / away_odds - 1 AS over,
         (epoch_us(decision_at) - epoch_us(quote_at)) / 60000000.0::DOUBLE AS age,
         book <> ['click', 'error', 'purchase', 'signup', 'view'][contest_id % 5 + 1] AS counted FROM latest),
own AS (
  SELECT contest_id, decision_at, count(*) FILTER (counted) AS books, quantile_cont(q, 0.5) FILTER (counted) AS q,
         stddev_pop(q) FILTER (counted) AS dispersion, max(q) FILTER (counted) - min(q) FILTER (counted) AS spread,
         avg(over) FILTER (counted) AS mean_overround, max(age) FILTER (counted) AS age_minutes
  FROM used GROUP BY contest_id, decision_at)
SELECT contest_id, decision_at, CAST(books AS BIGINT) AS books,
       CASE WHEN books >= 3 THEN round(q, 6) END AS q, CASE WHEN books >= 3 THEN round(dispersion, 6) END AS dispersion,
       CASE WHEN books >= 3 THEN round(spread, 6) END AS spread,
       CASE WHEN books >= 3 THEN round(mean_overround, 6) END AS mean_overround,
       CASE WHEN books >= 3 THEN round(60 * age_minutes, 6) END AS age_seconds,
       CASE WHEN books < 3 THEN 'fewer than 3 reference books' END AS abstain_reason FROM own""")
def consensus_reference(spark, sf_dir):
    """Median consensus over all books but the contest's execution book, with spread, overround, age and
    abstention (D15)."""
    own = F.element_at(F.array(*[F.lit(b) for b in sorted(V.REFERENCE_BOOKS + V.EXECUTION_BOOKS)]), (F.col("contest_id") % 5 + 1).cast("int"))
    out = Q.consensus(latest(spark, sf_dir), ["contest_id", "decision_at"], min_books=3, execution_book=own)
    return out.select("contest_id", "decision_at", "books", *[r6(c) for c in (
        "q", "dispersion", "spread", "mean_overround")], r6("age_seconds", 60 * F.col("age_minutes")), "abstain_reason")


@query("best_offer_per_side", "WITH " + LATEST_SQL + """
SELECT contest_id, decision_at, round(h.o, 6) AS home_odds, h.b AS home_book, round(a.o, 6) AS away_odds,
       a.b AS away_book FROM offers""")
def best_offer_per_side(spark, sf_dir):
    """Best price per side, ties to the lowest book name."""
    ex = latest(spark, sf_dir).where(F.col("book").isin(*V.EXECUTION_BOOKS))
    return Q.best_offers(ex, ["contest_id", "decision_at"]).select(
        "contest_id", "decision_at", r6("home_odds"), "home_book", r6("away_odds"), "away_book")


MARKET_SQL = "WITH " + LATEST_SQL + """, hist AS (
  SELECT d.contest_id, d.decision_at, count(p.decision_at) AS past
  FROM decisions d LEFT JOIN decisions p ON p.contest_id = d.contest_id AND p.decision_at < d.decision_at GROUP BY ALL),
labelled AS (
  SELECT d.contest_id, d.decision_at, c.q, c.dispersion, c.age_minutes, o.h, o.a, lh.home_odds AS home_later, la.away_odds AS away_later,
         CASE WHEN d.contest_id % 10 = 9 THEN 'outside_contract'
              WHEN coalesce(c.books, 0) < 3 THEN 'missing_fresh_reference_books'
              WHEN o.h IS NULL THEN 'missing_fresh_execution_book'
              WHEN h.past < 5 THEN 'insufficient_prior_games' END AS reason
  FROM decisions d JOIN hist h USING (contest_id, decision_at) LEFT JOIN cons c USING (contest_id, decision_at)
       LEFT JOIN offers o USING (contest_id, decision_at)
       LEFT JOIN later lh ON lh.contest_id = d.contest_id AND lh.decision_at = d.decision_at AND lh.book = o.h.b
       LEFT JOIN later la ON la.contest_id = d.contest_id AND la.decision_at = d.decision_at AND la.book = o.a.b)"""


def consensus_rows(spark, sf_dir):
    """Every decision with its number of earlier ones and the consensus of the reference books."""
    key = ["contest_id", "decision_at"]
    d, q = V.quote_decisions(spark, sf_dir), V.quotes(spark, sf_dir)
    cons = Q.consensus(Q.latest_quotes(q.where(F.col("book").isin(*V.REFERENCE_BOOKS)), d, max_age_us=AGE_US), key, min_books=3)
    past = asof_cumulative(d, d, ["contest_id"], fact_time="decision_at", probe_time="decision_at",
                           sums={"past": F.lit(1)})
    return past.join(cons, key, "left")


def market_rows(spark, sf_dir):
    """Every decision with consensus, offers, later prices and an exclusion reason."""
    key = ["contest_id", "decision_at"]
    d, q = V.quote_decisions(spark, sf_dir), V.quotes(spark, sf_dir)
    # A book's latest quote depends on no other book: each sweep gets its own books alone.
    offers = Q.best_offers(Q.latest_quotes(q.where(F.col("book").isin(*V.EXECUTION_BOOKS)), d, max_age_us=AGE_US), key)
    later = Q.later_quotes(q, d, max_age_us=AGE_US, delay_minutes=LATER_MIN)
    side = lambda s: later.select(*key, F.col("book").alias(f"{s}_book"),
                                  F.col(f"{s}_odds").alias(f"{s}_later"))
    rows = (consensus_rows(spark, sf_dir).join(offers, key, "left")
            .join(side("home"), [*key, "home_book"], "left").join(side("away"), [*key, "away_book"], "left"))
    return rows.withColumn("reason", Q.exclusion_reason(
        ("outside_contract", F.col("contest_id") % 10 == 9),
        ("missing_fresh_reference_books", F.coalesce("books", F.lit(0)) < 3),
        ("missing_fresh_execution_book", F.col("home_odds").isNull()),
        ("insufficient_prior_games", F.col("past") < 5)))


@query("market_features", MARKET_SQL + """
SELECT contest_id, decision_at, round(q, 6) AS q, round(dispersion, 6) AS dispersion, round(age_minutes, 6) AS age_minutes,
       round(h.o, 6) AS home_odds, h.b AS home_book, round(a.o, 6) AS away_odds, a.b AS away_book,
       round(home_later, 6) AS home_later, round(away_later, 6) AS away_later FROM labelled WHERE reason IS NULL""")
def market_features(spark, sf_dir):
    """The eligible rows of the market track."""
    return market_rows(spark, sf_dir).where("reason IS NULL").select(
        "contest_id", "decision_at", r6("q"), r6("dispersion"), r6("age_minutes"), r6("home_odds"),
        "home_book", r6("away_odds"), "away_book", r6("home_later"), r6("away_later"))


@query("exclusion_counts", MARKET_SQL + """
SELECT coalesce(reason, 'eligible') AS reason, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY ALL""")
def exclusion_counts(spark, sf_dir):
    """Rows per exclusion reason, first reason wins."""
    return (market_rows(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason"))
            .agg(F.count("*").alias("n")))


@query("snapshot_plan", "WITH " + V.DECISIONS + """
SELECT DISTINCT unnest([decision_at, decision_at + INTERVAL 5 MINUTE]) AS snapshot_at FROM decisions""")
def snapshot_plan(spark, sf_dir):
    """Distinct snapshot instants to request."""
    return Q.snapshot_times(V.quote_decisions(spark, sf_dir))


@query("snapshot_plan_cost", "WITH " + V.DECISIONS + """, t AS (
  SELECT DISTINCT unnest([decision_at, decision_at + INTERVAL 5 MINUTE]) AS s FROM decisions)
SELECT CAST(count(*) AS BIGINT) AS requests, CAST(count(*) * 30 AS BIGINT) AS credits_upper_bound,
       min(s) AS first_at, max(s) AS last_at FROM t""")
def snapshot_plan_cost(spark, sf_dir):
    """Request count and cost bound of the plan: one market, three regions, ten credits."""
    return Q.snapshot_times(V.quote_decisions(spark, sf_dir)).agg(
        F.count("*").alias("requests"), (F.count("*") * 30).alias("credits_upper_bound"),
        F.min("snapshot_at").alias("first_at"), F.max("snapshot_at").alias("last_at"))


def payload_text(spark, sf_dir):
    """Provider payloads as JSON text, one document per quote."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    q, k = V.spread(V.quotes(spark, sf_dir)), F.col("quote_id")
    c = F.col("contest_id").cast("string")
    home, away = F.concat(F.lit("H"), c), F.concat(F.lit("A"), c)
    price = lambda n, p: F.struct(n.alias("name"), p.alias("price"))
    home_price = F.when(k % 19 == 0, 1.0).otherwise(F.col("home_odds"))
    both = F.array(price(home, home_price), price(away, F.col("away_odds")))
    outcomes = (F.when(k % 7 == 0, F.slice(both, 1, 1))
                .when(k % 13 == 0, F.concat(both, F.array(price(F.lit("Draw"), F.lit(4.0)))))
                .otherwise(both))
    own = F.when(k % 3 != 0, iso(F.col("quote_at") + F.make_dt_interval(
        F.lit(0), F.lit(0), (k % 5 - 2).cast("int"))))
    markets = F.array(
        F.struct(F.lit("h2h").alias("key"), own.alias("last_update"), outcomes.alias("outcomes")),
        F.struct(F.lit("spreads").alias("key"), iso("quote_at").alias("last_update"), both.alias("outcomes")))
    book = F.struct(F.col("book").alias("key"), iso("quote_at").alias("last_update"), markets.alias("markets"))
    event = F.struct(c.alias("id"), home.alias("home_team"), away.alias("away_team"),
                     iso("available_at").alias("commence_time"), F.array(book).alias("bookmakers"))
    return q.select(F.to_json(F.struct(iso("available_at").alias("timestamp"),
                                       F.array(event).alias("data"))).alias("value"))


def event_map(spark, sf_dir):
    k = F.col("contest_id")
    return (V.quotes(spark, sf_dir).select("contest_id").distinct().where(k % 17 != 3)
            .select(k.cast("string").alias("event_id"), "contest_id",
                    F.concat(F.lit("H"), k).alias("home_name"), F.concat(F.lit("A"), k).alias("away_name")))


@query("payload_archive_flatten", "WITH " + V.QUOTES + """, p AS (
  SELECT contest_id, book, available_at, away_odds, CASE WHEN quote_id % 19 = 0 THEN 1.0::DOUBLE ELSE home_odds END AS home_odds,
         CASE WHEN quote_id % 3 = 0 THEN quote_at ELSE quote_at + to_minutes(CAST(quote_id % 5 - 2 AS INTEGER)) END AS quote_at
  FROM quotes WHERE contest_id % 17 <> 3 AND quote_id % 7 <> 0 AND quote_id % 13 <> 0)
SELECT DISTINCT contest_id, book, quote_at, available_at, round(home_odds, 6) AS home_odds, round(away_odds, 6) AS away_odds
FROM p WHERE quote_at <= available_at""")
def payload_archive_flatten(spark, sf_dir):
    """Nested archive payloads to quotes (A4)."""
    ev = payload.parse_body(payload_text(spark, sf_dir))
    out = payload.archived_quotes(ev, event_map(spark, sf_dir), "winner")
    return out.select("contest_id", "book", F.col("quote_at").cast("timestamp_ntz").alias("quote_at"),
                      F.col("available_at").cast("timestamp_ntz").alias("available_at"),
                      r6("home_odds"), r6("away_odds"))


@query("payload_unmapped_events", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS event_id FROM events WHERE user_id % 17 = 3""")
def payload_unmapped_events(spark, sf_dir):
    """Event ids absent from the event map (A4)."""
    return payload.unmapped_events(payload.parse_body(payload_text(spark, sf_dir)), event_map(spark, sf_dir))


@query("payload_renamed_events", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS event_id, 'H' || user_id AS seen_home, 'A' || user_id AS seen_away FROM events
WHERE user_id % 17 <> 3 AND user_id % 23 = 5""")
def payload_renamed_events(spark, sf_dir):
    """Events whose teams no longer match the map (A4)."""
    odd = F.col("contest_id") % 23 == 5
    stale = event_map(spark, sf_dir).withColumn("home_name", F.when(odd, "Old Name").otherwise(F.col("home_name")))
    return payload.renamed_events(payload.parse_body(payload_text(spark, sf_dir)), stale)


@query("payload_live_extract", "WITH " + V.QUOTES + """
SELECT CAST(contest_id AS VARCHAR) AS event_id, book, quote_at AS updated_at, round(home_odds, 6) AS home_odds,
       round(away_odds, 6) AS away_odds, round((1 / home_odds) / (1 / home_odds + 1 / away_odds), 6) AS q_home,
       round(1 / home_odds + 1 / away_odds - 1, 6) AS overround
FROM quotes WHERE quote_id % 7 <> 0 AND quote_id % 19 <> 0""")
def payload_live_extract(spark, sf_dir):
    """Live payloads: book time first, invalid and one-sided prices skipped (A5)."""
    out = payload.live_quotes(payload.parse_body(payload_text(spark, sf_dir)))
    return out.select("event_id", "book", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
                      *[r6(c) for c in ("home_odds", "away_odds", "q_home", "overround")])


def _named_games(spark, sf_dir):
    c = V.contests(spark, sf_dir)
    return c.select(F.col("contest_id").alias("game_id"), "scheduled_at",
                    F.concat(F.lit("LA Club Team"), "home_id").alias("home_name"),
                    F.concat(F.lit("Old Town Team"), "away_id").alias("away_name"))


@query("fuzzy_event_match", "WITH " + V.CONTESTS + """, ev AS (
  SELECT contest_id AS event_id, CASE WHEN contest_id % 31 = 0 THEN 'nobody' ELSE 'team' || home_id END AS h, 'team' || away_id AS a,
         scheduled_at + to_minutes(CAST((contest_id * 37 % 5760) - 2880 AS INTEGER)) AS commence_time FROM contests),
n AS (
  SELECT e.event_id, count(DISTINCT c.contest_id) FILTER (abs(epoch_us(c.scheduled_at) - epoch_us(e.commence_time)) <= 86400000000) AS near,
         max(c.contest_id) FILTER (abs(epoch_us(c.scheduled_at) - epoch_us(e.commence_time)) <= 86400000000) AS g, count(c.contest_id) AS anyway
  FROM ev e LEFT JOIN contests c ON 'team' || c.home_id = e.h AND 'team' || c.away_id = e.a GROUP BY ALL)
SELECT event_id, CASE WHEN near = 1 THEN g END AS game_id,
       CASE WHEN anyway = 0 THEN 'no schedule match' WHEN near <> 1 THEN near || ' schedule candidates' END AS reason FROM n""")
def fuzzy_event_match(spark, sf_dir):
    """Last-token names and a one-day tolerance: unique match or a quarantine reason."""
    games = _named_games(spark, sf_dir)
    keyed = games.select("game_id", "scheduled_at", last_token("home_name").alias("h"),
                         last_token("away_name").alias("a"))
    k = F.col("game_id")
    ev = games.select(
        k.alias("event_id"),
        last_token(F.when(k % 31 == 0, "Some Nobody").otherwise(F.upper("home_name"))).alias("h"),
        last_token(F.concat(F.lit("  X "), "away_name")).alias("a"),
        (F.col("scheduled_at") + F.make_dt_interval(F.lit(0), F.lit(0), (k * 37 % 5760 - 2880).cast("int")))
        .alias("commence_time"))
    out = match.match_unique(ev, keyed, ["h", "a"], tolerance_us=DAY_US)
    return out.select("event_id", "game_id", "reason")


@query("nearest_event_match", "WITH " + V.CONTESTS + """, ev AS (
  SELECT contest_id AS event_id, s AS sighting, home_id, away_id,
         scheduled_at + to_minutes(CAST((contest_id * 7 % 41) - 20 + s * 3 AS INTEGER)) AS commence_time
  FROM contests, (VALUES (0), (1)) v(s)),
m AS (
  SELECT e.event_id, e.sighting, arg_min(c.contest_id, struct_pack(d := abs(epoch_us(c.scheduled_at) - epoch_us(e.commence_time)),
           t := epoch_us(c.scheduled_at), i := -c.contest_id)) AS game_id,
         min(abs(epoch_us(c.scheduled_at) - epoch_us(e.commence_time))) AS distance
  FROM ev e JOIN contests c ON c.home_id = e.home_id AND c.away_id = e.away_id GROUP BY ALL)
SELECT event_id, arg_min(game_id, sighting) AS game_id, round(arg_min(distance, sighting) / 60000000.0::DOUBLE, 6) AS minutes
FROM m WHERE distance <= 900000000 GROUP BY event_id""")
def nearest_event_match(spark, sf_dir):
    """Nearest game within 15 minutes on normalized names; first sighting wins."""
    games = _named_games(spark, sf_dir)
    keyed = games.select("game_id", "scheduled_at", squash_name("home_name").alias("h"),
                         squash_name("away_name").alias("a"))
    k = F.col("game_id")
    ev = (games.withColumn("sighting", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        k.alias("event_id"), "sighting", squash_name(F.replace("home_name", F.lit("LA "), F.lit("Los Angeles "))).alias("h"),
        squash_name(F.upper("away_name")).alias("a"),
        (F.col("scheduled_at") + F.make_dt_interval(F.lit(0), F.lit(0), (
            k * 7 % 41 - 20 + F.col("sighting") * 3).cast("int"))).alias("commence_time")))
    out = match.match_nearest(ev, keyed, ["h", "a"], tolerance_us=15 * MINUTE_US)
    return out.select("event_id", "game_id", r6("minutes", F.col("distance_us") / F.lit(60_000_000.0)))
