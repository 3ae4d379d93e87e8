"""Registered queries: price policy, allocation replay and the paper ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.catalog.features import r6
from knowntime.catalog.registry import query
from knowntime.catalog.scores import BOOT, BY_LEAGUE, CAND, candidates
from knowntime.functions.times import epoch_block, shift
from knowntime.operators import bootstrap as B, policy as P
from knowntime.plans import ledger as L
from knowntime.plans.logit import materialize


@query("binary_candidate", "WITH " + V.BETS + CAND.format(src="bets") + """
SELECT contest_id, side, round(p, 6) AS p, round(ev, 6) AS ev, round(min_odds, 6) AS min_odds, round(kelly, 6) AS kelly, book, ev >= 0.02 AND kelly > 0 AS qualifies FROM cand""")
def binary_candidate(spark, sf_dir):
    """Best side with haircut, cost, Kelly fraction and price floor (K1)."""
    c = candidates(V.bets(spark, sf_dir))
    return c.select("contest_id", "choice.side", r6("p", F.col("choice.p")), r6("ev", F.col("choice.ev")), r6("min_odds", F.col("choice.min_odds")),
                    r6("kelly", F.col("choice.kelly")), "choice.book", "choice.qualifies")


@query("push_candidate", "WITH " + V.BETS + """, t AS (SELECT *, (contest_id % 9) / 100.0::DOUBLE AS tie FROM bets),
s AS (SELECT *, 1 - tie AS dec, greatest(0.0::DOUBLE, p_model * (1 - tie) - 0.02::DOUBLE) AS rh, greatest(0.0::DOUBLE, (1 - p_model) * (1 - tie) - 0.02::DOUBLE) AS ra FROM t),
e AS (SELECT *, rh * (home_odds - 1) - greatest(0.0::DOUBLE, dec - rh) AS gh, ra * (away_odds - 1) - greatest(0.0::DOUBLE, dec - ra) AS ga FROM s),
c AS (SELECT *, ga - 0.005::DOUBLE > gh - 0.005::DOUBLE AS aw FROM e),
d AS (SELECT contest_id, CASE WHEN aw THEN 'away' ELSE 'home' END AS side, CASE WHEN aw THEN ga ELSE gh END AS edge, CASE WHEN aw THEN ra ELSE rh END AS risk,
      greatest(0.0::DOUBLE, dec - CASE WHEN aw THEN ra ELSE rh END) AS lose, CASE WHEN aw THEN away_odds ELSE home_odds END AS odds FROM c)
SELECT contest_id, side, round(edge - 0.005::DOUBLE, 6) AS ev, round(lose, 6) AS p_lose, round(CASE WHEN risk > 0 THEN (lose + 0.005::DOUBLE) / risk + 1 END, 6) AS min_odds,
       round(greatest(0.0::DOUBLE, edge / (odds - 1)), 6) AS kelly, edge - 0.005::DOUBLE >= 0.02 AND edge > 0 AS qualifies FROM d""")
def push_candidate(spark, sf_dir):
    """Best side when a tie returns the stake (K2)."""
    b = V.bets(spark, sf_dir).withColumn("tie", (F.col("contest_id") % 9) / F.lit(100.0)).withColumn("c", P.push_candidate("p_model", "tie"))
    return b.select("contest_id", "c.side", r6("ev", F.col("c.ev")), r6("p_lose", F.col("c.p_lose")), r6("min_odds", F.col("c.min_odds")),
                    r6("kelly", F.col("c.kelly")), "c.qualifies")


@query("settled_profit", "WITH " + V.BETS + """, s AS (SELECT contest_id, CASE contest_id % 11 WHEN 0 THEN 'tie' WHEN 1 THEN 'void' ELSE CASE WHEN y = 1 THEN 'home' ELSE 'away' END END AS outcome,
  CASE WHEN contest_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, CASE WHEN contest_id % 2 = 0 THEN home_odds ELSE away_odds END AS odds, (contest_id % 20)::DOUBLE AS stake FROM bets)
SELECT contest_id, round(CASE WHEN outcome IN ('tie', 'void') THEN 0 WHEN outcome = side THEN stake * (odds - 1) ELSE -stake END - stake * 0.005::DOUBLE, 6) + 0.0::DOUBLE AS pnl FROM s""")
def settled_profit(spark, sf_dir):
    """Win, lose, push or void; the cost is always charged (K3)."""
    k = F.col("contest_id")
    b = (V.bets(spark, sf_dir).withColumn("outcome", F.when(k % 11 == 0, "tie").when(k % 11 == 1, "void").when(F.col("y") == 1, "home").otherwise("away"))
         .withColumn("side", F.when(k % 2 == 0, "home").otherwise("away")).withColumn("odds", F.when(k % 2 == 0, F.col("home_odds")).otherwise(F.col("away_odds")))
         .withColumn("stake", (k % 20).cast("double")))
    return b.select("contest_id", r6("pnl", P.settled_profit("outcome", "side", "odds", "stake", 0.005)))


@query("worse_price_stress", "WITH " + V.BETS + ", m AS (SELECT b.* REPLACE (1 + (home_odds - 1) * x AS home_odds, 1 + (away_odds - 1) * x AS away_odds), x AS multiplier FROM bets b, (VALUES (1.0::DOUBLE), (0.99::DOUBLE)) v(x))"
       + CAND.format(src="m") + " SELECT multiplier, CAST(count(*) AS BIGINT) AS bets, round(avg(odds * won - 1 - 0.005::DOUBLE), 6) AS flat_yield FROM bet GROUP BY multiplier")
def worse_price_stress(spark, sf_dir):
    """Qualifying bets and yield at prices one percent worse (K4)."""
    b = candidates(P.worse_prices(V.bets(spark, sf_dir), (1.0, 0.99))).where("choice.qualifies")
    return b.groupBy("multiplier").agg(F.count("*").alias("bets"), F.avg(F.col("choice.odds") * F.col("won") - 1 - 0.005).alias("_y")).select(
        "multiplier", "bets", r6("flat_yield", F.col("_y")))


def _replayed(spark, sf_dir):
    stressed = P.worse_prices(V.bets(spark, sf_dir), (1.0, 0.99))
    rows = stressed.withColumn("choice", P.binary_candidate("p_model"))
    return P.replay(rows, ["account", "multiplier"])


@query("allocation_replay_bets")
def allocation_replay_bets(spark, sf_dir):
    """Order-dependent capped allocation per account and price stress: the bets (K5)."""
    return _replayed(spark, sf_dir).where("kind = 'bet'").select(
        "account", "multiplier", "contest_id", "side", r6("odds"), "won", r6("stake"), r6("return_per_stake"))


@query("allocation_replay_summary")
def allocation_replay_summary(spark, sf_dir):
    """Turnover, profit, yields and drawdown per account and stress (K5)."""
    return _replayed(spark, sf_dir).where("kind = 'summary'").select("account", "multiplier", "bets", *[r6(c) for c in P.SUMMARY if c != "bets"])


@query("allocation_replay_certificate", "WITH " + V.BETS + ", m AS (SELECT b.* REPLACE (1 + (home_odds - 1) * x AS home_odds, 1 + (away_odds - 1) * x AS away_odds), x AS multiplier FROM bets b, (VALUES (1.0::DOUBLE), (0.99::DOUBLE)) v(x))"
       + CAND.format(src="m") + """
SELECT account, multiplier, CAST(count(*) AS BIGINT) AS decisions, CAST(count(*) FILTER (ev >= 0.02 AND kelly > 0) AS BIGINT) AS qualified,
       true AS stakes_allowed, true AS sums_agree FROM cand GROUP BY ALL""")
def allocation_replay_certificate(spark, sf_dir):
    """Every stake of the replay, also each that was not placed, is the one that the policy allows (K5)."""
    rows = P.worse_prices(V.bets(spark, sf_dir), (1.0, 0.99)).withColumn("choice", P.binary_candidate("p_model"))
    replayed = materialize(P.replay(rows, ["account", "multiplier"]), "replay")
    return P.replay_certificate(rows, replayed, ["account", "multiplier"]).drop("bets")


def book(spark, sf_dir):
    """A ledger in mid-season: issued decisions, price checks and settlements."""
    c = candidates(V.bets(spark, sf_dir))
    k = F.col("contest_id")
    dec = c.where(F.col("decision_at") < F.lit("2000-01-01").cast("timestamp_ntz")).select(
        "account", k.alias("game_id"), F.col("decision_at").alias("issued_at"), "scheduled_at", F.col("choice.side").alias("side"),
        F.col("choice.odds").alias("odds"), F.col("choice.min_odds").alias("min_odds"), F.col("choice.p").alias("p"),
        F.when(F.col("choice.qualifies"), (k % 25).cast("double")).otherwise(0.0).alias("stake"), shift("decision_at", minutes=10).alias("expiry"), "won")
    late = F.make_dt_interval(F.lit(0), F.lit(0), F.when(k % 4 == 0, 15).otherwise(5))
    tick = c.where(k % 3 != 0).select("account", k.alias("game_id"), (F.col("decision_at") + late).alias("t"), (k % 6 != 0).alias("available"),
                                      F.when(k % 8 != 0, 1.1 + (k % 40) / F.lit(10.0)).alias("price"), F.explode(F.array(F.lit(0), F.lit(1))).alias("no"))
    checks = tick.select("account", "game_id", (F.col("game_id") * 2 + F.col("no")).alias("check_id"), (F.col("t") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("no"))).alias("checked_at"),
                         "price", "available")
    sett = dec.where("game_id % 5 <> 0").withColumn("outcome", F.when(F.col("game_id") % 17 == 0, "void").when(F.col("won") == 1, "win").otherwise("loss"))
    sett = sett.select("account", "game_id", "outcome", F.when(F.col("outcome") == "void", 0.0).otherwise(
        F.col("stake") * (F.col("odds") * F.col("won") - 1 - 0.005)).alias("pnl"))
    return dec, checks, sett


BOOK = V.BETS + CAND.format(src="bets") + """, dec AS (SELECT account, contest_id AS game_id, decision_at AS issued_at, scheduled_at, side, odds, min_odds, p,
    CASE WHEN ev >= 0.02 AND kelly > 0 THEN (contest_id % 25)::DOUBLE ELSE 0 END AS stake, decision_at + INTERVAL 10 MINUTE AS expiry, won FROM cand WHERE decision_at < TIMESTAMP '2000-01-01'),
chk AS (SELECT contest_id AS game_id, contest_id * 2 + n AS check_id, decision_at + to_minutes(CAST(CASE WHEN contest_id % 4 = 0 THEN 15 ELSE 5 END + n AS INTEGER)) AS checked_at,
    CASE WHEN contest_id % 8 <> 0 THEN 1.1::DOUBLE + (contest_id % 40) / 10.0::DOUBLE END AS price, contest_id % 6 <> 0 AS available FROM bets, range(2) r(n) WHERE contest_id % 3 <> 0),
sett AS (SELECT game_id, CASE WHEN game_id % 17 = 0 THEN 'void' WHEN won = 1 THEN 'win' ELSE 'loss' END AS outcome,
    CASE WHEN game_id % 17 = 0 THEN 0 ELSE stake * (odds * won - 1 - 0.005::DOUBLE) END AS pnl FROM dec WHERE game_id % 5 <> 0)"""


@query("ledger_account_state", "WITH " + BOOK + """
SELECT account, round(10000 + coalesce(sum(s.pnl), 0), 6) AS equity, round(sum(CASE WHEN s.pnl IS NULL THEN stake ELSE 0 END), 6) AS open_stake,
       round(sum(CASE WHEN CAST(issued_at AS DATE) = DATE '1999-12-30' THEN stake ELSE 0 END), 6) AS day_stake FROM dec LEFT JOIN sett s USING (game_id) GROUP BY account""")
def ledger_account_state(spark, sf_dir):
    """Equity, open stake and stake issued today per account (K6)."""
    dec, _, sett = book(spark, sf_dir)
    s = L.account_state(dec, sett, F.lit("1999-12-30 12:00:00").cast("timestamp_ntz"), 10000.0)
    return s.select("account", r6("equity"), r6("open_stake"), r6("day_stake"))


@query("ledger_issue")
def ledger_issue(spark, sf_dir):
    """Decisions issued now, under the shared caps of each account (K6)."""
    dec, _, sett = book(spark, sf_dir)
    day = F.date_trunc("day", "decision_at")
    cand = candidates(V.bets(spark, sf_dir)).where(day > F.lit("1999-12-31").cast("timestamp_ntz"))
    # All of the ledger's open days are brought to one instant, so a full batch is due at once.
    now = F.lit("2000-01-05 12:00:00").cast("timestamp_ntz")
    due = cand.select("account", F.col("contest_id").alias("game_id"), (now - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("contest_id") % 14).cast("int"))).alias("decision_at"),
                      (now - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("contest_id") % 13).cast("int"))).alias("quote_at"), "choice")
    return L.issue(due, dec, sett, now).select("account", "game_id", "side", r6("odds"), r6("stake"), "status", "expiry", "issued_at")


@query("ledger_check_guard", "WITH " + BOOK + """, odd AS (SELECT check_id, game_id, available, CASE WHEN check_id % 29 = 0 THEN 1.0::DOUBLE ELSE price END AS price FROM chk)
SELECT check_id, CASE WHEN price <= 1 THEN 'invalid price' WHEN game_id NOT IN (SELECT game_id FROM dec) THEN 'unknown decision' WHEN available AND price IS NULL THEN 'available without a price' END AS reason FROM odd""")
def ledger_check_guard(spark, sf_dir):
    """Price checks with the reason to refuse them (K7)."""
    dec, checks, _ = book(spark, sf_dir)
    odd = checks.withColumn("price", F.when(F.col("check_id") % 29 == 0, 1.0).otherwise(F.col("price")))
    return L.judge_checks(odd, dec).select("check_id", "reason")


@query("ledger_settlement_guard", "WITH " + BOOK + """, inc AS (SELECT contest_id AS game_id, CASE WHEN contest_id % 31 = 0 THEN 'push' WHEN contest_id % 17 = 0 THEN 'void' WHEN y = 1 THEN 'win' ELSE 'loss' END AS outcome FROM bets),
j AS (SELECT i.game_id, i.outcome, d.stake, d.odds, CASE WHEN i.outcome = 'push' THEN 'invalid outcome' WHEN d.game_id IS NULL THEN 'unknown decision' WHEN TIMESTAMP '1999-12-01' <= d.scheduled_at THEN 'before scheduled start'
      WHEN s.game_id IS NOT NULL THEN 'already settled' END AS reason FROM inc i LEFT JOIN dec d USING (game_id) LEFT JOIN sett s USING (game_id))
SELECT game_id, outcome, reason, round(CASE WHEN reason IS NULL THEN CASE WHEN outcome = 'void' THEN 0 ELSE stake * (odds * CASE WHEN outcome = 'win' THEN 1 ELSE 0 END - 1 - 0.005::DOUBLE) END END, 6) + 0.0::DOUBLE AS pnl FROM j""")
def ledger_settlement_guard(spark, sf_dir):
    """Settlements with profit or the reason to refuse them (K7)."""
    dec, _, sett = book(spark, sf_dir)
    k = F.col("contest_id")
    inc = V.bets(spark, sf_dir).select("account", k.alias("game_id"), F.when(k % 31 == 0, "push").when(k % 17 == 0, "void").when(F.col("y") == 1, "win").otherwise("loss").alias("outcome"))
    out = L.judge_settlements(inc, dec, sett, F.lit("1999-12-01 00:00:00").cast("timestamp_ntz"), 0.005)
    return out.select("game_id", "outcome", "reason", r6("pnl"))


@query("ledger_monitor", "WITH " + BOOK + """, fc AS (SELECT game_id, arg_min(struct_pack(price := price, available := available, t := checked_at), struct_pack(t := checked_at, i := check_id)) AS c FROM chk GROUP BY game_id),
j AS (SELECT d.*, f.c, s.outcome, s.pnl, coalesce(f.c.available AND f.c.price >= d.min_odds AND f.c.t <= d.expiry, false) AS ok FROM dec d LEFT JOIN fc f USING (game_id) LEFT JOIN sett s USING (game_id) WHERE d.stake > 0)
SELECT CAST(count(*) AS BIGINT) AS candidates, CAST(count(outcome) AS BIGINT) AS settled, CAST(count(*) - count(outcome) AS BIGINT) AS unsettled, CAST(count(c) AS BIGINT) AS checked,
       round(count(c) / count(*), 6) AS check_coverage, round(count(*) FILTER (c IS NOT NULL AND ok) / count(c), 6) AS price_rate, round(sum(stake) FILTER (outcome IS NOT NULL), 4) AS turnover,
       round(sum(pnl), 4) AS pnl, round(sum(pnl) / (sum(stake) FILTER (outcome IS NOT NULL)), 6) AS yield, round(avg(pow(p - CAST(outcome = 'win' AS DOUBLE), 2)) FILTER (outcome <> 'void'), 6) AS selected_brier,
       round((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(min(issued_at))) / 86400000000.0::DOUBLE, 6) AS observed_days,
       count(outcome) >= 300 AND (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(min(issued_at))) / 86400000000.0::DOUBLE >= 90 AS checkpoint FROM j""")
def ledger_monitor(spark, sf_dir):
    """First checks against floor and expiry, yield and Brier of the ledger."""
    m = L.monitor(*book(spark, sf_dir), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return m.select("candidates", "settled", "unsettled", "checked", r6("check_coverage"), r6("price_rate"), F.round("turnover", 4).alias("turnover"), F.round("pnl", 4).alias("pnl"),
                    r6("yield"), r6("selected_brier"), r6("observed_days"), "checkpoint")


YIELD_SQL = ("WITH " + BOOK + """, x AS (SELECT d.account AS league, CAST(floor(epoch_us(d.issued_at) / (7 * 86400000000)) AS BIGINT) AS block, s.pnl / d.stake AS v
  FROM dec d JOIN sett s USING (game_id) WHERE d.stake > 0)""" + BOOT.format(reps=2000, least=10, **BY_LEAGUE)).replace(
    "SELECT t.league, CAST(blocks", "SELECT t.league AS account, CAST(blocks").replace("AS difference, round(low", "AS flat_yield, round(low")


@query("ledger_yield_interval", YIELD_SQL)
def ledger_yield_interval(spark, sf_dir):
    """Flat yield of settled bets with its weekly-block interval."""
    dec, _, sett = book(spark, sf_dir)
    j = dec.where("stake > 0").join(sett, L.KEY).withColumn("block", epoch_block("issued_at", 7))
    out = B.bootstrap_interval(B.block_sums(j, ["account"], F.col("pnl") / F.col("stake")), ["account"], reps=2000, min_blocks=10)
    return out.select("account", "blocks", r6("flat_yield", F.col("difference")), r6("low"), r6("high"))
