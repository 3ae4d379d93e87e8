"""Registered queries: scores, calibration, bootstraps, rollups and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.catalog.features import r6
from knowntime.catalog.market import LATEST_SQL, market_rows
from knowntime.catalog.registry import query
from knowntime.functions.prob import log_loss
from knowntime.functions.times import epoch_block, micros
from knowntime.operators import bootstrap as B, gates as Gate, metrics as M, policy as P

LL = "-(y * ln({p}) + (1 - y) * ln(1 - {p}))"
LONG = V.PREDICTIONS + """, lf AS (SELECT contest_id, league, season, neutral, decision_at, y, is_tie, 'model' AS model, p_model AS p FROM predictions
  UNION ALL SELECT contest_id, league, season, neutral, decision_at, y, is_tie, 'base', p_base FROM predictions)"""
SCORES = ("CAST(count(*) AS BIGINT) AS n, round(avg(" + LL.format(p="p") + "), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, "
          "round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy")


def long(spark, sf_dir):
    return M.long_form(V.predictions(spark, sf_dir), ["model", "base"])


def rounded(frame, keys, names=("log_loss", "brier", "accuracy"), extra=("n",)):
    return frame.select(*keys, *extra, *[r6(c) for c in names])


@query("proper_scores", "WITH " + LONG + f" SELECT model, {SCORES} FROM lf GROUP BY ALL")
def proper_scores(spark, sf_dir):
    """Log loss, Brier and accuracy per model."""
    return rounded(M.score(long(spark, sf_dir), ["model"]), ["model"])


@query("monthly_scores", "WITH " + LONG + f" SELECT model, strftime(decision_at, '%Y-%m') AS month, {SCORES} FROM lf GROUP BY ALL")
def monthly_scores(spark, sf_dir):
    """Scores per month (E5)."""
    f = long(spark, sf_dir).withColumn("month", F.date_format("decision_at", "yyyy-MM"))
    return rounded(M.score(f, ["model", "month"]), ["model", "month"])


@query("neutral_subset_scores", "WITH " + LONG + f" SELECT model, {SCORES} FROM lf WHERE neutral = 1 GROUP BY model HAVING min(y) <> max(y)")
def neutral_subset_scores(spark, sf_dir):
    """Scores on a subset that has both outcomes."""
    f = long(spark, sf_dir).where("neutral = 1")
    ok = f.groupBy("model").agg((F.min("y") != F.max("y")).alias("both"))
    return rounded(M.score(f, ["model"]).join(ok.where("both"), "model"), ["model"])


RELIABILITY = "CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed"


@query("calibration_bins_decile", "WITH " + LONG + """, e AS (SELECT CAST(i AS INTEGER) AS bin, i * 0.1::DOUBLE AS low FROM range(10) t(i))
SELECT model, bin, """ + RELIABILITY + " FROM lf JOIN e ON p >= low AND p < low + 0.1::DOUBLE GROUP BY ALL")
def calibration_bins_decile(spark, sf_dir):
    """Ten half-open bins; p = 1 falls out."""
    return rounded(M.reliability(long(spark, sf_dir), ["model"], M.decile_bin()), ["model", "bin"], ("mean_p", "observed"))


@query("calibration_bins_clipped", "WITH " + LONG + """
SELECT model, CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, """ + RELIABILITY + " FROM lf GROUP BY ALL")
def calibration_bins_clipped(spark, sf_dir):
    """Ten clipped bins."""
    return rounded(M.reliability(long(spark, sf_dir), ["model"], M.clipped_bin()), ["model", "bin"], ("mean_p", "observed"))


@query("ece_ten_bins", "WITH " + LONG + """, b AS (SELECT model, floor(p * 10) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS ob FROM lf GROUP BY ALL)
SELECT model, round(sum(n * abs(mp - ob)) / sum(n), 6) AS ece FROM b GROUP BY model""")
def ece_ten_bins(spark, sf_dir):
    """Expected calibration error on the clipped bins."""
    t = M.reliability(long(spark, sf_dir), ["model"], M.clipped_bin())
    return M.calibration_error(t, ["model"]).select("model", r6("ece"))


@query("classwise_ece", "WITH " + LONG + """, k AS (SELECT model, 1 AS k, p, y::DOUBLE AS y FROM lf UNION ALL SELECT model, 0, 1 - p, 1.0 - y FROM lf),
i AS (SELECT *, len(list_filter(list_transform(range(1, 20), lambda j: j / 20.0::DOUBLE), lambda e: e <= p)) AS bin FROM k),
b AS (SELECT model, k, bin, count(*) AS n, avg(p) AS mp, avg(y) AS ob FROM i GROUP BY ALL),
e AS (SELECT model, k, sum(n * abs(mp - ob)) / sum(n) AS ece FROM b GROUP BY ALL)
SELECT model, round(max(ece) FILTER (k = 1), 6) AS ece, round(avg(ece), 6) AS classwise_ece FROM e GROUP BY model""")
def classwise_ece(spark, sf_dir):
    """Twenty inner-edge bins and the classwise variant."""
    return M.classwise_error(long(spark, sf_dir), ["model"]).select("model", r6("ece"), r6("classwise_ece"))


THREE = """, t AS (SELECT *, 0.002::DOUBLE + (contest_id % 7) / 1000.0::DOUBLE AS p_tie FROM lf),
d AS (SELECT *, (1 - p_tie) * (1 - p) AS pa, (1 - p_tie) * p AS ph FROM t),
c AS (SELECT *, CASE WHEN is_tie = 1 THEN p_tie WHEN y = 1 THEN ph ELSE pa END AS chosen,
      pow(pa - CAST(is_tie = 0 AND y = 0 AS DOUBLE), 2) + pow(p_tie - is_tie, 2) + pow(ph - CAST(is_tie = 0 AND y = 1 AS DOUBLE), 2) AS sq FROM d)"""


def with_tie(spark, sf_dir):
    return long(spark, sf_dir).withColumn("p_tie", F.lit(0.002) + (F.col("contest_id") % 7) / F.lit(1000.0))


@query("three_way_scores", "WITH " + LONG + THREE + """
SELECT model, CAST(count(*) AS BIGINT) AS games, CAST(sum(is_tie) AS BIGINT) AS ties, round(avg(-ln(chosen)), 6) AS three_way_log_loss, round(avg(sq), 6) AS three_way_brier,
       CAST(count(*) FILTER (is_tie = 0) AS BIGINT) AS decided_games, round(avg(""" + LL.format(p="p") + """) FILTER (is_tie = 0), 6) AS decided_log_loss,
       round(avg((p - y) * (p - y)) FILTER (is_tie = 0), 6) AS decided_brier, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) FILTER (is_tie = 0), 6) AS decided_accuracy
FROM c GROUP BY model""")
def three_way_scores(spark, sf_dir):
    """Away / tie / home metrics with the decided-only view."""
    return rounded(M.three_way_score(with_tie(spark, sf_dir), ["model"]), ["model"],
                   ("three_way_log_loss", "three_way_brier", "decided_log_loss", "decided_brier", "decided_accuracy"), ("games", "ties", "decided_games"))


@query("shrunk_tie_rate", "WITH " + V.PREDICTIONS + """
SELECT league, season, round((sum(is_tie) + 1.0) / (count(*) + 500), 6) AS tie_rate, round(avg(y), 6) AS home_rate FROM predictions GROUP BY ALL""")
def shrunk_tie_rate(spark, sf_dir):
    """Shrunk tie rate and the constant base rate."""
    p = V.predictions(spark, sf_dir)
    return p.groupBy("league", "season").agg(M.shrunk_rate(F.col("is_tie")).alias("_t"), F.avg("y").alias("_h")).select(
        "league", "season", r6("tie_rate", F.col("_t")), r6("home_rate", F.col("_h")))


@query("paired_loss_difference", "WITH " + V.PREDICTIONS + f"""
SELECT contest_id, round({LL.format(p='p_model')} - {LL.format(p='p_base')}, 6) AS difference FROM predictions""")
def paired_loss_difference(spark, sf_dir):
    """Loss of the model minus loss of the baseline, per contest."""
    return V.predictions(spark, sf_dir).select("contest_id", r6("difference", M.paired_difference("y", "p_model", "p_base")))


BOOT = """, bs AS (SELECT {keys} block, sum(v) AS s, count(*) AS n FROM x GROUP BY ALL),
ix AS (SELECT *, row_number() OVER ({part} ORDER BY block) - 1 AS i FROM bs),
tot AS (SELECT {keys} count(*) AS blocks, sum(s) / sum(n) AS difference FROM bs {group}),
dr AS (SELECT {keys} rep, slot, ('0x' || substr(md5('42|' || rep || '|' || slot), 1, 8))::UBIGINT % blocks AS i
       FROM tot, range({reps}) r(rep), LATERAL (SELECT unnest(range(blocks)) AS slot) WHERE blocks >= {least}),
mn AS (SELECT {dkeys} d.rep, sum(s) / sum(n) AS m FROM dr d JOIN ix ON ix.i = d.i {joink} GROUP BY ALL),
ci AS (SELECT {keys} quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM mn {group})
SELECT {tkeys} CAST(blocks AS BIGINT) AS blocks, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high FROM tot t LEFT JOIN ci ON {onk}"""
BY_LEAGUE = dict(keys="league,", part="PARTITION BY league", group="GROUP BY league", dkeys="d.league,", joink="AND ix.league = d.league",
                 tkeys="t.league,", onk="ci.league = t.league")
DIFF = f"{LL.format(p='p_model')} - {LL.format(p='p_base')} AS v"
PLAYED = " FROM predictions WHERE is_tie = 0)"


def _interval(spark, sf_dir, frame, reps, min_blocks):
    sums = B.block_sums(frame, ["league"], M.paired_difference("y", "p_model", "p_base"))
    out = B.bootstrap_interval(sums, ["league"], reps=reps, min_blocks=min_blocks)
    return out.select("league", "blocks", r6("difference"), r6("low"), r6("high"))


@query("bootstrap_epoch_blocks", "WITH " + V.PREDICTIONS + f", x AS (SELECT league, CAST(floor(epoch_us(decision_at) / (28 * 86400000000)) AS BIGINT) AS block, {DIFF}" + PLAYED
       + BOOT.format(reps=2000, least=10, **BY_LEAGUE))
def bootstrap_epoch_blocks(spark, sf_dir):
    """28-day absolute blocks, 2,000 repetitions, none below ten blocks."""
    f = V.predictions(spark, sf_dir).where("is_tie = 0").withColumn("block", epoch_block("decision_at", 28))
    return _interval(spark, sf_dir, f, 2000, 10)


@query("bootstrap_relative_weeks", "WITH " + V.PREDICTIONS + f""", f AS (SELECT league, min(decision_at) AS t FROM predictions WHERE is_tie = 0 GROUP BY league),
x AS (SELECT league, CAST(floor(floor((epoch_us(decision_at) - epoch_us(t)) / 86400000000) / 7) AS BIGINT) AS block, {DIFF} FROM predictions JOIN f USING (league) WHERE is_tie = 0)"""
       + BOOT.format(reps=1000, least=0, **BY_LEAGUE))
def bootstrap_relative_weeks(spark, sf_dir):
    """Weeks since the first decision, 1,000 repetitions."""
    f = B.relative_weeks(V.predictions(spark, sf_dir).where("is_tie = 0"), ["league"])
    return _interval(spark, sf_dir, f, 1000, 0)


@query("bootstrap_season_weeks", "WITH " + V.PREDICTIONS + f", x AS (SELECT league, season || '-' || week(decision_at) AS block, {DIFF}" + PLAYED
       + BOOT.format(reps=2000, least=10, **BY_LEAGUE))
def bootstrap_season_weeks(spark, sf_dir):
    """Season and ISO week blocks, 2,000 repetitions."""
    f = V.predictions(spark, sf_dir).where("is_tie = 0").withColumn("block", B.season_week())
    return _interval(spark, sf_dir, f, 2000, 10)


@query("variant_identity_gaps", "WITH " + LONG + """
SELECT contest_id, CAST(1 AS BIGINT) AS rows FROM predictions WHERE contest_id % 1000 = 7""")
def variant_identity_gaps(spark, sf_dir):
    """Contests not scored once by every variant."""
    f = long(spark, sf_dir).where("NOT (model = 'base' AND contest_id % 1000 = 7)")
    return M.identity_gaps(f, "model", ["model", "base"], ["contest_id"])


@query("pooled_scores", "WITH " + LONG + f" SELECT model, {SCORES} FROM lf WHERE season IN (1998, 1999, 2000) GROUP BY model")
def pooled_scores(spark, sf_dir):
    """Metrics pooled across folds that score identical contests."""
    from knowntime.operators.splits import season_folds
    f = season_folds(V.predictions(spark, sf_dir), (1998, 1999, 2000)).where("split = 'validation'")
    return rounded(M.score(M.long_form(f, ["model", "base"]), ["model"]), ["model"])


@query("delay_sensitivity", "WITH " + V.PREDICTIONS + """, d AS (SELECT h AS hours, contest_id, y, (1 + (contest_id * 31 + h) % 97) / 99.0::DOUBLE AS p
  FROM predictions, (VALUES (0), (24), (48)) v(h)),
j AS (SELECT a.hours, a.y, a.p, b.p AS p0 FROM d a JOIN d b ON b.contest_id = a.contest_id AND b.hours = 0)
SELECT hours, round(avg(""" + LL.format(p="p") + ") - avg(" + LL.format(p="p0") + """), 6) AS log_loss_change, round(avg(abs(p - p0)), 6) AS mean_abs_change FROM j WHERE hours > 0 GROUP BY hours""")
def delay_sensitivity(spark, sf_dir):
    """Change of loss and probability under delayed results."""
    hours = F.explode(F.array(*[F.lit(h) for h in (0, 24, 48)]))
    d = V.predictions(spark, sf_dir).select("contest_id", "y", hours.alias("hours"))
    d = d.withColumn("p", (1 + (F.col("contest_id") * 31 + F.col("hours")) % 97) / F.lit(99.0))
    wide = d.groupBy("contest_id", "y").pivot("hours", [0, 24, 48]).agg(F.first("p"))
    rows = wide.select("y", F.col("0").alias("p0"), F.explode(F.array(*[F.struct(F.lit(h).alias("hours"), F.col(str(h)).alias("p")) for h in (24, 48)])).alias("_d"))
    return rows.groupBy(F.col("_d.hours").alias("hours")).agg(
        (F.avg(log_loss("y", F.col("_d.p"))) - F.avg(log_loss("y", "p0"))).alias("_l"), F.avg(F.abs(F.col("_d.p") - F.col("p0"))).alias("_m")).select(
        "hours", r6("log_loss_change", F.col("_l")), r6("mean_abs_change", F.col("_m")))


CAND = """, sd AS (SELECT *, greatest(0.0::DOUBLE, p_model - 0.02::DOUBLE) AS rh, greatest(0.0::DOUBLE, 1 - p_model - 0.02::DOUBLE) AS ra FROM {src}),
ev AS (SELECT *, rh * home_odds - 1 - 0.005::DOUBLE AS eh, ra * away_odds - 1 - 0.005::DOUBLE AS ea FROM sd),
ch AS (SELECT *, CASE WHEN ea > eh THEN 'away' ELSE 'home' END AS side, greatest(eh, ea) AS ev, CASE WHEN ea > eh THEN away_odds ELSE home_odds END AS odds,
       CASE WHEN ea > eh THEN 1 - p_model ELSE p_model END AS p, CASE WHEN ea > eh THEN ra ELSE rh END AS risk, CASE WHEN ea > eh THEN away_book ELSE home_book END AS book,
       CASE WHEN ea > eh THEN 1 - y ELSE y END AS won FROM ev),
cand AS (SELECT *, CASE WHEN risk > 0 THEN (1 + 0.005::DOUBLE + 0.02::DOUBLE) / risk END AS min_odds,
         CASE WHEN odds - 1 - 0.005::DOUBLE > 0 THEN greatest(0.0::DOUBLE, ev / ((odds - 1 - 0.005::DOUBLE) * 1.005::DOUBLE)) ELSE 0 END AS kelly FROM ch),
bet AS (SELECT * FROM cand WHERE ev >= 0.02 AND kelly > 0)"""


BOOT_BODY = BOOT[:BOOT.index("\nSELECT")]
PREDICTED = V.PREDICTIONS[len(V.CONTESTS):]
# The least relative improvement, and the block length in days of both gates.
GATE_GAIN, GATE_DAYS = 0.0025, 7
SYNTHETIC = "5-LOW"

GATE_SQL = "WITH " + V.BETS + PREDICTED + CAND.format(src="bets") + f""",
pairs AS (SELECT league, CAST(floor(epoch_us(decision_at) / ({GATE_DAYS} * 86400000000)) AS BIGINT) AS block, y, p_base, p_model FROM predictions),
gain AS (WITH x AS (SELECT league, block, {LL.format(p='p_base')} - {LL.format(p='p_model')} AS v FROM pairs)"""
GATE_SQL += BOOT_BODY.format(reps=1000, least=10, **BY_LEAGUE) + """
  SELECT t.league, difference, low FROM tot t LEFT JOIN ci USING (league)),
returns AS (WITH x AS (SELECT c.league, CAST(floor(epoch_us(b.decision_at) / (7 * 86400000000)) AS BIGINT) AS block, b.odds * b.won - 1 - 0.005::DOUBLE AS v
                       FROM bet b JOIN contests c USING (contest_id))"""
GATE_SQL += BOOT_BODY.format(reps=1000, least=10, **BY_LEAGUE) + f"""
  SELECT t.league, difference AS mean_yield, low AS yield_low FROM tot t LEFT JOIN ci USING (league)),
base AS (SELECT league, avg({LL.format(p='p_base')}) AS base FROM predictions GROUP BY league)
SELECT g.league, CASE WHEN g.league = '{SYNTHETIC}' THEN 'synthetic' ELSE 'observed' END AS mode, round(difference / base, 6) AS relative_improvement,
       g.league <> '{SYNTHETIC}' AND difference / base >= {GATE_GAIN} AND low IS NOT NULL AND low > 0 AS passes,
       round(mean_yield, 6) AS mean_yield, g.league <> '{SYNTHETIC}' AND yield_low IS NOT NULL AND yield_low > 0 AS economic_evidence
FROM gain g JOIN base USING (league) LEFT JOIN returns USING (league)"""


@query("forecast_gate", GATE_SQL)
def forecast_gate(spark, sf_dir):
    """Forecast gate and economic gate (E15): improvement, its interval, and the yield interval of the bets made; what is made
    up passes neither."""
    league = V.contests(spark, sf_dir).select("contest_id", "league")
    bets = candidates(V.bets(spark, sf_dir)).where("choice.qualifies").join(league, "contest_id").select(
        "league", "decision_at", (F.col("choice.odds") * F.col("won") - 1 - 0.005).alias("return_per_stake"))
    mode = F.when(F.col("league") == SYNTHETIC, "synthetic").otherwise("observed")
    out = Gate.forecast_gates(V.predictions(spark, sf_dir), bets, ["league"], mode, least_gain=GATE_GAIN, block_days=GATE_DAYS)
    return out.select("league", "mode", r6("relative_improvement"), "passes", r6("mean_yield"), "economic_evidence")


RATE = """, rt AS (SELECT season, sum(sum(y)) OVER before / sum(count(*)) OVER before AS rate FROM predictions WHERE is_tie = 0 GROUP BY season
  WINDOW before AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lf AS (SELECT contest_id, season, decision_at, y, is_tie, 'model' AS model, p_model AS p FROM predictions UNION ALL
       SELECT contest_id, season, decision_at, y, is_tie, 'base', p_base FROM predictions UNION ALL
       SELECT contest_id, season, decision_at, y, is_tie, 'rate', rate FROM predictions JOIN rt USING (season))"""
BY_BASELINE = dict(keys="baseline,", part="PARTITION BY baseline", group="GROUP BY baseline", dkeys="d.baseline,", joink="AND ix.baseline = d.baseline")


def _advancement_sql(model: str) -> str:
    return "WITH " + V.PREDICTIONS + RATE + THREE + f""", s AS (SELECT * REPLACE (CASE model WHEN 'model' THEN '{model}' WHEN '{model}' THEN 'model' ELSE model END AS model) FROM c WHERE season IN (1998, 1999, 2000)),
f AS (SELECT season, model, avg({LL.format(p='p')}) FILTER (is_tie = 0) AS dl FROM s GROUP BY ALL),
pooled AS (SELECT model, avg({LL.format(p='p')}) FILTER (is_tie = 0) AS dl, avg(-ln(chosen)) AS three FROM s GROUP BY model),
best AS (SELECT model AS b FROM pooled WHERE model <> 'model' ORDER BY dl, model LIMIT 1),
x AS (SELECT o.model AS baseline, m.season || '-' || week(m.decision_at) AS block, {LL.format(p='p').replace('p)', 'm.p)').replace('(y', '(m.y').replace('- y', '- m.y')}
             - {LL.format(p='p').replace('p)', 'o.p)').replace('(y', '(o.y').replace('- y', '- o.y')} AS v
      FROM s m JOIN s o USING (contest_id) WHERE m.model = 'model' AND o.model <> 'model' AND m.is_tie = 0)""" + BOOT_BODY.format(reps=2000, least=10, **BY_BASELINE) + """,
folds AS (SELECT bool_and(m.dl < o.dl) AS better FROM f m JOIN f o ON o.season = m.season AND o.model = (SELECT b FROM best) WHERE m.model = 'model'),
iv AS (SELECT coalesce(bool_or(high < 0 OR low > 0), false) AS apart FROM ci WHERE baseline = (SELECT b FROM best)),
tw AS (SELECT max(three) FILTER (model = 'model') <= max(three) FILTER (model = (SELECT b FROM best)) AS ok FROM pooled)
SELECT '""" + model + """' AS candidate, CASE b WHEN '""" + model + """' THEN 'model' ELSE b END AS stronger_baseline, better AS all_folds_better, apart AS pooled_interval_excludes_zero,
       ok AS three_way_not_worse, better AND apart AND ok AS criteria_met FROM best, folds, iv, tw"""


@query("advancement_rule", " UNION ALL ".join(f"SELECT * FROM ({_advancement_sql(m)})" for m in ("model", "base", "rate")))
def advancement_rule(spark, sf_dir):
    """Whether a candidate advances (E24): all folds better than the stronger baseline, the pooled weekly interval apart from
    zero, and the three-way loss not worse. Each of three models stands for the candidate once."""
    from pyspark.sql import Window
    p = V.predictions(spark, sf_dir)
    before = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)      # one row per season
    rate = p.where("is_tie = 0").groupBy("season").agg(F.sum("y").alias("s"), F.count("*").alias("n")).select(
        "season", (F.sum("s").over(before) / F.sum("n").over(before)).alias("p_rate"))
    rows = M.long_form(p.join(rate, "season").where("season IN (1998, 1999, 2000)"), ["model", "base", "rate"])
    rows = rows.withColumn("p_tie", F.lit(0.002) + (F.col("contest_id") % 7) / F.lit(1000.0))
    names = ("base", "model", "rate")
    out = [Gate.advancement(rows, m, [b for b in names if b != m]) for m in ("model", "base", "rate")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def candidates(frame):
    return frame.withColumn("choice", P.binary_candidate("p_model")).withColumn(
        "won", F.when(F.col("choice.side") == "home", F.col("y")).otherwise(1 - F.col("y")))


@query("outlier_sensitivity", "WITH " + V.BETS + CAND.format(src="bets") + """, pl AS (SELECT account, contest_id, floor(kelly * 1000) * (odds * won - 1 - 0.005::DOUBLE) AS pnl FROM bet),
rk AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY pnl DESC, contest_id) AS rn, count(*) OVER (PARTITION BY account) AS n FROM pl)
SELECT account, CAST(max(n) AS BIGINT) AS bets, CAST(count(*) FILTER (rn > 5) AS BIGINT) AS remaining, round(sum(pnl) FILTER (rn > 5), 4) AS pnl_without_top_5 FROM rk WHERE n > 5 GROUP BY account""")
def outlier_sensitivity(spark, sf_dir):
    """Profit without the five best bets (E17, F7): totals minus a per-account top five."""
    from pyspark.sql import Window
    b = candidates(V.bets(spark, sf_dir)).where("choice.qualifies")
    pnl = F.floor(F.col("choice.kelly") * 1000) * (F.col("choice.odds") * F.col("won") - 1 - 0.005)
    b = b.select("account", "contest_id", pnl.alias("pnl"))
    total = b.groupBy("account").agg(F.count("*").alias("bets"), F.sum("pnl").alias("_t")).where("bets > 5")
    top = (b.withColumn("_rn", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("pnl"), "contest_id"))).where("_rn <= 5")
           .groupBy("account").agg(F.sum("pnl").alias("_top")))
    return total.join(top, "account").select("account", "bets", (F.col("bets") - 5).alias("remaining"), F.round(F.col("_t") - F.col("_top"), 4).alias("pnl_without_top_5"))


@query("selected_bet_scores", "WITH " + V.BETS + CAND.format(src="bets") + """
SELECT account, CAST(count(*) AS BIGINT) AS n, round(avg((p - won) * (p - won)), 6) AS brier, round(avg(-(won * ln(p) + (1 - won) * ln(1 - p))), 6) AS log_loss FROM bet GROUP BY account""")
def selected_bet_scores(spark, sf_dir):
    """Probability metrics of the chosen side on accepted candidates."""
    b = candidates(V.bets(spark, sf_dir)).where("choice.qualifies")
    return b.groupBy("account").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("choice.p") - F.col("won"), F.lit(2.0))).alias("_b"),
                                    F.avg(log_loss("won", F.col("choice.p"))).alias("_l")).select("account", "n", r6("brier", F.col("_b")), r6("log_loss", F.col("_l")))


MARKET_BETS = "WITH " + LATEST_SQL + """, mk AS (
  SELECT d.contest_id, d.decision_at, c.q * 0.9::DOUBLE + 0.08::DOUBLE AS p_model, CAST(d.contest_id % 2 AS INTEGER) AS y, o.h.o AS home_odds, o.a.o AS away_odds, o.h.b AS home_book, o.a.b AS away_book,
         lh.home_odds AS home_later, la.away_odds AS away_later
  FROM decisions d JOIN cons c USING (contest_id, decision_at) JOIN offers o USING (contest_id, decision_at)
       LEFT JOIN later lh ON lh.contest_id = d.contest_id AND lh.decision_at = d.decision_at AND lh.book = o.h.b
       LEFT JOIN later la ON la.contest_id = d.contest_id AND la.decision_at = d.decision_at AND la.book = o.a.b WHERE c.books >= 3)""" + CAND.format(src="mk")


@query("delayed_price_report", MARKET_BETS + """, lt AS (SELECT *, CASE WHEN side = 'home' THEN home_later ELSE away_later END AS price FROM bet)
SELECT CAST(count(*) AS BIGINT) AS bets, CAST(count(price) AS BIGINT) AS observed_later, CAST(count(*) FILTER (price >= min_odds) AS BIGINT) AS clears_floor,
       round(avg(price * won - 1 - 0.005::DOUBLE) FILTER (price >= min_odds), 6) AS flat_yield FROM lt""")
def delayed_price_report(spark, sf_dir):
    """Would the later price still clear the floor, and what would it have paid."""
    m = market_rows(spark, sf_dir).where("q IS NOT NULL AND home_odds IS NOT NULL AND away_odds IS NOT NULL")
    m = m.withColumn("p_model", F.col("q") * 0.9 + 0.08).withColumn("y", (F.col("contest_id") % 2).cast("int"))
    b = candidates(m).where("choice.qualifies")
    price = F.when(F.col("choice.side") == "home", F.col("home_later")).otherwise(F.col("away_later"))
    ok = price >= F.col("choice.min_odds")
    return b.agg(F.count("*").alias("bets"), F.count(price).alias("observed_later"), F.count_if(F.coalesce(ok, F.lit(False))).alias("clears_floor"),
                 F.round(F.avg(F.when(ok, price * F.col("won") - 1 - 0.005)), 6).alias("flat_yield"))


@query("collection_rollup", """
WITH polls AS (SELECT date_trunc('day', ts) AS poll, count(*) AS targeted, count(*) FILTER (event_type <> 'error') AS matched, count(*) FILTER (event_type = 'error') AS quarantined,
    CASE WHEN count(*) % 5 <> 0 THEN 100000 - max(event_id) END AS credits FROM events GROUP BY ALL)
SELECT CAST(count(*) AS BIGINT) AS executed, round(count(*) / 40.0, 4) AS completion_rate, CAST(sum(matched) AS BIGINT) AS matched, round(sum(matched) / greatest(1, sum(targeted)), 4) AS match_rate,
       CAST(sum(quarantined) AS BIGINT) AS quarantined, CAST(arg_max(credits, poll) FILTER (credits IS NOT NULL) AS BIGINT) AS latest_credits FROM polls""")
def collection_rollup(spark, sf_dir):
    """Completion and match rates, last known credits."""
    e = V.table(spark, sf_dir, "events")
    err = F.count_if(F.col("event_type") == "error")
    polls = e.groupBy(F.date_trunc("day", "ts").alias("poll")).agg(
        F.count("*").alias("targeted"), (F.count("*") - err).alias("matched"), err.alias("quarantined"),
        F.when(F.count("*") % 5 != 0, 100000 - F.max("event_id")).alias("credits"))
    return polls.agg(F.count("*").alias("executed"), F.round(F.count("*") / F.lit(40.0), 4).alias("completion_rate"), F.sum("matched").alias("matched"),
                     F.round(F.sum("matched") / F.greatest(F.lit(1), F.sum("targeted")), 4).alias("match_rate"), F.sum("quarantined").alias("quarantined"),
                     F.max_by("credits", F.when(F.col("credits").isNotNull(), F.col("poll"))).alias("latest_credits"))


@query("coverage_status", "WITH " + V.CONTESTS + """, s AS (SELECT *, decision_at < TIMESTAMP '2000-01-01' AS past, contest_id % 10 <> 3 AS recorded FROM contests)
SELECT league, CAST(count(*) FILTER (past) AS BIGINT) AS past_cutoffs, CAST(count(*) FILTER (past AND recorded) AS BIGINT) AS recorded,
       CAST(count(*) FILTER (past AND NOT recorded) AS BIGINT) AS missed, min(decision_at) FILTER (NOT past) AS next_cutoff FROM s GROUP BY league""")
def coverage_status(spark, sf_dir):
    """Past cutoffs with and without a record, next cutoff."""
    c = V.contests(spark, sf_dir)
    rec = c.where("contest_id % 10 <> 3").select("contest_id", F.lit(True).alias("rec"))
    past = F.col("decision_at") < F.lit("2000-01-01").cast("timestamp_ntz")
    j = c.select("contest_id", "league", "decision_at").join(rec, "contest_id", "left")
    return j.groupBy("league").agg(F.count_if(past).alias("past_cutoffs"), F.count_if(past & F.col("rec").isNotNull()).alias("recorded"),
                                   F.count_if(past & F.col("rec").isNull()).alias("missed"), F.min(F.when(~past, F.col("decision_at"))).alias("next_cutoff"))


@query("settlement_report", "WITH " + LONG + """, st AS (SELECT *, contest_id % 3 <> 0 AS covered FROM lf WHERE contest_id % 7 <> 0 AND contest_id % 19 <> 0 AND is_tie = 0),
v AS (SELECT 'all' AS part, * FROM st UNION ALL SELECT 'covered', * FROM st WHERE covered)
SELECT part, model, """ + SCORES + " FROM v GROUP BY ALL")
def settlement_report(spark, sf_dir):
    """Metrics of settled records, all and covered only."""
    from knowntime.operators.merge import settle_records
    c = V.contests(spark, sf_dir).withColumnRenamed("contest_id", "game_id")
    rec = long(spark, sf_dir).select(F.col("contest_id").alias("game_id"), "model", "p", (F.col("contest_id") % 3 != 0).alias("covered"))
    s = settle_records(rec, c.where("game_id % 19 <> 0"), c.where("game_id % 7 <> 0")).where("status = 'settled' AND outcome <> 'tie'")
    s = s.withColumn("y", (F.col("outcome") == "home").cast("int"))
    both = s.withColumn("part", F.explode(F.when(F.col("covered"), F.array(F.lit("all"), F.lit("covered"))).otherwise(F.array(F.lit("all")))))
    return rounded(M.score(both, ["part", "model"]), ["part", "model"])


CONTRAST_SQL = ("WITH " + V.PREDICTIONS + """, st AS (SELECT *, contest_id % 3 <> 0 AS covered FROM predictions WHERE contest_id % 7 <> 0 AND contest_id % 19 <> 0 AND is_tie = 0),
pt AS (SELECT 'all' AS league, * EXCLUDE (league) FROM st UNION ALL SELECT 'covered', * EXCLUDE (league) FROM st WHERE covered),"""
                + f" x AS (SELECT league, CAST(floor(epoch_us(decision_at) / (7 * 86400000000)) AS BIGINT) AS block, {DIFF} FROM pt)"
                + BOOT.format(reps=2000, least=10, **BY_LEAGUE))


@query("settlement_contrasts", CONTRAST_SQL.replace("SELECT t.league, CAST(blocks", "SELECT t.league AS part, CAST(blocks"))
def settlement_contrasts(spark, sf_dir):
    """Model minus baseline over settled records, all and covered only, weekly blocks."""
    from knowntime.operators.merge import settle_records
    c = V.contests(spark, sf_dir).withColumnRenamed("contest_id", "game_id")
    rec = V.predictions(spark, sf_dir).select(F.col("contest_id").alias("game_id"), "decision_at", "p_model", "p_base",
                                              (F.col("contest_id") % 3 != 0).alias("covered"))
    s = settle_records(rec, c.where("game_id % 19 <> 0"), c.where("game_id % 7 <> 0")).where("status = 'settled' AND outcome <> 'tie'")
    parts = F.when(F.col("covered"), F.array(F.lit("all"), F.lit("covered"))).otherwise(F.array(F.lit("all")))
    s = (s.withColumn("y", (F.col("outcome") == "home").cast("int")).withColumn("part", F.explode(parts))
         .withColumn("block", epoch_block("decision_at", 7)))
    out = B.bootstrap_interval(B.block_sums(s, ["part"], M.paired_difference("y", "p_model", "p_base", 1e-9)), ["part"], reps=2000, min_blocks=10)
    return out.select("part", "blocks", r6("difference"), r6("low"), r6("high"))


@query("source_archive_health", """
SELECT CAST(count(*) FILTER (event_id % 4 < 3) AS BIGINT) AS captured, CAST(count(*) FILTER (event_id % 4 < 3 AND ts >= TIMESTAMP '2024-01-29 00:00:00') AS BIGINT) AS eligible_last_48h,
       max(ts) FILTER (event_id % 4 < 3) AS latest_retrieved_at FROM events""")
def source_archive_health(spark, sf_dir):
    """Captured files, those of the last 48 hours, latest retrieval."""
    e, own = V.table(spark, sf_dir, "events"), F.col("event_id") % 4 < 3
    recent = F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return e.agg(F.count_if(own).alias("captured"), F.count_if(own & recent).alias("eligible_last_48h"), F.max(F.when(own, F.col("ts"))).alias("latest_retrieved_at"))


@query("value_counts", "SELECT o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY ALL")
def value_counts(spark, sf_dir):
    """Counts and distinct counts."""
    return V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("penalty_argmin", """
WITH t AS (SELECT league, l2, round(avg(abs(m - l2 * 100)), 3) AS loss FROM (SELECT o_orderpriority AS league, o_orderkey % 10 AS m FROM orders), (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE)) v(l2) GROUP BY ALL)
SELECT league, arg_min(l2, struct_pack(a := loss, b := -l2)) AS l2 FROM t GROUP BY league""")
def penalty_argmin(spark, sf_dir):
    """Arg-min with ties to the stronger penalty."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("league"), (F.col("o_orderkey") % 10).alias("m"))
    t = o.withColumn("l2", F.explode(F.array(*[F.lit(x) for x in (0.001, 0.01, 0.1, 1.0)]))).groupBy("league", "l2").agg(
        F.round(F.avg(F.abs(F.col("m") - F.col("l2") * 100)), 3).alias("loss"))
    return t.groupBy("league").agg(F.min_by("l2", F.struct("loss", -F.col("l2"))).alias("l2"))
