"""Registered queries: status reports, player impact, expected starters, report text, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.catalog.features import r6
from knowntime.catalog.registry import query
from knowntime.functions import text as X
from knowntime.functions.times import shift, utc_to_local
from knowntime.operators import availability as A, starter as P
from knowntime.operators.form import home_minus_away
from knowntime.sources import report_text as R

# A report belongs to one game: the team may play another on the same day.
KEYS = ["team_id", "game_day", "home_id", "away_id"]
# The stand-in files reports on the game's own day, so "stale" is hours here (48 by default).
STALE_HOURS = 4


def dated_reports(spark, sf_dir):
    r = V.reports(spark, sf_dir)
    return r.withColumn("game_day", utc_to_local("report_at").cast("date"))


def game_sides(spark, sf_dir):
    g = V.report_games(spark, sf_dir)
    side = F.array(F.struct(F.lit("home").alias("side"), F.col("home_id").alias("team_id")),
                   F.struct(F.lit("away").alias("side"), F.col("away_id").alias("team_id")))
    return (g.withColumn("game_day", utc_to_local("scheduled_at").cast("date"))
            .withColumn("_s", F.explode(side)).select("game_id", "decision_at", "game_day", "home_id", "away_id", "_s.*"))


def states(spark, sf_dir):
    r = dated_reports(spark, sf_dir)
    return A.snapshot_states(game_sides(spark, sf_dir), A.snapshots(r, KEYS), KEYS, max_age_hours=STALE_HOURS)


# January and February only, so Eastern time is UTC - 5 in the checking SQL.
STATES_SQL = V.REPORTS + ", " + V.REPORT_GAMES + """, rep AS (SELECT *, CAST(report_at - INTERVAL 5 HOUR AS DATE) AS game_day FROM reports),
gs AS (SELECT game_id, decision_at, CAST(scheduled_at - INTERVAL 5 HOUR AS DATE) AS game_day, home_id, away_id, 'home' AS side, home_id AS team_id FROM report_games
       UNION ALL SELECT game_id, decision_at, CAST(scheduled_at - INTERVAL 5 HOUR AS DATE), home_id, away_id, 'away', away_id FROM report_games),
pick AS (SELECT g.*, (SELECT max(r.report_at) FROM rep r WHERE r.team_id = g.team_id AND r.game_day = g.game_day AND r.home_id = g.home_id AND r.away_id = g.away_id AND r.report_at < g.decision_at) AS snapshot_at FROM gs g),
per AS (SELECT team_id, game_day, home_id, away_id, report_at, count(DISTINCT source) AS files, count(player_id) > count(DISTINCT player_id) AS dup,
        count(*) FILTER (status = 'NotSubmitted') > 0 AS ns, count(*) FILTER (status = 'Out') AS o, count(*) FILTER (status = 'Doubtful') AS d,
        count(*) FILTER (status = 'Questionable') AS q, count(*) FILTER (status = 'Probable') AS p, count(*) FILTER (status = 'Available') AS a
        FROM rep GROUP BY ALL),
st AS (SELECT k.*, x.o, x.d, x.q, x.p, x.a, (epoch_us(k.decision_at) - epoch_us(k.snapshot_at)) / 3600000000.0::DOUBLE AS age_hours,
       CASE WHEN k.snapshot_at IS NULL THEN 'missing' WHEN x.files > 1 OR x.dup THEN 'invalid'
            WHEN (epoch_us(k.decision_at) - epoch_us(k.snapshot_at)) > 4 * 3600000000 THEN 'stale' WHEN x.ns THEN 'not_submitted' ELSE 'usable' END AS state
       FROM pick k LEFT JOIN per x ON x.team_id = k.team_id AND x.game_day = k.game_day AND x.home_id = k.home_id AND x.away_id = k.away_id AND x.report_at = k.snapshot_at),
cnt AS (SELECT game_id, decision_at, game_day, home_id, away_id, side, team_id, snapshot_at, age_hours, state,
        CAST(CASE WHEN state = 'usable' THEN o ELSE 0 END AS BIGINT) AS "out", CAST(CASE WHEN state = 'usable' THEN d ELSE 0 END AS BIGINT) AS doubtful,
        CAST(CASE WHEN state = 'usable' THEN q ELSE 0 END AS BIGINT) AS questionable, CAST(CASE WHEN state = 'usable' THEN p ELSE 0 END AS BIGINT) AS probable,
        CAST(CASE WHEN state = 'usable' THEN a ELSE 0 END AS BIGINT) AS available, CAST(state = 'not_submitted' AS BIGINT) AS notsubmitted FROM st)"""


@query("status_snapshot_states", "WITH " + STATES_SQL + """
SELECT game_id, side, snapshot_at, round(age_hours, 6) AS age_hours, state, "out", doubtful, questionable, probable, available, notsubmitted FROM cnt""")
def status_snapshot_states(spark, sf_dir):
    """Latest snapshot per game and side with state and counts."""
    return states(spark, sf_dir).select("game_id", "side", "snapshot_at", r6("age_hours"), "state", *A.COUNTS, "notsubmitted")


@query("availability_features", "WITH " + STATES_SQL + """
SELECT h.game_id, h."out" - a."out" AS out_diff, h.doubtful - a.doubtful AS doubtful_diff, h.questionable - a.questionable AS questionable_diff,
       h.probable - a.probable AS probable_diff, h.notsubmitted - a.notsubmitted AS not_submitted_diff,
       CAST(h.state = 'usable' AND a.state = 'usable' AS INTEGER) AS availability_covered,
       """ + ", ".join(f"CAST({s}.state = '{st}' AS INTEGER) AS {side}_{st}" for s, side in (("h", "home"), ("a", "away"))
                      for st in A.STATES) + " FROM cnt h JOIN cnt a ON a.game_id = h.game_id AND a.side = 'away' WHERE h.side = 'home'")
def availability_features(spark, sf_dir):
    """Count differences, coverage and state flags."""
    return A.availability_features(states(spark, sf_dir))


@query("status_state_counts", "WITH " + STATES_SQL + " SELECT side, state, CAST(count(*) AS BIGINT) AS n FROM cnt GROUP BY ALL")
def status_state_counts(spark, sf_dir):
    """States per side."""
    return states(spark, sf_dir).groupBy("side", "state").agg(F.count("*").alias("n"))


def player_logs(spark, sf_dir):
    """Player lines per contest; result times moved forward to overlap the status reports."""
    li = V.table(spark, sf_dir, "lineitem")
    c = V.contests(spark, sf_dir).select("contest_id", shift("available_at", days=8600).alias("available_at"))
    k = F.col("l_partkey") % 300
    per = li.groupBy(F.col("l_orderkey").alias("contest_id"), k.alias("player_id")).agg(
        F.sum("l_quantity").alias("minutes"), F.sum(F.floor("l_quantity") % 7).cast("double").alias("points"))
    return per.join(c, "contest_id").withColumn("team_id", F.col("player_id") % 30).withColumn("log_id", F.col("contest_id"))


LOGS_SQL = V.CONTESTS + """, logs AS (
  SELECT l.*, l.player_id % 30 AS team_id, c.available_at + INTERVAL 8600 DAY AS available_at FROM (
    SELECT l_orderkey AS contest_id, l_partkey % 300 AS player_id, sum(l_quantity) AS minutes, CAST(sum(floor(l_quantity) % 7) AS DOUBLE) AS points
    FROM lineitem GROUP BY ALL) l JOIN contests c USING (contest_id))"""


def listed_with_prior(spark, sf_dir):
    listed = A.listed_players(states(spark, sf_dir), dated_reports(spark, sf_dir), KEYS)
    listed = listed.select("game_id", "side", "team_id", "player_id", "status", "decision_at")
    logs = player_logs(spark, sf_dir)
    return A.player_prior(logs, listed, ["team_id", "player_id"])


IMPACT_SQL = "WITH " + LOGS_SQL + ", " + STATES_SQL + """, listed AS (
  SELECT c.game_id, c.side, c.team_id, r.player_id, r.status, c.decision_at, r.row_id FROM cnt c JOIN rep r ON r.team_id = c.team_id AND r.game_day = c.game_day AND r.home_id = c.home_id AND r.away_id = c.away_id
         AND r.report_at = c.snapshot_at WHERE c.state = 'usable' AND r.status IN ('Out', 'Doubtful', 'Questionable', 'Probable') AND r.player_id IS NOT NULL),
need AS (SELECT DISTINCT team_id, player_id, decision_at FROM listed),
prior AS (SELECT team_id, player_id, decision_at, avg(minutes) AS m, avg(points) AS pts FROM (
    SELECT n.*, l.minutes, l.points, row_number() OVER (PARTITION BY n.team_id, n.player_id, n.decision_at ORDER BY l.available_at DESC, l.contest_id DESC) AS rn
    FROM need n JOIN logs l ON l.team_id = n.team_id AND l.player_id = n.player_id AND l.available_at < n.decision_at) WHERE rn <= 10 GROUP BY ALL),
lp AS (SELECT l.*, CASE WHEN l.side = 'home' THEN 1 ELSE -1 END AS sgn, p.m, p.pts FROM listed l LEFT JOIN prior p USING (team_id, player_id, decision_at))"""


@query("player_prior_means", IMPACT_SQL + """
SELECT game_id, side, player_id, status, round(m, 6) AS prior_minutes, round(pts, 6) AS prior_points FROM lp""")
def player_prior_means(spark, sf_dir):
    """Last-10 means of every listed player before the decision."""
    return listed_with_prior(spark, sf_dir).select("game_id", "side", "player_id", "status", r6("prior_minutes"), r6("prior_points"))


@query("impact_features", IMPACT_SQL + """
SELECT g.game_id, """ + ", ".join(f"round(coalesce(sum(sgn * m) FILTER (status = '{s}' AND m IS NOT NULL), 0), 6) AS {s.lower()}_minutes_diff"
                                  for s in A.WEIGHTED) + """,
       round(coalesce(sum(sgn * pts) FILTER (status = 'Out' AND m IS NOT NULL), 0), 6) AS out_points_diff,
       CAST(coalesce(sum(sgn) FILTER (l.game_id IS NOT NULL AND m IS NULL), 0) AS BIGINT) AS unmatched_listed_diff
FROM report_games g LEFT JOIN lp l ON l.game_id = g.game_id GROUP BY g.game_id""")
def impact_features(spark, sf_dir):
    """Prior minutes by declared status, home minus away."""
    out = A.impact_features(V.report_games(spark, sf_dir), listed_with_prior(spark, sf_dir))
    return out.select("game_id", *[r6(f"{s.lower()}_minutes_diff") for s in A.WEIGHTED], r6("out_points_diff"), "unmatched_listed_diff")


@query("listed_match_rate", IMPACT_SQL + """
SELECT CAST(count(m) AS BIGINT) AS matched, CAST(count(*) - count(m) AS BIGINT) AS unmatched, round(count(m) / greatest(count(*), 1), 6) AS match_rate FROM lp""")
def listed_match_rate(spark, sf_dir):
    """Share of listed players with a history."""
    return A.match_rate(listed_with_prior(spark, sf_dir)).select("matched", "unmatched", r6("match_rate"))


def raw_report_rows(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    k, t = F.col("event_id"), F.col("user_id") % 25
    opp = (t + 1 + k % 24) % 25
    name = lambda i: F.when(k % 3 == 0, F.concat(F.lit("NATION _"), i)).when(k % 3 == 1, F.concat(F.lit("NATION_"), i)).otherwise(F.concat(F.lit("N"), i))
    code = lambda i: F.concat(F.lit("N"), i)
    team = F.when(k % 53 == 0, "Unknown Club").when(k % 47 == 0, code((t + 2) % 25)).otherwise(name(t))
    matchup = F.when(k % 59 == 0, code(t)).otherwise(F.concat(code(opp), F.lit("@"), code(t)))
    return e.select(k.alias("row_id"), team.alias("team"), matchup.alias("matchup"),
                    F.when(k % 61 == 0, "13/45/2024").otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("game_date"),
                    F.when(k % 67 != 0, F.col("ts")).alias("report_at"), F.when(k % 71 == 0, "Unsure").otherwise("Out").alias("status"))


def club_aliases(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    return A.alias_lookup(n.select(F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_nationkey").alias("team_id")))


REASON_SQL = """ident AS (
  SELECT event_id AS row_id, CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 47 = 0 THEN CAST((user_id % 25 + 2) % 25 AS INTEGER) ELSE CAST(user_id % 25 AS INTEGER) END AS team_id,
         user_id % 25 AS h, (user_id % 25 + 1 + event_id % 24) % 25 AS a, event_id AS k FROM events),
judged AS (SELECT row_id, team_id, CASE WHEN team_id IS NULL THEN 'unmapped team' WHEN k % 61 = 0 THEN 'invalid date' WHEN k % 59 = 0 THEN 'invalid matchup'
       WHEN k % 67 = 0 THEN 'missing report time' WHEN team_id <> h AND team_id <> a THEN 'team not in matchup' WHEN k % 71 = 0 THEN 'unknown status' END AS reason FROM ident)"""


@query("report_identity", "WITH " + REASON_SQL + " SELECT row_id, team_id, reason FROM judged")
def report_identity(spark, sf_dir):
    """Alias lookup and rejected rows with reasons."""
    return A.identify_reports(raw_report_rows(spark, sf_dir), club_aliases(spark, sf_dir)).select("row_id", "team_id", "reason")


@query("rejected_report_counts", "WITH " + REASON_SQL + " SELECT coalesce(reason, 'usable') AS reason, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY ALL")
def rejected_report_counts(spark, sf_dir):
    """Usable and rejected report rows by reason."""
    rows = A.identify_reports(raw_report_rows(spark, sf_dir), club_aliases(spark, sf_dir))
    return rows.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


def weekly_stats(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.year("l_shipdate").alias("season"), F.weekofyear("l_shipdate").alias("week"), (F.col("l_suppkey") % 30).alias("team"),
                      (F.col("l_partkey") % 40).alias("player_id")).agg(
        F.sum("l_quantity").alias("attempts"), (F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)) / 70710.67811865476).alias("epa"))


WEEKLY_SQL = """weekly AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS season, CAST(week(l_shipdate) AS INTEGER) AS week, l_suppkey % 30 AS team, l_partkey % 40 AS player_id,
         sum(l_quantity) AS attempts, sum(l_extendedprice * (l_discount - 0.05::DOUBLE)) / 70710.67811865476::DOUBLE AS epa FROM lineitem GROUP BY ALL),
prim AS (SELECT season, week, team, arg_max(player_id, struct_pack(a := attempts, b := -player_id)) AS primary_id,
         arg_max(epa, struct_pack(a := attempts, b := -player_id)) AS primary_epa FROM weekly GROUP BY ALL)"""


@query("weekly_primary", "WITH " + WEEKLY_SQL + " SELECT season, week, team, primary_id, round(primary_epa, 6) AS primary_epa FROM prim")
def weekly_primary(spark, sf_dir):
    """Most used player per season, week and team."""
    return P.weekly_primary(weekly_stats(spark, sf_dir)).select("season", "week", "team", "primary_id", r6("primary_epa"))


def starter_sides(spark, sf_dir):
    s = V.sides(V.contests(spark, sf_dir)).withColumn("week", F.weekofyear("scheduled_at"))
    return s.withColumn("starter_id", F.when(F.col("contest_id") % 3 == 1, (F.col("contest_id") * 7 + F.col("team")) % 40))


def starter_rows(spark, sf_dir):
    s = starter_sides(spark, sf_dir)
    starts = P.actual_starts(s, P.weekly_primary(weekly_stats(spark, sf_dir)))
    return P.expected_starter(starts, s.select("contest_id", "side", "team", "decision_at"))


STARTER_SQL = "WITH " + V.SIDES + ", " + WEEKLY_SQL + """, st0 AS (
  SELECT s.*, CASE WHEN s.contest_id % 3 = 1 THEN (s.contest_id * 7 + s.team) % 40 ELSE p.primary_id END AS starter, p.primary_id, p.primary_epa,
         CASE WHEN s.side = 'home' THEN 0 ELSE 1 END AS seq
  FROM sides s LEFT JOIN prim p ON p.season = s.season AND p.week = week(s.scheduled_at) AND p.team = s.team),
st AS (SELECT *, CASE WHEN primary_id = starter THEN primary_epa END AS epa, row_number() OVER (ORDER BY available_at, contest_id, seq) AS ord
       FROM st0 WHERE starter IS NOT NULL),
ex AS (SELECT p.contest_id, p.side, p.team, p.decision_at, arg_max(s.starter, s.ord) AS expected
       FROM sides p LEFT JOIN st s ON s.team = p.team AND s.available_at < p.decision_at GROUP BY ALL),
ep AS (SELECT contest_id, side, avg(epa) AS epa FROM (
         SELECT e.contest_id, e.side, s.epa, row_number() OVER (PARTITION BY e.contest_id, e.side ORDER BY s.ord DESC) AS rn
         FROM ex e JOIN st s ON s.starter = e.expected AND s.epa IS NOT NULL AND s.available_at < e.decision_at) WHERE rn <= 8 GROUP BY ALL),
sc AS (SELECT e.contest_id, e.side, count(*) AS starts FROM ex e JOIN st s ON s.starter = e.expected AND s.available_at < e.decision_at GROUP BY ALL),
mu AS (SELECT contest_id, side, arg_max(starter, struct_pack(n := n, f := -f)) AS used FROM (
         SELECT e.contest_id, e.side, s.starter, count(*) AS n, min(s.ord) AS f FROM ex e JOIN st s ON s.team = e.team AND s.available_at < e.decision_at GROUP BY ALL) GROUP BY ALL),
v AS (SELECT e.contest_id, e.side, coalesce(ep.epa, 0) AS epa, CASE WHEN ep.epa IS NULL THEN 0 ELSE sc.starts END::DOUBLE AS starts,
      CAST(ep.epa IS NULL AS DOUBLE) AS unknown, CAST(ep.epa IS NOT NULL AND e.expected <> mu.used AS DOUBLE) AS backup
      FROM ex e LEFT JOIN ep USING (contest_id, side) LEFT JOIN sc USING (contest_id, side) LEFT JOIN mu USING (contest_id, side))
SELECT h.contest_id, round(h.epa - a.epa, 6) AS qb_epa_diff, h.starts - a.starts AS qb_starts_diff, h.unknown - a.unknown AS qb_unknown_diff,
       coalesce(h.backup, 0) - coalesce(a.backup, 0) AS qb_backup_diff FROM v h JOIN v a ON a.contest_id = h.contest_id AND a.side = 'away' WHERE h.side = 'home'"""


@query("expected_starter_features", STARTER_SQL)
def expected_starter_features(spark, sf_dir):
    """Expected starter's form, use, unknown and backup flags, home minus away."""
    wide = home_minus_away(starter_rows(spark, sf_dir), ["contest_id"], {n: F.col(n) for n in ("epa", "starts", "unknown", "backup")})
    d = lambda n: F.col(f"{n}_home") - F.col(f"{n}_away")
    return wide.select("contest_id", r6("qb_epa_diff", d("epa")), d("starts").alias("qb_starts_diff"),
                       d("unknown").alias("qb_unknown_diff"), d("backup").alias("qb_backup_diff"))


def report_documents(spark, sf_dir):
    """Report texts, one per event, with page breaks, carried headers and unfiled teams."""
    e = V.spread(V.table(spark, sf_dir, "events").select("event_id", "ts"))
    k = F.col("event_id")
    team = lambda i: F.element_at(F.array(*[F.lit(t) for t in R.TEAMS[:30]]), (i % 30 + 1).cast("int"))
    date = F.date_format("ts", "MM/dd/yyyy")
    status = F.element_at(F.array(*[F.lit(s) for s in R.STATUSES]), (k % 5 + 1).cast("int"))
    first = F.concat(date, F.lit(" 07:00 (ET) AAA@BBB "), F.when(k % 2 == 0, team(k)).otherwise(F.replace(team(k), F.lit(" "), F.lit(""))),
                     F.lit(" Hollis Jr., Player"), k, F.lit(" "), status, F.lit(" Injury/Illness - Knee; Sprain"))
    lines = F.array(
        F.when(k % 17 != 0, F.concat(F.lit("Injury Report: "), F.date_format("ts", "MM/dd/yy hh:mm a"))).otherwise("no header"),
        F.lit("Game Date Game Time Matchup Team Player Name Current Status Reason"),
        F.when(k % 13 != 0, first).otherwise("nothing here"),
        F.lit("Page 1 of 2"), F.lit(""), F.lit("  Second,Also Doubtful Rest"),
        F.concat(F.lit("10:00(ET) CCC@DDD")), F.lit("Lost, Without Team Out x"),
        F.when(k % 13 != 0, F.concat(team(k + 7), F.lit(" NOT YET SUBMITTED"))).otherwise("also nothing"),
        F.lit("CCC@DDD Third, One Probable y"), F.lit("Just words"))
    return e.select(k.alias("doc_id"), F.array_join(lines, "\n").alias("text"), F.col("ts"))


TEAM_LIST = "[" + ", ".join("'" + t.replace(" ", "") + "'" for t in R.TEAMS[:30]) + "]"
STATUS_LIST = "[" + ", ".join(f"'{s}'" for s in R.STATUSES) + "]"
PARSED_SQL = f"""parsed AS (
  SELECT event_id AS doc_id, 2 AS line_no, strftime(ts, '%m/%d/%Y') AS game_date, '07:00' AS game_time, 'AAA@BBB' AS matchup,
         {TEAM_LIST}[event_id % 30 + 1] AS team, 'Hollis Jr., Player' || event_id AS player, {STATUS_LIST}[event_id % 5 + 1] AS status
  FROM events WHERE event_id % 13 <> 0
  UNION ALL SELECT event_id, 5, strftime(ts, '%m/%d/%Y'), '07:00', 'AAA@BBB', {TEAM_LIST}[event_id % 30 + 1], 'Second,Also', 'Doubtful' FROM events WHERE event_id % 13 <> 0
  UNION ALL SELECT event_id, 8, strftime(ts, '%m/%d/%Y'), '10:00', 'CCC@DDD', {TEAM_LIST}[(event_id + 7) % 30 + 1], NULL, 'NotSubmitted' FROM events WHERE event_id % 13 <> 0
  UNION ALL SELECT event_id, 9, strftime(ts, '%m/%d/%Y'), '10:00', 'CCC@DDD', {TEAM_LIST}[(event_id + 7) % 30 + 1], 'Third, One', 'Probable' FROM events WHERE event_id % 13 <> 0)"""


@query("report_text_rows", "WITH " + PARSED_SQL + " SELECT * FROM parsed")
def report_text_rows(spark, sf_dir):
    """Report lines with carried headers to status rows."""
    return R.parse_reports(report_documents(spark, sf_dir), "doc_id")


@query("report_header_time", """
SELECT event_id AS doc_id, CASE WHEN event_id % 17 <> 0 THEN date_trunc('minute', ts) + INTERVAL 5 HOUR END AS report_at FROM events""")
def report_header_time(spark, sf_dir):
    """Eastern header time to UTC; missing headers give NULL (H2)."""
    return report_documents(spark, sf_dir).select("doc_id", R.report_time("text").alias("report_at"))


@query("report_parse_audit", """
SELECT CASE WHEN event_id % 17 = 0 THEN 'failed: no report time' WHEN event_id % 13 = 0 THEN 'failed: no rows' ELSE 'parsed' END AS outcome,
       CAST(count(*) AS BIGINT) AS documents, CAST(sum(CASE WHEN event_id % 13 <> 0 THEN 4 ELSE 0 END) AS BIGINT) AS rows FROM events GROUP BY ALL""")
def report_parse_audit(spark, sf_dir):
    """Parsed, empty and failed documents (H3)."""
    docs = report_documents(spark, sf_dir)
    return R.parse_audit(docs, R.parse_reports(docs, "doc_id"), "doc_id").groupBy("outcome").agg(
        F.count("*").alias("documents"), F.sum("rows").alias("rows"))


@query("document_line_scan", """
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT d.doc_id, CAST(count(l.line) FILTER (l.line <> '') AS BIGINT) AS lines, CAST(0 AS BIGINT) AS rows, 'failed: no report time' AS outcome
FROM documents d JOIN l USING (doc_id) GROUP BY d.doc_id""")
def document_line_scan(spark, sf_dir):
    """The parser over whole documents that are no reports: nothing is invented (H1, H3)."""
    docs = V.spread(V.table(spark, sf_dir, "documents").select("doc_id", "text"))
    audit = R.parse_audit(docs, R.parse_reports(docs, "doc_id"), "doc_id")
    n = docs.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("lines"))
    return audit.join(n, "doc_id").select("doc_id", "lines", "rows", "outcome")


@query("person_name_keys", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'marcus ' || c_custkey || ' hollis jr' WHEN 1 THEN 'tomas riha ' || c_custkey
       ELSE 'jose o neal smith ' || c_custkey END AS person FROM customer""")
def person_name_keys(spark, sf_dir):
    """Names in both orders, with accents and punctuation, to one key (G: names)."""
    c, k = V.table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = (F.when(k % 3 == 0, F.concat(F.lit("Hollis Jr., Marcus "), k)).when(k % 3 == 1, F.concat(F.lit(" Tomáš  Říha "), k))
            .otherwise(F.concat(F.lit("José O'Neal-Smith "), k)))
    return c.select("c_custkey", X.person_key(name).alias("person"))
