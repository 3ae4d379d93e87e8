"""Report text, names, time zones, files, availability fixtures."""

import datetime as dt
import json
import tempfile
import unicodedata

import pytest
from pyspark.sql import functions as F, types as T

from knowntime.functions import text as X, times
from knowntime.operators import availability as A
from knowntime.sources import adapters as D, report_text as R, tables as S

WIDE = ["Injury Report: 02/03/21 01:15 PM", "Game Date Game Time Matchup Team Player Name Current Status Reason",
        "02/03/2021 09:30 (ET) UTA@MIA Miami Heat Alder, Finn Questionable sore ankle", "Utah Jazz Birch, Omar Doubtful illness",
        "Cedar Sr., Leon Available back in training", "11:30 (ET) DEN@PHX Denver Nuggets NOT YET SUBMITTED", "Page 2 of 3"]
TIGHT = ["Injury Report: 07/09/24 01:15 AM", "07/09/2024 08:00(ET) BOS@NYK NewYorkKnicks Dogwood,Ivan Out Knee-Sprain",
         "Elm,Jonas Probable Hand", "Page2of3", "BostonCeltics Fir,Abel Doubtful Rest",
         "CHI@DET", "Gorse, Absent Out no team yet", "ChicagoBulls Hazel,Theo Out Foot"]


def test_both_report_layouts(spark):
    docs = spark.createDataFrame([("a", "\n".join(WIDE)), ("b", "\n".join(TIGHT)), ("c", "no report")], "doc string, text string")
    rows = R.parse_reports(docs, "doc").orderBy("doc", "line_no").collect()
    got = [(r["doc"], r["matchup"], r["team"], r["player"], r["status"]) for r in rows]
    assert got == [
        ("a", "UTA@MIA", "MiamiHeat", "Alder, Finn", "Questionable"), ("a", "UTA@MIA", "UtahJazz", "Birch, Omar", "Doubtful"),
        ("a", "UTA@MIA", "UtahJazz", "Cedar Sr., Leon", "Available"), ("a", "DEN@PHX", "DenverNuggets", None, "NotSubmitted"),
        ("b", "BOS@NYK", "NewYorkKnicks", "Dogwood,Ivan", "Out"), ("b", "BOS@NYK", "NewYorkKnicks", "Elm,Jonas", "Probable"),
        ("b", "BOS@NYK", "BostonCeltics", "Fir,Abel", "Doubtful"), ("b", "CHI@DET", "ChicagoBulls", "Hazel,Theo", "Out")]
    assert [(r["game_date"], r["game_time"]) for r in rows if r["doc"] == "a"][-1] == ("02/03/2021", "11:30")
    seen = {r["doc"]: r["t"] for r in docs.select("doc", R.report_time("text").alias("t")).collect()}
    assert seen == {"a": dt.datetime(2021, 2, 3, 18, 15), "b": dt.datetime(2024, 7, 9, 5, 15), "c": None}


def test_name_keys_match_unicode_decomposition(spark):
    names = ["Hollis Jr., Marcus", "van Ås, Peer", "Říha, Tomáš", "Marcus Hollis Jr.", "O’Dell, Sam", "Ñíguez-Pérez, Saúl", "Đoković, Ł. Ø", "ﬁnn, Ĳsbrand"]

    def plain(n):
        head, comma, tail = n.partition(",")
        whole = f"{tail.strip()} {head.strip()}" if comma else n
        ascii_only = unicodedata.normalize("NFKD", whole).encode("ascii", "ignore").decode()
        return " ".join(ascii_only.translate({ord(c): " " for c in ".'’-"}).split()).lower()
    t = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in t.select(X.person_key("n")).collect()] == [plain(n) for n in names]


def test_small_string_rules(spark):
    t = spark.createDataFrame([("7", " New  York KNICKS ", "LA Clippers"), ("12345678901", "", "Los Angeles Clippers")], "i string, n string, c string")
    r = t.select(X.zero_fill("i", 10), X.last_token("n"), X.squash_name("c")).collect()
    assert tuple(r[0]) == ("0000000007", "knicks", "losangelesclippers") and tuple(r[1]) == ("12345678901", "", "losangelesclippers")


def test_clock_changes(spark):
    t = spark.createDataFrame([("2024-11-03 01:30",), ("2024-03-10 02:30",), ("2024-07-01 13:00",), ("2024-01-01 13:00",)], "s string").selectExpr("cast(s as timestamp_ntz) w")
    got = [r[0] for r in t.select(D.wall_clock_to_utc("w")).collect()]
    assert got == [dt.datetime(2024, 11, 3, 5, 30), dt.datetime(2024, 3, 10, 7, 0), dt.datetime(2024, 7, 1, 17), dt.datetime(2024, 1, 1, 18)]


def test_strict_parse_rejects_naive_values(spark):
    t = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("2024-01-01",), (None,)], "s string")
    assert [r[0] is None for r in t.select(times.parse_strict("s")).collect()] == [False, True, True, True]


def test_files(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = T.StructType([T.StructField("game_id", T.StringType()), T.StructField("n", T.IntegerType())])
    for i in range(3):
        with open(f"{root}/schedule-{i}.json", "w") as f:
            json.dump([{"game_id": f"00{i}{j}", "n": j} for j in range(4)], f)
    assert S.read_json_arrays(spark, root + "/schedule-*.json", schema).count() == 12
    out = root + "/out"
    one = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    S.write_once(one, out)
    with pytest.raises(Exception):
        S.write_once(one, out)
    for _ in range(2):
        S.insert_only(spark, spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], schema), out, ["game_id"])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_snapshot_files_carry_their_names(spark):
    import hashlib
    import os
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.mkdir(root + "/recorded")
    for name, gid in ((hashlib.sha256(b"g1").hexdigest(), "g1"), ("wrong", "g2")):
        with open(f"{root}/recorded/{name}.json", "w") as f:
            json.dump({"game_id": gid, "n": 1}, f)
    schema = T.StructType([T.StructField("game_id", T.StringType()), T.StructField("n", T.IntegerType())])
    got = {r["game_id"]: r["name_ok"] for r in S.check_snapshot_names(S.read_snapshots(spark, root + "/recorded", schema)).collect()}
    assert got == {"g1": True, "g2": False}


def test_fingerprint_ignores_order_but_not_content(spark):
    t = spark.range(100).selectExpr("id", "id * 3 as v")
    a, b = (S.fingerprint(x, ["id", "v"]).first() for x in (t, t.repartition(7, F.rand(1))))
    c = S.fingerprint(t.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v"))), ["id", "v"]).first()
    assert a == b and a != c


CUT = dt.datetime(2026, 1, 10, 23)


def status(spark, rows):
    h = dt.timedelta(hours=1)
    reports = spark.createDataFrame([(t, p, s, CUT + o * h, src) for t, p, s, o, src in rows], "team_id long, player_id string, status string, report_at timestamp_ntz, source string")
    games = spark.createDataFrame([("G", "home", 1, CUT), ("G", "away", 2, CUT)], "game_id string, side string, team_id long, decision_at timestamp_ntz")
    st = A.snapshot_states(games, A.snapshots(reports, ["team_id"]), ["team_id"])
    return {r["side"]: r for r in st.collect()}, A.availability_features(st).first()


def test_latest_report_before_the_cutoff(spark):
    s, f = status(spark, [(1, "x", "Out", -6, "a"), (1, "y", "Out", -6, "a"), (1, "x", "Out", -2, "b"), (2, "z", "Questionable", -2, "b"), (1, "x", "Out", 0.5, "c"), (1, "y", "Out", 0.5, "c")])
    assert s["home"]["out"] == 1 and s["away"]["questionable"] == 1 and f["availability_covered"] == 1
    assert (f["out_diff"], f["questionable_diff"]) == (1, -1)


def test_report_at_the_cutoff_is_too_late_and_missing_is_not_healthy(spark):
    s, f = status(spark, [(1, "x", "Out", 0, "a")])
    assert s["home"]["state"] == "missing" == s["away"]["state"] and f["availability_covered"] == 0 and f["home_missing"] == 1


def test_state_precedence(spark):
    s, _ = status(spark, [(1, "x", "Out", -60, "a"), (1, "x", "Out", -60, "a"), (2, "z", "Out", -49, "a"), (2, None, "NotSubmitted", -49, "a")])
    assert s["home"]["state"] == "invalid" and s["away"]["state"] == "stale"
    s, f = status(spark, [(1, "x", "Out", -1, "a"), (1, "y", "Available", -1, "b"), (2, None, "NotSubmitted", -48, "a"), (2, "z", "Out", -48, "a")])
    assert s["home"]["state"] == "invalid" and s["away"]["state"] == "not_submitted" and s["away"]["out"] == 0
    assert f["not_submitted_diff"] == -1
    s, f = status(spark, [(1, "x", "Available", -1, "a"), (2, "z", "Probable", -1, "a")])
    assert s["home"]["available"] == 1 and f["probable_diff"] == -1 and "available_diff" not in f.asDict()


def test_player_prior_uses_known_games_only(spark):
    d = dt.timedelta(days=1)
    logs = spark.createDataFrame([(1, "p", i, CUT + k * d, m, m / 2) for i, (k, m) in enumerate([(-3, 30.0), (-2, 20.0), (0.05, 40.0)])], "team_id long, player string, log_id long, available_at timestamp_ntz, minutes double, points double")
    probes = spark.createDataFrame([(1, "p", CUT), (1, "q", CUT), (1, "p", CUT - 10 * d)], "team_id long, player string, decision_at timestamp_ntz")
    got = {(r["player"], r["decision_at"]): (r["prior_minutes"], r["prior_points"]) for r in A.player_prior(logs, probes, ["team_id", "player"]).collect()}
    assert got == {("p", CUT): (25.0, 12.5), ("q", CUT): (None, None), ("p", CUT - 10 * d): (None, None)}


def test_malformed_payloads(spark):
    """A repeated name keeps its last price; an unreadable body is set aside; neither stops the job."""
    from knowntime.sources import payload
    market = ('{"key": "h2h", "last_update": "2024-01-01T00:00:00Z", "outcomes": [{"name": "A", "price": 1.5}, {"name": "B", "price": 2.5}, {"name": "A", "price": 1.7}]}')
    odd = '{"key": "h2h", "outcomes": [{"name": null, "price": 1.5}, {"name": "A", "price": 2.5}]}'
    body = ('{"timestamp": "2024-01-01T01:00:00Z", "data": [{"id": "e", "home_team": "A", "away_team": "B", "bookmakers": '
            '[{"key": "k", "markets": [' + market + ", " + odd + "]}]}]}")
    raw = spark.createDataFrame([(1, body), (2, "not json"), (3, None), (4, "[]")], "n int, value string")
    rows = payload.winner_markets(payload.parse_body(raw)).collect()
    assert sorted(str(sorted(r["prices"].items())) for r in rows) == ["[('A', 1.7), ('B', 2.5)]", "[]"]
    assert sorted(r["n"] for r in payload.unreadable_bodies(raw).collect()) == [2, 3, 4]
    mapping = spark.createDataFrame([("e", 7, "A", "B")], "event_id string, contest_id int, home_name string, away_name string")
    quotes = payload.archived_quotes(payload.parse_body(raw), mapping, "c").collect()
    assert [(q["contest_id"], q["home_odds"], q["away_odds"]) for q in quotes] == [(7, 1.7, 2.5)]


def test_one_of_many_writers_gets_the_claim(spark):
    from concurrent.futures import ThreadPoolExecutor
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: S.claim(spark, f"{root}/claim", str(i)), range(8)))
    assert sum(got) == 1 and not S.claim(spark, f"{root}/claim")
    with S.only_writer(spark, f"{root}/t"):
        with pytest.raises(RuntimeError):
            S.insert_only(spark, spark.createDataFrame([(1,)], "k int"), f"{root}/t", ["k"])
    S.insert_only(spark, spark.createDataFrame([(1,)], "k int"), f"{root}/t", ["k"])           # the table is made
    S.insert_only(spark, spark.createDataFrame([(1,), (2,)], "k int"), f"{root}/t", ["k"])
    assert sorted(r.k for r in spark.read.parquet(f"{root}/t").collect()) == [1, 2]


def test_ingest_resumes_sets_bad_sources_aside_and_refuses_drift(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    schema = "source string, digest string, body string"
    one = [("a", "1", "x y"), ("b", "1", ""), ("c", "1", "!")]
    calls = []

    def parse(df):
        calls.append(df.count())
        return df.select("source", F.transform(F.filter(F.split("body", " "), lambda w: w != ""), lambda w: F.struct(w.alias("word"))).alias("parsed"),
                         F.when(F.col("body") == "!", "bad mark").alias("reason"))

    j = S.Journal(spark, root, "source", "v1")
    assert j.ingest(spark.createDataFrame(one, schema), "digest", parse) == 3
    assert {(r.source, r.n_rows, r.reason) for r in j.sources().collect()} == {("a", 2, None), ("b", 0, "no rows"), ("c", 0, "bad mark")}
    more = spark.createDataFrame([*one, ("d", "1", "z")], schema)
    assert j.ingest(more, "digest", parse) == 1 and j.ingest(more, "digest", parse) == 0 and calls == [3, 1, 0]
    assert sorted((r.source, r.word, r.run) for r in j.rows().collect()) == [("a", "x", 1), ("a", "y", 1), ("d", "z", 2)]
    with pytest.raises(ValueError, match="changed sources: 1"):
        j.ingest(spark.createDataFrame([("a", "2", "x")], schema), "digest", parse)
    with pytest.raises(ValueError, match="parser changed: True"):
        S.Journal(spark, root, "source", "v2").ingest(more, "digest", parse)
    more.limit(1).write.parquet(f"{root}/rows/run=9")                                           # a run that died before its journal
    assert j.rows().count() == 3


def test_snapshot_folder_is_scanned_with_its_names(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/snaps"
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "game_id int, v string")
    S.write_snapshots(df.where("game_id < 3"), root)
    S.write_snapshots(df.where("game_id = 3"), root, stem=F.lit("elsewhere"))
    got = {(r.game_id, r.v, r.name_ok) for r in S.check_snapshot_names(S.read_snapshots(spark, root, df.schema)).collect()}
    assert got == {(1, "x", True), (2, "y", True), (3, "z", False)}


def test_report_tasks_follow_the_bytes(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc"), F.concat(F.lit("01/02/2024 07:00 (ET) AAA@BBB Boston Celtics Fox, A"), F.col("id"), F.lit(" Out x")).alias("text"))
    monkeypatch.setattr(R, "BLOCK", 50, raising=False)
    rows = R.parse_reports(docs, "doc")
    assert rows.rdd.getNumPartitions() >= 40
    assert sorted((r.doc, r.team, r.player) for r in rows.collect()) == [(i, "BostonCeltics", f"Fox, A{i}") for i in range(40)]
