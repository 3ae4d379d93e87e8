"""The stateful stream equals the batch fold, whatever order results arrive in."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.operators.ratings import rating_fold, with_outcome
from knowntime.sources.tables import append
from knowntime.streaming import polls as P, ratings as R


def test_rating_stream_equals_batch_with_shuffled_arrival(spark, sf):
    src, out, ck = P.fresh_paths(spark, "t-ratings", "in", "out", "checkpoint")
    c = with_outcome(V.contests(spark, sf))
    rows = c.select("league", "contest_id", "home_id", "away_id", "outcome", "neutral", F.col("available_at").cast("timestamp").alias("available_at"))
    # Neighbouring months swap places: a result may arrive up to about sixty days late.
    month = (F.year("available_at") * 12 + F.month("available_at")).cast("int")
    for low, high in ((0, 23970), (23970, 99999)):
        part = rows.where((month >= low) & (month < high))
        for parity in (1, 0):
            append(part.where(month % 2 == parity).orderBy(F.rand(1)).coalesce(1), src)
    end = rows.select("league").distinct().selectExpr("league", "-1L contest_id", "0L home_id", "1L away_id", "0.5D outcome", "0 neutral", "timestamp'2100-01-01' available_at")
    append(end.select(*rows.columns).coalesce(1), src)
    got = P.run_available(R.rating_stream(P.stream_files(spark, src, rows.schema, per_trigger=1), delay="4000 days", advantage=55.0), out, ck, map_state=True)
    want = rating_fold(c, ["league"], advantage=55.0)
    a = sorted((r["contest_id"], round(r["home_rating"], 9)) for r in got.collect())
    b = sorted((r["contest_id"], round(r["home_rating"], 9)) for r in want.collect())
    assert a == b and len(a) > 500


def test_double_and_late_delivery_do_not_move_ratings(spark):
    src, out, ck = P.fresh_paths(spark, "t-double", "in", "out", "checkpoint")
    start = dt.datetime(2024, 1, 1)
    schema = "league string, contest_id long, home_id long, away_id long, outcome double, neutral int, available_at timestamp"
    game = lambda i, day: ("L", i, i % 3, 3 + i % 2, float(i % 2), 0, start + dt.timedelta(days=day))
    first, second, third = [game(i, i) for i in range(30)], [game(i, i) for i in range(25, 60)], [game(i, i) for i in (3, 3, 58, 59)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    late = []
    for rows in (first + first[:7], second, third + [("L", 99, 0, 1, 1.0, 0, dt.datetime(2100, 1, 1))], [game(200, 40)]):
        append(spark.createDataFrame(rows, schema).coalesce(1), src)
        stream = R.rating_stream(P.stream_files(spark, src, spark.createDataFrame([], schema).schema, per_trigger=1), delay="5 days")
        got = P.run_available(stream, out, ck, map_state=True, late=late)
    played = [game(i, i) for i in range(60)]
    want = rating_fold(spark.createDataFrame(played, schema).withColumn("available_at", F.col("available_at").cast("timestamp_ntz")), ["league"])
    assert sorted((r.contest_id, round(r.home_rating, 9)) for r in got.collect()) == sorted((r.contest_id, round(r.home_rating, 9)) for r in want.collect())
    assert sum(late) == 3                              # contest 3 twice, and contest 200
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_a_batch_tried_again_changes_nothing(spark):
    ok, late = P.fresh_paths(spark, "t-late", "issued", "late")
    t = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, t, t), (2, t, t + dt.timedelta(seconds=1)), (3, t, None)], "contest_id int, decision_at timestamp, issued_at timestamp")
    handle = P.late_writer(ok, late)
    for batch_id in (0, 0, 1, 0):
        handle(batch, batch_id)
    for path, ids in ((ok, [1, 1]), (late, [2, 2, 3, 3])):
        assert sorted(r.contest_id for r in spark.read.parquet(path).collect()) == ids


def test_no_alert_before_the_cutoff_and_one_after(spark):
    cs, rs, out, ck = P.fresh_paths(spark, "t-alerts", "cutoffs", "records", "out", "checkpoint")
    t = lambda m: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)
    c_schema, r_schema = "contest_id long, cutoff timestamp", "contest_id long, recorded_at timestamp"
    steps = [([(1, t(60)), (2, t(60)), (3, t(60))], [(None, t(0))], set()),
             ([(1, t(60)), (3, t(60))], [(2, t(57)), (None, t(59))], set()),           # announced again; one is recorded in time
             ([(1, t(60))], [(3, t(61)), (None, t(71))], set()),                        # a record past the cutoff is none
             ([(1, t(60)), (4, t(300))], [(None, t(75))], {1, 3}), ([(1, t(60))], [(None, t(80))], {1, 3})]
    for cutoffs, records, alerts in steps:
        append(spark.createDataFrame(cutoffs, c_schema).coalesce(1), cs)
        append(spark.createDataFrame(records, r_schema).coalesce(1), rs)
        got = P.run_available(P.missed_windows(P.stream_files(spark, cs, spark.createDataFrame([], c_schema).schema),
                                               P.stream_files(spark, rs, spark.createDataFrame([], r_schema).schema)), out, ck)
        rows = [r.contest_id for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) <= {1, 3}
        assert alerts <= set(rows) or records[0][1] == t(75)
    assert set(rows) == {1, 3}


def test_a_quote_past_the_watermark_is_lost_and_counted(spark):
    ds, qs, out, ck = P.fresh_paths(spark, "t-fresh", "d", "q", "out", "checkpoint")
    t = lambda m: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)
    d_schema, q_schema = "contest_id long, decision_at timestamp", "quote_id long, contest_id long, book string, available_at timestamp"
    late = []
    for d, q in (([(1, t(0)), (9, t(100))], [(1, 1, "b", t(-3)), (2, 9, "b", t(100))]), ([(1, t(101))], [(3, 1, "b", t(20)), (4, 1, "b", t(95))])):
        append(spark.createDataFrame(d, d_schema).coalesce(1), ds)
        append(spark.createDataFrame(q, q_schema).coalesce(1), qs)
        got = P.run_available(P.fresh_quotes(P.stream_files(spark, ds, spark.createDataFrame([], d_schema).schema),
                                             P.stream_files(spark, qs, spark.createDataFrame([], q_schema).schema)), out, ck, late=late)
    assert sorted(r.quote_id for r in got.collect()) == [1, 2, 4] and sum(late) == 1


class HeldStates:
    """Stands for a state handle: counts what is written and read."""

    def __init__(self):
        self.values, self.timers, self.read, self.written = {}, set(), 0, 0

    def getMapState(self, name, *_):
        return HeldMap(self, name)

    def getValueState(self, name, *_):
        return HeldMap(self, name)

    def registerTimer(self, at):
        self.timers.add(at)


class HeldMap:
    def __init__(self, states, name):
        self.states, self.held = states, {}

    def containsKey(self, key):
        return key in self.held

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value

    def getValue(self, key):
        self.states.read += sum(len(v) for v in self.held[key] if isinstance(v, bytes))
        return self.held[key]

    def updateValue(self, key, value):
        self.states.written += sum(len(v) for v in value if isinstance(v, bytes))
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


def test_waiting_results_are_not_rewritten_by_each_batch():
    n, batches = 100, 30
    rows = pd.DataFrame({"available_us": range(n * batches), "contest_id": range(n * batches), "home_id": [i % 7 for i in range(n * batches)],
                         "away_id": [8 + i % 5 for i in range(n * batches)], "outcome": [float(i % 2) for i in range(n * batches)], "neutral": 0})
    shuffled = rows.sample(frac=1.0, random_state=1)
    states, fold = HeldStates(), R.RatingProcessor()
    fold.init(states)
    for i in range(batches):
        list(fold.handleInputRows(("a",), iter([shuffled[n * i:n * (i + 1)]]), None))
    assert states.read == 0 and states.written < 200 * len(rows)
    list(fold.handleInputRows(("a",), iter([shuffled[:n]]), None))      # delivered again
    at = SimpleNamespace(getExpiryTimeInMs=lambda: states.timers.pop())
    out = pd.concat(fold.handleExpiredTimer(("a",), None, at))
    now, want = {}, []
    for r in rows.itertuples():
        a, b = now.get(r.home_id, 1500.0), now.get(r.away_id, 1500.0)
        move = 20.0 * (r.outcome - 1.0 / (1.0 + 10.0 ** (-(a - b + 65.0) / 400.0)))
        now[r.home_id], now[r.away_id] = a + move, b - move
        want.append((r.contest_id, a + move, b - move))
    assert list(out[["contest_id", "home_rating", "away_rating"]].itertuples(index=False, name=None)) == want
