"""Newton fits against independent numpy optimisation; calibration; job invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowntime.operators import metrics as M
from knowntime.plans import jobs as J
from knowntime.plans.logit import Spec, apply_models, fit_calibration, fit_logistic, parameter_table


def sample(n=900, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 20, 0.1] + [0, 100, 5]
    x = np.column_stack([x, np.full(n, 7.0)])          # a constant input
    q = rng.uniform(0.2, 0.8, n)
    eta = np.log(q / (1 - q)) + 0.8 * (x[:, 0]) - 0.03 * (x[:, 1] - 100)
    return x, q, (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(float)


def numpy_fit(x, q, y, l2):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-8, 1, scale)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    off, w = np.log(q / (1 - q)), np.zeros(z.shape[1])
    pen = np.r_[0, np.full(x.shape[1], l2)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-(off + z @ w)))
        g = z.T @ (p - y) / len(y) + 2 * pen * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + 2 * np.diag(pen)
        w = w - np.linalg.lstsq(h, g, rcond=None)[0]
    return mean, scale, w


def frame(spark, x, q, y):
    data = [(int(i), "fit", *map(float, r), float(a), int(b)) for i, (r, a, b) in enumerate(zip(x, q, y))]
    return spark.createDataFrame(data, "contest_id long, group string, a double, b double, c double, d double, q double, y int").repartition(5)


@pytest.mark.parametrize("l2", [0.0, 0.01, 1.0])
def test_ridge_logistic_with_offset(spark, l2):
    x, q, y = sample()
    f = fit_logistic(frame(spark, x, q, y), [Spec("m", "fit", ("a", "b", "c", "d"), l2)], offset="q")["m"]
    mean, scale, w = numpy_fit(x, q, y, l2)
    np.testing.assert_allclose(f.mean, mean, rtol=1e-10)
    np.testing.assert_allclose(f.scale, scale, rtol=1e-8)
    np.testing.assert_allclose(f.coef, w, atol=1e-7)


def test_many_models_share_passes(spark):
    x, q, y = sample()
    specs = [Spec("all", "fit", ("a", "b", "c")), Spec("less", "fit", ("a", "c")), Spec("hard", "fit", ("a", "b", "c"), 1.0)]
    fits = fit_logistic(frame(spark, x, q, y), specs)
    half = np.full(len(y), 0.5)
    for s in specs:
        cols = ["abcd".index(c) for c in s.features]
        np.testing.assert_allclose(fits[s.name].coef, numpy_fit(x[:, cols], half, y, s.l2)[2], atol=1e-7)


def test_applied_parameters_match_numpy(spark):
    x, q, y = sample(300)
    t = frame(spark, x, q, y)
    fits = fit_logistic(t, [Spec("m", "fit", ("a", "b", "c"))], offset="q")
    got = {r["contest_id"]: r["p_raw"] for r in apply_models(
        t, parameter_table(spark, fits), ("a", "b", "c"), offset=F.col("q")).collect()}
    mean, scale, w = numpy_fit(x[:, :3], q, y, 0.01)
    z = np.log(q / (1 - q)) + w[0] + ((x[:, :3] - mean) / scale) @ w[1:]
    np.testing.assert_allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-z)), atol=1e-8)


def test_calibration_minimises_its_objective(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 600)
    z = np.log(p / (1 - p))
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-(0.3 + 0.6 * z)))).astype(int)
    t = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)], "model string, p_raw double, y int")
    a, slope = fit_calibration(t, ["m"])["m"]

    def loss(a, v):
        eta = a + np.exp(v) * z
        return np.mean(np.logaddexp(0, eta) - y * eta) + 0.001 * (a * a + v * v)
    best, v = loss(a, np.log(slope)), np.log(slope)
    for da, dv in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (1e-3, 1e-3), (-1e-3, 1e-3)):
        assert loss(a + da, v + dv) >= best - 1e-12


def test_calibration_stays_inside_its_bounds(spark):
    t = spark.createDataFrame([("m", 0.5, 1)] * 200 + [("m", 0.5, 1)] * 5, "model string, p_raw double, y int")
    a, slope = fit_calibration(t, ["m"])["m"]
    assert 2.5 < a <= 3.0 and np.exp(-3) <= slope <= np.exp(3)


def test_variants_must_score_the_same_rows(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "a")], "fold int, contest_id int, variant string").selectExpr("*", "0.5 as p", "1 as y")
    with pytest.raises(ValueError):
        J.pooled_report(t, ["a", "b"])


def test_split_fit_leaves_unknown_labels_out(spark):
    from knowntime.operators.splits import split_column
    t = spark.sql("SELECT timestamp_ntz'2020-06-30 12:00:00' AS decision_at, timestamp_ntz'2020-07-01 12:00:00' AS available_at")
    bounds = {"train": "2020-07-01", "validation": "2021-07-01"}
    assert t.select(split_column(bounds)).first()[0] is None
    assert t.select(split_column({"train": "2019-01-01", "validation": "2020-07-01"})).first()[0] == "validation"
    with pytest.raises(ValueError):
        split_column({"train": "2021-01-01", "validation": "2020-07-01"})


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(1)
    p, y = rng.uniform(0, 1, 500), rng.integers(0, 2, 500)
    t = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)], "model string, p double, y int")
    r = M.score(t, ["model"]).first()
    assert r["log_loss"] == pytest.approx(float(np.mean(-(y * np.log(p) + (1 - y) * np.log1p(-p)))))
    assert r["brier"] == pytest.approx(float(np.mean((p - y) ** 2)))
    assert r["accuracy"] == pytest.approx(float(np.mean((p >= .5) == y)))


def test_probability_one_falls_out_of_half_open_bins(spark):
    t = spark.createDataFrame([(1.0,), (0.95,), (0.0,), (0.3,)], "p double").select("p", M.decile_bin().alias("a"), M.clipped_bin().alias("b"))
    got = {r["p"]: (r["a"], r["b"]) for r in t.collect()}
    assert got[1.0] == (None, 9) and got[0.95] == (9, 9) and got[0.0] == (0, 0) and got[0.3][0] == 2


def test_certificates_refuse_wrong_parameters(spark):
    import random
    from knowntime.plans import certificate as C, jobs as J
    r = random.Random(2)
    rows = []
    for i in range(900):
        a, b = r.gauss(0, 1), r.gauss(2, 3)
        rows.append((i, "f", ("train", "tune", "calibration", "validation")[i % 4], a, b, 7.0, int(r.random() < 1 / (1 + 2.7 ** (-a + 0.2 * b - 0.3)))))
    df = spark.createDataFrame(rows, "contest_id int, fold string, split string, a double, b double, c double, y int").withColumn(
        "decision_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    inputs = ("a", "b", "c")
    params, _ = J.fit_folds(df, {"all": inputs, "one": ("b",)})
    fitted, held = df.where("split IN ('train', 'tune')"), df.where("split = 'calibration'")
    good = C.fit_certificates(params, fitted, inputs).collect()
    assert len(good) == 2 and all(x.n == 450 and x.rows_agree and x.scaled and x.optimal for x in good)
    assert all(x.calibrated and x.n_calibration == 225 for x in C.calibration_certificates(params, held, inputs).collect())
    moved = params.withColumn("coef", F.transform("coef", lambda x, i: F.when(i == 1, x + 1e-4).otherwise(x)))
    assert not any(x.optimal for x in C.fit_certificates(moved, fitted, inputs).collect())
    assert not any(x.scaled for x in C.fit_certificates(params.withColumn("mean", F.transform("mean", lambda x: x + 1e-3)), fitted, inputs).collect())
    assert not any(x.calibrated for x in C.calibration_certificates(params.withColumn("slope", F.col("slope") * 1.01), held, inputs).collect())


def test_a_holdout_is_scored_once(spark):
    import tempfile
    from knowntime.plans.holdout import Consumed, Holdout
    run = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/final"
    forecasts = spark.createDataFrame([(1, 0.4, 1), (2, 0.6, 0)], "contest_id int, p double, y int")
    read = []
    outcomes = lambda: (read.append(1), forecasts.select("contest_id", "y"))[1]
    one, two = Holdout(spark, run), Holdout(spark, run)
    with pytest.raises(ValueError, match="freeze"):
        one.score(lambda: forecasts, outcomes, "contest_id")
    one.freeze({"l2": 0.01}), two.freeze({"l2": 0.01})
    with pytest.raises(ValueError, match="frozen record"):
        two.freeze({"l2": 0.1})
    assert one.dry_run(lambda: forecasts).columns == ["contest_id", "p"] and not read
    assert sorted(map(tuple, one.score(lambda: forecasts, outcomes, "contest_id").collect())) == [(1, 0.4, 1), (2, 0.6, 0)]
    with pytest.raises(Consumed):
        two.score(lambda: forecasts, outcomes, "contest_id")
    assert len(read) == 1


def test_prospective_polls_record_once_and_never_late(spark):
    import datetime as dt
    import tempfile
    from knowntime.plans.prospective import Refused, poll
    cut = dt.datetime(2026, 1, 10, 18)
    minute = dt.timedelta(minutes=1)
    schema = "game_id string, home_id string, away_id string, scheduled_at timestamp_ntz, decision_at timestamp_ntz, schedule_observed_at timestamp_ntz"
    game = lambda i, m, **kw: tuple({"id": i, "h": "A", "a": "B", "s": cut + (60 + m) * minute, "d": cut + m * minute, "o": cut - 600 * minute, **kw}.values())
    schedule = spark.createDataFrame([game("g1", 0), game("g2", 3), game("g3", 30)], schema)

    def forecast(due):
        assert {r.decision_at for r in due.select("decision_at").collect()} == {cut - 2 * minute}
        one = lambda name, x: F.create_map(F.lit(name), F.lit(x))
        return due.select("game_id", one("deployed", 0.6).alias("predictions"), one("home_missing", 1.0).alias("features"),
                          F.array(F.struct(F.lit("none").alias("source"))).alias("selected_reports"))

    path, marks = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), {"model": "m1", "schedule": "s1"}
    kw = {"issued_at": cut - 2 * minute, "provenance": marks, "frozen": marks}
    assert poll(schedule, forecast, path, clock=lambda: cut, **kw) == 2 and poll(schedule, forecast, path, clock=lambda: cut, **kw) == 0     # simulated
    with pytest.raises(Refused, match="crossed a cutoff"):
        poll(schedule, forecast, path, clock=lambda: cut + minute, record=True, **kw)
    assert poll(schedule, forecast, path, clock=lambda: cut - minute, record=True, **kw) == 2
    assert poll(schedule, forecast, path, clock=lambda: cut - minute, record=True, **kw) == 0
    rows = spark.read.parquet(path + "/recorded").collect()
    assert {r.game_id for r in rows} == {"g1", "g2"} and {r.mode for r in rows} == {"prospective"}
    assert {r.issued_at for r in rows} == {cut - minute} and rows[0].provenance == marks and rows[0].predictions == {"deployed": 0.6}
    with pytest.raises(Refused, match="changed since freezing: model"):
        poll(schedule, forecast, path, clock=lambda: cut, **{**kw, "provenance": {**marks, "model": "m2"}})
    for wrong, what in ((game("g1", 1), "listed twice"), (game("g9", 1, a="A"), "identical"), (game("g9", 1, s=cut), "another time"), (game("g9", 1, o=cut), "observed after")):
        with pytest.raises(Refused, match=what):
            poll(schedule.unionByName(spark.createDataFrame([wrong], schema)), forecast, path + "/x", clock=lambda: cut, **kw)


def test_scores_are_built_from_plain_columns_and_group_sums_from_matrices(spark):
    from knowntime.plans.logit import group_sums
    rows = spark.range(300).select(F.concat(F.lit("g"), F.col("id") % 3).alias("group"), (F.col("id") % 7).alias("a"), F.lit(1).alias("y"))
    got = group_sums(rows, "group", ["a", "y"], lambda key, x: {key: np.array([len(x), x[:, 0].sum(), x[:, 1].sum()])})
    assert {k: v.tolist() for k, v in got.items()} == {f"g{g}": [100.0, float(sum(i % 7 for i in range(300) if i % 3 == g)), 100.0] for g in range(3)}
    params = spark.createDataFrame([("m", "fit:f", ["a"], [1.0], [2.0], [0.5, 0.25], 0.01, 9, 0.1, 1.2)], "model string, group string, features array<string>, "
                                   "mean array<double>, scale array<double>, coef array<double>, l2 double, refit_rows long, intercept double, slope double")
    scored = apply_models(rows.drop("group"), params, ["a"])
    assert "lambda" not in scored._jdf.queryExecution().executedPlan().toString()
    r = scored.first()
    raw = 1 / (1 + np.exp(-(0.5 + (r["a"] - 1.0) / 2.0 * 0.25)))
    assert r["p_raw"] == pytest.approx(raw, abs=1e-15) and set(scored.columns) >= {"model", "p_raw", "p"}


def test_trials_alone_refit_nothing(spark, monkeypatch):
    from knowntime.plans import boosted as G
    rows = spark.range(400).select(F.when(F.col("id") % 4 < 3, "train").otherwise("tune").alias("split"), (F.col("id") % 17).alias("x"), (F.col("id") % 17 > 8).cast("int").alias("y"))
    fits, make = [], G._learner
    monkeypatch.setattr(G, "_learner", lambda *a: fits.append(a) or make(*a))
    trials = G.tune(rows, ["x"], depths=(2,), trees=(1, 2))
    assert len(fits) == 1 and [t["trees"] for t in trials] == [1, 2]


def test_registered_boosting_runs_the_whole_grid_on_all_folds(spark, monkeypatch):
    from knowntime.catalog import models as Q
    from knowntime.plans import boosted as G
    asked, folds = [], []

    class Learner:
        def __init__(self, depth, trees, seed):
            asked.append((depth, trees))
            self.trees = trees

        def fit(self, rows):
            return self

        def evaluateEachIteration(self, rows):
            return [1.0 / n for n in range(1, self.trees + 1)]

    rows = spark.range(40).select(F.col("id").alias("contest_id"), (1997 + F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 2).cast("int").alias("y"),
                                  F.element_at(F.array(*[F.lit(s) for s in ("train", "tune", "validation")]), (F.col("id") % 9 / 3).cast("int") + 1).alias("split"),
                                  *[F.rand(i).alias(f) for i, f in enumerate(J.BASE)])
    monkeypatch.setattr(G, "_learner", Learner)
    monkeypatch.setattr(G, "predict", lambda model, rows, inputs, offset=None: folds.append(model.trees) or rows.withColumn("p_raw", F.lit(0.5)))
    monkeypatch.setattr(Q, "fold_rows", lambda spark, sf_dir: rows)
    trials = {(r.fold, r.depth, r.trees) for r in Q.boosted_tree_trials(spark, "x").collect()}
    assert trials == {(f, d, n) for f in (1997, 1998, 1999) for d in (2, 3) for n in (100, 250)}
    assert sorted(asked) == [(2, 250)] * 3 + [(3, 250)] * 3
    held = Q.boosted_trees(spark, "x").collect()
    assert folds == [250] * 3 and {r.fold for r in held} == {1997, 1998, 1999}
    assert len(held) == rows.where("split = 'validation'").count()
    market = rows.select("contest_id", F.expr("timestamp_ntz'2024-01-10 00:00:00'").alias("decision_at"), F.lit(0.5).alias("q"),
                         *[F.rand(i).alias(c) for i, c in enumerate(("past", "dispersion", "age_minutes", "mean_overround"))])
    monkeypatch.setattr(Q, "consensus_rows", lambda spark, sf_dir: market)
    asked.clear()
    Q.residual_boosting(spark, "x")
    assert sorted(asked)[0] == (2, 250) and (3, 250) in asked
