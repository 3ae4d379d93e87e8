"""Ridge logistic models with an offset, fitted by Newton steps on distributed sums.

Many models (folds x variants x penalties) are fitted in the same passes. A pass scans the
rows once; every task adds up its gradient and Hessian contributions with numpy and emits one
small vector per model, Spark adds the vectors, and the driver solves one k x k system per
model. Only those sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from knowntime.functions.prob import expit, logit
from knowntime.session import scratch_path


@dataclass(frozen=True)
class Spec:
    """One model: the row group it is fitted on, its inputs and its penalty."""
    name: str
    group: str
    features: tuple[str, ...]
    l2: float = 0.01


@dataclass
class Fit:
    spec: Spec
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    rows: int
    loss: float
    steps: int


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write once to the shared scratch folder and read back: iterations scan columns, and a
    lost executor re-reads files instead of recomputing the lineage."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.parquet(path)


_SHARED: dict[tuple[str, str], str] = {}


def materialize_shared(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build an input table once per application and share it between jobs; rebuilt when its
    files are gone."""
    key = (spark.sparkContext.applicationId, name)
    if key in _SHARED:
        try:
            return spark.read.parquet(_SHARED[key])
        except AnalysisException:
            pass
    path = scratch_path(spark, "shared")
    build().write.parquet(path)
    _SHARED[key] = path
    return spark.read.parquet(path)


def _clip_logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def group_sums(rows: DataFrame, group: str, columns: Sequence[str],
               stats: Callable[[str, np.ndarray], Mapping[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Add up ``stats(group value, matrix of that group's rows in a batch, one column each)`` over the whole table."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).dictionary_encode()
            at, keys = of.indices.to_numpy(zero_copy_only=False), of.dictionary.to_pylist()
            x = np.empty((batch.num_rows, batch.num_columns - 1), order="F")
            for i in range(x.shape[1]):
                x[:, i] = batch.column(i + 1).to_numpy(zero_copy_only=False)
            for k, key in enumerate(keys):
                for name, vec in stats(key, x if len(keys) == 1 else x[at == k]).items():
                    total[name] = total[name] + vec if name in total else vec
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                             names=["name", "v"])

    parts = rows.select(group, *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(task, "name string, v array<double>")
    flat = parts.select("name", F.posexplode("v").alias("i", "x")).groupBy("name", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for name, block in flat.toPandas().sort_values(["name", "i"]).groupby("name"):
        out[name] = block["x"].to_numpy()
    return out


def _by_group(specs: Sequence[Spec]) -> dict[str, list[Spec]]:
    groups: dict[str, list[Spec]] = {}
    for s in specs:
        groups.setdefault(s.group, []).append(s)
    return groups


def fit_logistic(rows: DataFrame, specs: Sequence[Spec], *, group: str = "group", y: str = "y",
                 offset: str | None = None, tol: float = 1e-10, max_steps: int = 50) -> dict[str, Fit]:
    """Fit every spec on the rows of its group.

    Inputs are z-scored by the fitting rows (population deviation; constant inputs keep scale
    one); the intercept is not penalised; ``offset`` is a probability entering as its logit.
    """
    groups, inputs = _by_group(specs), list(dict.fromkeys(f for s in specs for f in s.features))
    used = rows.where(F.col(group).isin(list(groups)))
    stats = {r["g"]: r for r in used.groupBy(F.col(group).alias("g")).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(inputs)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(inputs)]).collect()}   # one row per group
    at = {f: i for i, f in enumerate(inputs)}
    fits = {}
    for s in specs:
        if s.group not in stats:
            raise ValueError(f"no fitting rows for {s.name}")
        r = stats[s.group]
        sd = np.array([r[f"s{at[f]}"] for f in s.features])
        fits[s.name] = Fit(s, np.array([r[f"m{at[f]}"] for f in s.features], float), np.where(sd < 1e-8, 1.0, sd),
                           np.zeros(len(s.features) + 1), int(r["n"]), np.inf, 0)
    columns = [*inputs, y] + ([offset] if offset else [])
    # Means and scales of a group in the order of the inputs; the places of a model's intercept and inputs in them.
    centre = {}
    for g in groups:
        sd = np.array([stats[g][f"s{i}"] for i in range(len(inputs))], float)
        centre[g] = np.array([stats[g][f"m{i}"] for i in range(len(inputs))], float), np.where(sd < 1e-8, 1.0, sd)
    places = {s.name: np.array([0, *[at[f] + 1 for f in s.features]]) for s in specs}
    trial = {n: f.coef.copy() for n, f in fits.items()}
    step = {n: np.zeros_like(c) for n, c in trial.items()}
    active = set(fits)
    for _ in range(max_steps):
        now = {g: [(s.name, places[s.name], trial[s.name]) for s in ss if s.name in active] for g, ss in groups.items()}

        def newton(key, part):
            m, sc = centre[key]
            t = part[:, len(inputs)]
            base = _clip_logit(part[:, -1]) if offset else 0.0
            every = np.empty((len(part), len(inputs) + 1), order="F")      # z-scores, shared by the models of the group
            every[:, 0] = 1.0
            np.divide(part[:, :len(inputs)] - m, sc, out=every[:, 1:])
            out = {}
            for name, place, w in now[key]:
                z = every if np.array_equal(place, np.arange(every.shape[1])) else every[:, place]
                eta = base + z @ w
                e = np.exp(-np.abs(eta))
                p = np.where(eta >= 0, 1 / (1 + e), e / (1 + e))
                loss = np.sum(np.maximum(eta, 0) + np.log1p(e) - t * eta)
                hess = (z * (p * (1 - p))[:, None]).T @ z
                out[name] = np.concatenate([[loss], z.T @ (p - t), hess[np.triu_indices(len(w))]])
            return out

        live = used.where(F.col(group).isin([g for g, x in now.items() if x]))
        got = group_sums(live, group, columns, newton)
        for name in list(active):
            f, w, v = fits[name], trial[name], got[name]
            k, n = len(w), f.rows
            ridge = np.full(k, f.spec.l2)
            ridge[0] = 0.0
            loss = v[0] / n + np.sum(ridge * w ** 2)
            f.steps += 1
            if loss > f.loss + 1e-13 and np.max(np.abs(step[name])) > tol:
                step[name] = step[name] / 2          # too far: halve and try again
                trial[name] = f.coef + step[name]
                continue
            f.coef, f.loss = w, loss
            hess = np.zeros((k, k))
            hess[np.triu_indices(k)] = v[1 + k:] / n
            hess = hess + np.triu(hess, 1).T + np.diag(2 * ridge)
            grad = v[1:1 + k] / n + 2 * ridge * w
            step[name] = -np.linalg.lstsq(hess, grad, rcond=1e-14)[0]
            if np.max(np.abs(grad)) < tol:
                active.discard(name)
            else:
                trial[name] = w + step[name]
        if not active:
            return fits
    raise RuntimeError(f"no convergence for {sorted(active)}")


def fit_calibration(rows: DataFrame, names: Sequence[str], *, model: str = "model", p: str = "p_raw",
                    y: str = "y", tol: float = 1e-9, max_steps: int = 60) -> dict[str, tuple[float, float]]:
    """Sigmoid calibration per model: (intercept, slope) with slope = exp(v), both bounded.

    Minimises the mean log loss of ``a + exp(v) * logit(p)`` plus 0.001 (a^2 + v^2), with
    a and v inside [-3, 3], by projected Newton steps on three-number sums per model.
    """
    best = {n: (np.inf, np.zeros(2)) for n in names}
    trial = {n: np.zeros(2) for n in names}
    step = {n: np.zeros(2) for n in names}
    active = set(names)
    used = rows.where(F.col(model).isin(list(names)))
    for _ in range(max_steps):
        now = {n: trial[n] for n in active}
        def sums(key, part):
            if key not in now:
                return {}
            a, v = now[key]
            z, t, b = _clip_logit(part[:, 0]), part[:, 1], np.exp(v)
            eta = a + b * z
            q = _sigmoid(eta)
            r, w, bz = q - t, q * (1 - q), b * z
            loss = np.sum(np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))) - t * eta)
            return {key: np.array([len(t), loss, r.sum(), (r * bz).sum(), w.sum(), (w * bz).sum(), (w * bz * bz).sum()])}
        got = group_sums(used, model, [p, y], sums)
        for n in list(active):
            if n not in got:
                raise ValueError(f"no calibration rows for {n}")
            x, s = trial[n], got[n]
            loss = s[1] / s[0] + 0.001 * np.sum(x ** 2)
            if loss > best[n][0] + 1e-14 and np.max(np.abs(step[n])) > tol:
                step[n] = step[n] / 2
                trial[n] = np.clip(best[n][1] + step[n], -3, 3)
                continue
            best[n] = (loss, x)
            grad = s[2:4] / s[0] + 0.002 * x
            curv = np.array([[s[4], s[5]], [s[5], s[6]]]) / s[0] + 0.002 * np.eye(2)
            stuck = ((x <= -3) & (grad > 0)) | ((x >= 3) & (grad < 0))
            free = ~stuck
            step[n] = np.zeros(2)
            if free.any():
                step[n][free] = -np.linalg.solve(curv[np.ix_(free, free)], grad[free])
            if not free.any() or np.max(np.abs(grad[free])) < tol:
                active.discard(n)
            else:
                trial[n] = np.clip(x + step[n], -3, 3)
        if not active:
            return {n: (float(x[0]), float(np.exp(x[1]))) for n, (_, x) in best.items()}
    raise RuntimeError(f"no convergence for {sorted(active)}")


def parameter_table(spark: SparkSession, fits: Mapping[str, Fit],
                    calibrators: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per model: inputs, scaling, coefficients, penalty and calibration."""
    cal = calibrators or {}
    rows = [(n, f.spec.group, list(f.spec.features), f.mean.tolist(), f.scale.tolist(), f.coef.tolist(),
             float(f.spec.l2), f.rows, *(cal.get(n) or (0.0, 1.0))) for n, f in fits.items()]
    return spark.createDataFrame(rows, "model string, group string, features array<string>, mean array<double>, "
                                 "scale array<double>, coef array<double>, l2 double, refit_rows long, "
                                 "intercept double, slope double")


def apply_models(rows: DataFrame, params: DataFrame, inputs: Sequence[str], *, on: str | None = None,
                 params_on: str = "group", offset: Column | None = None) -> DataFrame:
    """Score rows with every model of the table: adds model, p_raw and p.

    ``on`` limits a row to the models of its group; without it every model scores every row.
    The table has one row per model, so it is joined as a broadcast of that known size.
    """
    # Parameters are laid out once per model as plain columns in the order of ``inputs`` (absent inputs weigh 0): arrays of them would be
    # built again for every row and term.
    def of(source: str, name: str, shift: int, default: float) -> Column:
        at = F.array_position("features", F.lit(name))
        return F.when(at > 0, F.get(source, (at - 1 + shift).cast("int"))).otherwise(F.lit(default))
    arrays, laid = ("features", "mean", "scale", "coef"), range(len(inputs))
    keep = [c for c in params.columns if (c not in rows.columns or c == params_on) and c not in arrays]
    small = params.select(*keep, F.col("coef")[0].alias("_bias"), *[c for i, name in enumerate(inputs) for c in (
        of("mean", name, 0, 0.0).alias(f"_mean_{i}"), of("scale", name, 0, 1.0).alias(f"_scale_{i}"), of("coef", name, 1, 0.0).alias(f"_coef_{i}"))])
    small = F.broadcast(small.withColumnRenamed(params_on, "_on"))
    joined = (rows.join(small, rows[on] == F.col("_on")) if on else rows.withColumn("_one", F.lit(1)).join(
        small.withColumn("_one", F.lit(1)), "_one").drop("_one"))
    eta = F.col("_bias")
    for i, name in enumerate(inputs):
        eta = eta + (F.col(name).cast("double") - F.col(f"_mean_{i}")) / F.col(f"_scale_{i}") * F.col(f"_coef_{i}")
    if offset is not None:
        eta = eta + logit(offset)
    out = joined.withColumn("p_raw", expit(eta)).withColumn("p", expit(F.col("intercept") + F.col("slope") * logit("p_raw")))
    return out.drop("intercept", "slope", "refit_rows", "l2", "_on", "_bias", *[f"_{c}_{i}" for c in ("mean", "scale", "coef") for i in laid])
