"""Certificates of fitted models: that emitted parameters are the optimum, recomputed from the rows without the fitting code.

A ridge logistic loss is convex, so a vanishing gradient is proof; a calibration is bounded, so its gradient may point out of the
bounds. Built-in expressions only; the parameter table has one row per model and is joined as a broadcast of that size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from knowntime.functions.prob import expit, logit
from knowntime.plans.logit import materialize


def laid_out(params: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Parameters in the order of ``inputs``; a model's own inputs are marked by ``has_<i>``."""
    def of(source: str, name: str, shift: int, default: float) -> Column:
        at = F.array_position("features", F.lit(name))
        return F.when(at > 0, F.get(source, (at - 1 + shift).cast("int"))).otherwise(F.lit(default))
    return params.select(
        "model", F.col("fold_key"), F.col("l2"), "refit_rows", "intercept", "slope", F.get("coef", F.lit(0)).alias("bias"),
        *[c for i, name in enumerate(inputs) for c in (of("mean", name, 0, 0.0).alias(f"mean_{i}"), of("scale", name, 0, 1.0).alias(f"scale_{i}"),
                                                       of("coef", name, 1, 0.0).alias(f"coef_{i}"),
                                                       F.array_contains("features", name).alias(f"has_{i}"))])


def _linear(inputs: Sequence[str]) -> tuple[list[Column], Column]:
    z = [F.when(F.col(f"has_{i}"), (F.col(c).cast("double") - F.col(f"mean_{i}")) / F.col(f"scale_{i}")).otherwise(0.0) for i, c in enumerate(inputs)]
    eta = F.col("bias")
    for i, x in enumerate(z):
        eta = eta + x * F.col(f"coef_{i}")
    return z, eta


def fit_certificates(params: DataFrame, fitted: DataFrame, inputs: Sequence[str], *, offset: str | None = None, tolerance: float = 1e-7) -> DataFrame:
    """Per model: n (rows it was fitted on), ``scaled`` (means and scales are those of the rows) and ``optimal`` (no part of the penalised
    gradient exceeds ``tolerance``). ``fitted`` has fold, y and the inputs, of exactly the rows that were fitted."""
    inputs = list(inputs)
    small = laid_out(params, inputs)
    rows = fitted.join(F.broadcast(small), F.col("fold").cast("string") == F.col("fold_key"))
    z, eta = _linear(inputs)
    if offset:
        eta = eta + logit(offset)
    # Written, so that the sums below read columns and do not repeat the expressions behind them.
    rows = materialize(rows.select("model", "y", eta.alias("eta"), *[x.alias(f"z_{i}") for i, x in enumerate(z)],
                                   *[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(inputs)]), "certificate-rows")
    miss = expit("eta") - F.col("y")
    k = range(len(inputs))
    sums = rows.groupBy("model").agg(F.count("*").alias("n"), F.avg(miss).alias("g"), *[F.avg(miss * F.col(f"z_{i}")).alias(f"g_{i}") for i in k],
                                     *[F.avg(f"x_{i}").alias(f"a_{i}") for i in k], *[F.stddev_pop(f"x_{i}").alias(f"s_{i}") for i in k])
    j = small.join(sums, "model")
    both = lambda cs: F.forall(F.array(*cs), lambda c: c)
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b))
    own = lambda i, c: ~F.col(f"has_{i}") | c
    scaled = both([own(i, near(F.col(f"mean_{i}"), F.col(f"a_{i}")) & near(
        F.col(f"scale_{i}"), F.when(F.col(f"s_{i}") < 1e-8, 1.0).otherwise(F.col(f"s_{i}")))) for i in k])
    optimal = both([F.abs(F.col("g")) <= tolerance, *[own(i, F.abs(F.col(f"g_{i}") + 2 * F.col("l2") * F.col(f"coef_{i}")) <= tolerance) for i in k]])
    return j.select("model", "n", (F.col("n") == F.col("refit_rows")).alias("rows_agree"), scaled.alias("scaled"), optimal.alias("optimal"))


def scores_of(params: DataFrame, rows: DataFrame, inputs: Sequence[str], *, offset: str | None = None) -> DataFrame:
    """model, contest_id, y, raw and calibrated probability of every row, from the parameters alone."""
    joined = rows.join(F.broadcast(laid_out(params, list(inputs))), F.col("fold").cast("string") == F.col("fold_key"))
    _, eta = _linear(list(inputs))
    if offset:
        eta = eta + logit(offset)
    raw = materialize(joined.select("model", "contest_id", "y", "intercept", "slope", expit(eta).alias("raw")), "certificate-scores")
    return raw.select("model", "contest_id", "y", "raw", expit(F.col("intercept") + F.col("slope") * logit("raw")).alias("p"), "intercept", "slope")


def calibration_certificates(params: DataFrame, held: DataFrame, inputs: Sequence[str], *, offset: str | None = None, pull: float = 0.001,
                             bound: float = 3.0, tolerance: float = 1e-7) -> DataFrame:
    """Per model: n_calibration and ``calibrated``: intercept a and v = log slope minimise the mean loss plus pull * (a^2 + v^2) within the bounds."""
    s = scores_of(params, held, inputs, offset=offset)
    z, miss = logit("raw"), F.col("p") - F.col("y")
    g = s.groupBy("model", "intercept", "slope").agg(F.count("*").alias("n_calibration"), F.avg(miss).alias("ga"), F.avg(miss * F.col("slope") * z).alias("gv"))
    a, v = F.col("intercept"), F.ln("slope")

    def settled(x: Column, slope: Column) -> Column:
        edge = 1e-9
        return (F.abs(slope) <= tolerance) | ((x <= -bound + edge) & (slope > 0)) | ((x >= bound - edge) & (slope < 0))
    ok = settled(a, F.col("ga") + 2 * pull * a) & settled(v, F.col("gv") + 2 * pull * v)
    return g.select("model", "n_calibration", ok.alias("calibrated"))
