"""Boosted trees as the secondary model: MLlib's gradient boosting over a small grid.

The trees of a smaller ensemble are a prefix of a larger one with the same depth, so one fit
per depth serves every tree count: the tuning loss is read off each prefix.

A fit is hundreds of short jobs one after another; the fits of all depths and folds run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from knowntime.functions.prob import log_loss, logit
from knowntime.session import scratch_root

# The candidate grid and the step size.
DEPTHS, TREES, STEP, MIN_ROWS = (2, 3), (100, 250), 0.03, 20


def _prepared(rows: DataFrame, inputs: Sequence[str], offset: str | None) -> DataFrame:
    cols = list(inputs)
    if offset:
        rows, cols = rows.withColumn("_offset", logit(offset)), [*cols, "_offset"]
    typed = rows.select("*", *[F.col(c).cast("double").alias(f"_in_{i}") for i, c in enumerate(cols)])
    out = VectorAssembler(inputCols=[f"_in_{i}" for i in range(len(cols))], outputCol="_v").transform(typed)
    return out.withColumn("_label", F.col("y").cast("double"))


def _learner(depth: int, trees: int, seed: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="_v", labelCol="_label", maxDepth=depth, maxIter=trees, stepSize=STEP,
                         minInstancesPerNode=MIN_ROWS, seed=seed)


def side_by_side(spark, work: Callable, items: Sequence) -> list:
    """``work`` on every item at once, each from a thread of its own."""
    if len(items) < 2:
        return [work(x) for x in items]
    tasks = [inheritable_thread_target(spark)(partial(work, x)) for x in items]     # wrapped one by one: each has its own properties
    with ThreadPool(len(tasks)) as pool:
        return pool.map(lambda task: task(), tasks, chunksize=1)


def per_fold(rows: DataFrame, work: Callable, fold: str = "fold") -> dict:
    """``work`` on the rows of each fold, side by side; results by fold."""
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())   # one row per fold
    return dict(zip(folds, side_by_side(rows.sparkSession, lambda f: work(rows.where(F.col(fold) == f)), folds)))


def _cut_lineage(spark) -> None:
    """The learner cuts the lineage of its residuals every ten trees, if the context has a folder for it."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{scratch_root(spark).rstrip('/')}/knowntime/boosting")


def tune(rows: DataFrame, inputs: Sequence[str], *, depths: Sequence[int] = DEPTHS, trees: Sequence[int] = TREES,
         offset: str | None = None, seed: int = 42) -> list[dict]:
    """Tuning loss of every (depth, trees)."""
    data = _prepared(rows, inputs, offset).select("split", "_v", "_label")
    train, held = data.where("split = 'train'").cache(), data.where("split = 'tune'").cache()
    _cut_lineage(rows.sparkSession)
    paths = side_by_side(rows.sparkSession, lambda depth: _learner(depth, max(trees), seed).fit(train).evaluateEachIteration(held), depths)
    train.unpersist(), held.unpersist()
    return [{"depth": depth, "trees": n, "tune_loss": float(path[n - 1])} for depth, path in zip(depths, paths) for n in trees]


def tune_and_fit(rows: DataFrame, inputs: Sequence[str], *, depths: Sequence[int] = DEPTHS, trees: Sequence[int] = TREES,
                 offset: str | None = None, seed: int = 42):
    """Pick (depth, trees) by tuning loss, refit on train + tune; returns (model, trials).

    Boosting here takes no per-row starting margin, so an ``offset`` probability enters as one
    more input (its logit).
    """
    trials = tune(rows, inputs, depths=depths, trees=trees, offset=offset, seed=seed)
    best = min(trials, key=lambda t: t["tune_loss"])
    fitted = _prepared(rows, inputs, offset).where("split IN ('train', 'tune')").select("_v", "_label")
    return _learner(best["depth"], best["trees"], seed).fit(fitted), trials


def predict(model, rows: DataFrame, inputs: Sequence[str], *, offset: str | None = None) -> DataFrame:
    """Adds ``p_raw``, the probability of the home side."""
    out = model.transform(_prepared(rows, inputs, offset)).withColumn("p_raw", vector_to_array("probability")[1])
    return out.select(*rows.columns, "p_raw")


def tuning_table(spark, trials: dict[int, Sequence[dict]]) -> DataFrame:
    """(fold, depth, trees, tune_loss) from every fold's trials."""
    rows = [(f, t["depth"], t["trees"], t["tune_loss"]) for f, of_fold in trials.items() for t in of_fold]
    return spark.createDataFrame(rows, "fold int, depth int, trees int, tune_loss double")


def scores(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.count("*").alias("n"), F.avg(log_loss("y", "p_raw")).alias("log_loss"))
