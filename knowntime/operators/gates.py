"""Gates: whether a forecast has proven itself, and whether a candidate model advances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from knowntime.functions.prob import log_loss
from knowntime.functions.times import epoch_block
from knowntime.operators.bootstrap import block_sums, bootstrap_interval, season_week
from knowntime.operators.metrics import paired_difference, three_way_score


def forecast_gates(predictions: DataFrame, bets: DataFrame, keys: Sequence[str], mode: Column, *, least_gain: float, block_days: int,
                   reps: int = 1000, min_blocks: int = 10) -> DataFrame:
    """Both gates per group of predictions (p_model, p_base, y, decision_at) and bets (return_per_stake, decision_at).

    ``passes``: the relative improvement of the log loss is at least ``least_gain`` and its interval lies above zero.
    ``economic_evidence``: the interval of the yield per stake lies above zero. Without enough blocks there is no interval and no
    evidence; a group whose ``mode`` is synthetic never passes either.
    """
    keys = list(keys)
    gain = bootstrap_interval(block_sums(predictions.withColumn("block", epoch_block("decision_at", block_days)), keys,
                                         paired_difference("y", "p_base", "p_model", 1e-9)), keys, reps=reps, min_blocks=min_blocks)
    base = predictions.groupBy(*keys).agg(F.avg(log_loss("y", "p_base")).alias("_base"))
    paid = bootstrap_interval(block_sums(bets.withColumn("block", epoch_block("decision_at", block_days)), keys, F.col("return_per_stake")),
                              keys, reps=reps, min_blocks=min_blocks)
    paid = paid.select(*keys, F.col("difference").alias("mean_yield"), F.col("low").alias("_yield_low"))
    rel = F.col("difference") / F.col("_base")
    real = mode != "synthetic"
    above = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return gain.join(base, keys).join(paid, keys, "left").select(
        *keys, mode.alias("mode"), rel.alias("relative_improvement"), (real & (rel >= least_gain) & above("low")).alias("passes"),
        "mean_yield", (real & above("_yield_low")).alias("economic_evidence"))


def advancement(scored: DataFrame, candidate: str, baselines: Sequence[str], *, reps: int = 2000, min_blocks: int = 10) -> DataFrame:
    """One row: does ``candidate`` advance past the stronger of ``baselines``?

    ``scored`` has a row per contest and model: contest_id, season (the fold), decision_at, model, p, p_tie, y, is_tie. The
    stronger baseline has the least pooled loss over decided contests (ties: the first named). The candidate must be
    better than it in every fold, the weekly interval of the pooled paired difference must not hold zero, and the pooled three-way
    loss must not be worse.
    """
    baselines = list(baselines)
    per = three_way_score(scored, ["season", "model"])
    pooled = per.groupBy("model").agg((F.sum(F.col("decided_log_loss") * F.col("decided_games")) / F.sum("decided_games")).alias("_decided"),
                                      (F.sum(F.col("three_way_log_loss") * F.col("games")) / F.sum("games")).alias("_three"))
    order = F.coalesce(*[F.when(F.col("model") == b, F.lit(i)) for i, b in enumerate(baselines)])
    best = pooled.where(F.col("model").isin(baselines)).agg(
        F.min_by(F.struct("model", "_three"), F.struct("_decided", order)).alias("_b")).select("_b.model", F.col("_b._three").alias("_three_best"))
    one = lambda frame: frame.withColumn("_one", F.lit(1))
    mine = one(pooled.where(F.col("model") == candidate).select("_three"))
    folds = (per.where(F.col("model") == candidate).select("season", F.col("decided_log_loss").alias("_mine"))
             .join(per.join(best, "model").select("season", F.col("decided_log_loss").alias("_theirs")), "season")
             .agg(F.bool_and(F.col("_mine") < F.col("_theirs")).alias("all_folds_better")))
    wide = scored.where("is_tie = 0").groupBy("contest_id", "season", "decision_at", "y").agg(
        F.max(F.when(F.col("model") == candidate, F.col("p"))).alias("_p"), *[F.max(F.when(F.col("model") == b, F.col("p"))).alias(f"_p{i}")
                                                                              for i, b in enumerate(baselines)])
    pairs = wide.select("season", "decision_at", "y", "_p", F.explode(F.array(*[F.struct(F.lit(b).alias("model"), F.col(f"_p{i}").alias("q"))
                                                                               for i, b in enumerate(baselines)])).alias("_o"))
    pairs = pairs.select("y", "_p", "_o.*", season_week().alias("block"))
    interval = bootstrap_interval(block_sums(pairs, ["model"], paired_difference("y", "_p", "q")), ["model"], reps=reps, min_blocks=min_blocks)
    apart = F.coalesce((F.col("high") < 0) | (F.col("low") > 0), F.lit(False))
    chosen = one(best.join(interval, "model", "left").select(F.col("model").alias("stronger_baseline"), "_three_best",
                                                             apart.alias("pooled_interval_excludes_zero")))
    out = chosen.join(mine, "_one").join(one(folds), "_one")
    ok = F.col("_three") <= F.col("_three_best")
    return out.select(F.lit(candidate).alias("candidate"), "stronger_baseline", "all_folds_better", "pooled_interval_excludes_zero",
                      ok.alias("three_way_not_worse"), (F.col("all_folds_better") & F.col("pooled_interval_excludes_zero") & ok).alias("criteria_met"))
