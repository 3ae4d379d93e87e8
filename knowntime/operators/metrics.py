"""Proper scores, calibration tables and rule checks as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from knowntime.functions.prob import brier, clip, correct, log_loss, three_way


def long_form(frame: DataFrame, models: Sequence[str], prefix: str = "p_") -> DataFrame:
    """One row per scored item and model: ``model``, ``p``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(prefix + m).alias("p")) for m in models])
    keep = [c for c in frame.columns if c not in {prefix + m for m in models}]
    return frame.withColumn("_m", F.explode(pairs)).select(*keep, "_m.*")


def score(frame: DataFrame, keys: Sequence[str], *, y: str = "y", p: str = "p") -> DataFrame:
    """Rows, log loss, Brier and accuracy per group."""
    return frame.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(log_loss(y, p)).alias("log_loss"),
        F.avg(brier(y, p)).alias("brier"), F.avg(correct(y, p)).alias("accuracy"))


def decile_bin(p: str = "p") -> Column:
    """Bin ``[low, low + 0.1)`` with ``low = i * 0.1``; NULL outside (p = 1 falls out)."""
    out = F.lit(None).cast("int")
    for i in reversed(range(10)):
        low = i * 0.1
        out = F.when((F.col(p) >= low) & (F.col(p) < low + 0.1), i).otherwise(out)
    return out


def clipped_bin(p: str = "p", bins: int = 10) -> Column:
    """``floor(p * bins)`` kept inside 0..bins-1."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(p) * bins).cast("int")))


def edge_bin(p: Column, bins: int = 20) -> Column:
    """Number of inner edges ``i / bins`` at or below p."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e <= p))


def reliability(frame: DataFrame, keys: Sequence[str], bin_column: Column, *, y: str = "y",
                p: str = "p") -> DataFrame:
    """Count, mean forecast and observed rate per bin."""
    return (frame.withColumn("bin", bin_column).where("bin IS NOT NULL").groupBy(*keys, "bin")
            .agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"),
                 F.avg(F.col(y).cast("double")).alias("observed")))


def calibration_error(table: DataFrame, keys: Sequence[str], name: str = "ece") -> DataFrame:
    """Weighted mean gap of a reliability table."""
    gap = F.abs(F.col("mean_p") - F.col("observed")) * F.col("n")
    return table.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias(name))


def classwise_error(frame: DataFrame, keys: Sequence[str], *, bins: int = 20, y: str = "y",
                    p: str = "p") -> DataFrame:
    """ECE of the home class, and its mean with the away class binned on 1 - p."""
    flip = frame.withColumn("_c", F.explode(F.array(
        F.struct(F.lit(1).alias("k"), F.col(p).alias("p"), F.col(y).cast("double").alias("y")),
        F.struct(F.lit(0).alias("k"), (1 - F.col(p)).alias("p"), (1.0 - F.col(y)).alias("y")))))
    both = flip.select(*keys, "_c.*")
    per = calibration_error(reliability(both, [*keys, "k"], edge_bin(F.col("p"), bins)), [*keys, "k"])
    return per.groupBy(*keys).agg(F.max(F.when(F.col("k") == 1, F.col("ece"))).alias("ece"),
                                  F.avg("ece").alias("classwise_ece"))


def three_way_score(frame: DataFrame, keys: Sequence[str], *, p: str = "p", p_tie: str = "p_tie") -> DataFrame:
    """Metrics over away / tie / home, plus the decided-only view."""
    away, tie, home = three_way(p, p_tie)
    is_tie, y = F.col("is_tie") == 1, F.col("y")
    chosen = F.when(is_tie, tie).when(y == 1, home).otherwise(away)
    hot = lambda c: c.cast("double")
    sq = (F.pow(away - hot(~is_tie & (y == 0)), F.lit(2.0)) + F.pow(tie - hot(is_tie), F.lit(2.0))
          + F.pow(home - hot(~is_tie & (y == 1)), F.lit(2.0)))
    decided = lambda c: F.avg(F.when(~is_tie, c))
    return frame.groupBy(*keys).agg(
        F.count("*").alias("games"), F.count_if(is_tie).alias("ties"),
        F.avg(-F.ln(F.greatest(chosen, F.lit(1e-9)))).alias("three_way_log_loss"),
        F.avg(sq).alias("three_way_brier"), F.count_if(~is_tie).alias("decided_games"),
        decided(log_loss("y", p)).alias("decided_log_loss"),
        decided(brier("y", clip(p))).alias("decided_brier"),
        decided(correct("y", p)).alias("decided_accuracy"))


def shrunk_rate(event: Column, prior_rate: float = 0.002, prior_weight: float = 500.0) -> Column:
    """Base rate pulled to a long-run prior."""
    return (F.sum(event) + F.lit(prior_rate * prior_weight)) / (F.count("*") + F.lit(prior_weight))


def identity_gaps(frame: DataFrame, variant: str, variants: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Keys not scored exactly once by every variant; empty when all variants agree."""
    per = frame.groupBy(*keys).agg(F.count("*").alias("rows"), *[
        F.count_if(F.col(variant) == v).alias(f"_v{i}") for i, v in enumerate(variants)])
    odd = F.col("rows") != len(variants)
    for i in range(len(variants)):
        odd = odd | (F.col(f"_v{i}") != 1)
    return per.where(odd).select(*keys, "rows")


def slope_norm(coef: Column | str) -> Column:
    """Euclidean norm of the slopes (first entry is the intercept)."""
    c = F.col(coef) if isinstance(coef, str) else coef
    rest = F.slice(c, F.lit(2), F.size(c))
    return F.sqrt(F.aggregate(rest, F.lit(0.0), lambda a, x: a + x * x))


def paired_difference(y, p, base, eps: float = 1e-6) -> Column:
    """Per-row loss of ``p`` minus loss of ``base``; negative favours ``p``."""
    return log_loss(y, p, eps) - log_loss(y, base, eps)
