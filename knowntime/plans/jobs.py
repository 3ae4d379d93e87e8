"""Model jobs: folds, ablations, penalties, delays, eras, deployment, paired forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from knowntime.operators import metrics as M
from knowntime.operators.bootstrap import bootstrap_interval
from knowntime.plans.logit import Spec, apply_models, fit_calibration, fit_logistic, materialize, parameter_table

# The base inputs, their groups, and the penalty grid.
BASE = ("margin_diff", "scored_diff", "allowed_diff", "win_rate_diff", "history_count_diff", "home_rest",
        "away_rest", "home_b2b", "away_b2b", "elo_diff", "neutral")
GROUPS = {"scoring": ("margin_diff", "scored_diff", "allowed_diff"), "recent_wins": ("win_rate_diff",),
          "history_count": ("history_count_diff",), "rest": ("home_rest", "away_rest", "home_b2b", "away_b2b"),
          "elo": ("elo_diff",), "neutral": ("neutral",)}
PENALTIES = (0.001, 0.01, 0.1, 1.0)


def ablations(base: Sequence[str] = BASE) -> dict[str, tuple[str, ...]]:
    """Inputs per variant, from a table that says to which group an input belongs: a variant keeps the other groups' inputs."""
    group_of = {f: g for g, members in GROUPS.items() for f in members}
    variants = {"full": None} | {f"without_{g}": g for g in GROUPS}
    return {name: tuple(f for f in base if dropped is None or group_of.get(f) != dropped) for name, dropped in variants.items()}


def tagged(rows: DataFrame, fold: str = "fold", split: str = "split") -> DataFrame:
    """Mark fitting and calibration groups: ``fit:<fold>`` rows train and tune."""
    s, f = F.col(split), F.col(fold).cast("string")
    group = (F.when(s.isin("train", "tune", "fit"), F.concat(F.lit("fit:"), f))
             .when(s == "calibration", F.concat(F.lit("cal:"), f)).otherwise(F.concat(F.lit("val:"), f)))
    return rows.withColumn("group", group).withColumn("fold", f)


def fit_folds(rows: DataFrame, variants: Mapping[str, Sequence[str]], *, l2: Mapping[str, float] | float = 0.01,
              offset: str | None = None, reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit and calibrate every fold x variant together; returns (parameters, scored validation).

    With ``reference``, a scored row also has ``p_ref``, the probability that this variant gives its contest.

    ``rows`` carry fold, split, y, decision_at and the inputs. A variant is a model of its own: means, scales,
    coefficients and calibration all come from its own inputs.
    """
    inputs = sorted({f for v in variants.values() for f in v})
    keep = [c for c in ("contest_id", "league", "season", "decision_at", "y", "is_tie", "p_elo", "fold", "split", "group", *inputs)
            if c in rows.columns or c == "group"]
    t = materialize(tagged(rows).select(*dict.fromkeys(keep)), "fold-rows")
    folds = [r[0] for r in t.select("fold").distinct().collect()]   # one row per fold
    pick = lambda v, f: l2 if isinstance(l2, float) else l2.get(f"{f}|{v}", 0.01)
    specs = [Spec(f"{f}|{v}", f"fit:{f}", tuple(cols), pick(v, f)) for f in sorted(folds) for v, cols in variants.items()]
    fits = fit_logistic(t, specs, offset=offset)
    raw = parameter_table(t.sparkSession, fits).withColumn("fold_key", F.split("model", r"\|")[0])
    off = F.col(offset) if offset else None
    cal = apply_models(t.where("group LIKE 'cal:%'"), raw, inputs, on="fold", params_on="fold_key", offset=off)
    cal = materialize(cal.select("model", "p_raw", "y"), "calibration-rows")   # scanned once per step
    calibrators = fit_calibration(cal, [s.name for s in specs])
    params = parameter_table(t.sparkSession, fits, calibrators).withColumn("fold_key", F.split("model", r"\|")[0])
    held = t.where("group LIKE 'val:%'")
    if reference is not None:
        own = params.where(F.split("model", r"\|")[1] == reference)
        held = apply_models(held, own, inputs, on="fold", params_on="fold_key", offset=off).select(*held.columns, F.col("p").alias("p_ref"))
    scored = apply_models(held, params, inputs, on="fold", params_on="fold_key", offset=off)
    return params, materialize(scored.withColumn("variant", F.split("model", r"\|")[1]), "validation-predictions")


def variant_report(scored: DataFrame, reference: str, *, reps: int = 1000) -> DataFrame:
    """Scores per fold and variant with the paired weekly-block interval against a reference, whose probability of a row's contest may come
    as ``p_ref``."""
    from knowntime.operators.bootstrap import relative_weeks
    scores = M.score(scored, ["fold", "variant"]).join(
        scored.groupBy("fold", "variant").agg(F.avg(M.log_loss("y", "p_raw")).alias("raw_log_loss")), ["fold", "variant"])
    pairs = scored
    if "p_ref" not in scored.columns:
        ref = scored.where(F.col("variant") == reference).select("fold", "contest_id", F.col("p").alias("p_ref"))
        pairs = scored.join(ref, ["fold", "contest_id"])
    # Added up per instant first: instants are as many as the calendar has, and only they meet the first decision of their fold.
    each = pairs.groupBy("fold", "variant", "decision_at").agg(
        F.sum(M.paired_difference("y", "p", "p_ref")).alias("s"), F.count("*").alias("n"), F.sum(F.abs(F.col("p") - F.col("p_ref"))).alias("_c"))
    sums = relative_weeks(each, ["fold"]).groupBy("fold", "variant", "block").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    ci = bootstrap_interval(sums, ["fold", "variant"], reps=reps)
    change = each.groupBy("fold", "variant").agg((F.sum("_c") / F.sum("n")).alias("mean_abs_change"))
    return scores.join(ci, ["fold", "variant"]).join(change, ["fold", "variant"])


def pooled_report(scored: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Pooled scores; refuses to pool unless every variant scored the same rows once."""
    gaps = M.identity_gaps(scored, "variant", variants, ["fold", "contest_id"])
    if gaps.limit(1).count():
        raise ValueError("variants must score identical contests")
    return M.score(scored, ["variant"])


def penalty_trials(rows: DataFrame, inputs: Sequence[str] = BASE, grid: Sequence[float] = PENALTIES) -> tuple[DataFrame, DataFrame]:
    """Per fold the penalty with the lowest raw tuning loss, exact ties to the stronger one; and the parameters of every trial."""
    t = materialize(rows.where("split IN ('train', 'tune')").select("fold", "split", "y", *inputs)
                    .withColumn("group", F.concat_ws(":", "split", F.col("fold").cast("string"))), "penalty-rows")
    folds = [str(r[0]) for r in t.select("fold").distinct().collect()]
    specs = [Spec(f"{f}|{x}", f"train:{f}", tuple(inputs), x) for f in sorted(folds) for x in grid]
    params = parameter_table(t.sparkSession, fit_logistic(t, specs)).withColumn("fold_key", F.split("model", r"\|")[0])
    tune = t.where("split = 'tune'").withColumn("fold", F.col("fold").cast("string")).drop("group", "split")
    trials = (apply_models(tune, params.withColumn("penalty", F.col("l2")), inputs, on="fold", params_on="fold_key")
              .groupBy("fold", "penalty").agg(F.avg(M.log_loss("y", "p_raw")).alias("tune_log_loss")))
    return trials.groupBy("fold").agg(F.min_by("penalty", F.struct("tune_log_loss", -F.col("penalty"))).alias("selected_l2"),
                                      F.min("tune_log_loss").alias("tune_log_loss")), params


def select_penalty(rows: DataFrame, inputs: Sequence[str] = BASE, grid: Sequence[float] = PENALTIES) -> DataFrame:
    """``penalty_trials`` without the parameters."""
    return penalty_trials(rows, inputs, grid)[0]


def deploy(rows: DataFrame, variants: Mapping[str, Sequence[str]]) -> DataFrame:
    """Parameters fitted on train + tune and calibrated later; nothing is scored."""
    one = rows.where("split IN ('train', 'tune', 'calibration')").withColumn("fold", F.lit("deployed"))
    params, _ = fit_folds(one, variants)
    return params.withColumn("model", F.split("model", r"\|")[1])


def paired_forecasts(pending: DataFrame, params: DataFrame, inputs: Sequence[str], recorded: DataFrame, *,
                     issued_at, provenance: str) -> DataFrame:
    """One nested record per pending contest: every model's probability, inputs and provenance.

    Contests recorded before are left out, so a second run writes nothing new.
    """
    fresh = pending.join(recorded.select("contest_id"), "contest_id", "left_anti")
    scored = apply_models(fresh, params, inputs)
    per = scored.groupBy("contest_id", "decision_at").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "p")))).alias("predictions"))
    inputs_map = F.map_from_arrays(F.array(*[F.lit(c) for c in inputs]), F.array(*[F.col(c).cast("double") for c in inputs]))
    return (per.join(fresh.select("contest_id", "p_elo", inputs_map.alias("features")), "contest_id")
            .withColumn("snapshot_id", F.sha2(F.col("contest_id").cast("string"), 256))
            .withColumn("issued_at", issued_at).withColumn("provenance", F.lit(provenance)))
