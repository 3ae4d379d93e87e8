"""Probability expressions: clipped logits, stable losses, three-way outcomes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clip(p, eps: float = 1e-9) -> Column:
    return F.greatest(F.least(_c(p), F.lit(1.0 - eps)), F.lit(eps))


def logit(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return F.ln(q / (1 - q))


def expit(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def softplus(z) -> Column:
    """log(1 + exp(z)) without overflow."""
    z = _c(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_loss(y, p, eps: float = 1e-9) -> Column:
    q = clip(p, eps)
    return -(_c(y) * F.ln(q) + (1 - _c(y)) * F.log1p(-q))


def brier(y, p) -> Column:
    return F.pow(_c(p) - _c(y), F.lit(2.0))


def correct(y, p) -> Column:
    """1 when the favoured side won; one half and above favours home."""
    return ((_c(p) >= 0.5) == (_c(y) == 1)).cast("double")


def three_way(p_decided, p_tie) -> tuple[Column, Column, Column]:
    """(away, tie, home) from a decided-only probability and a tie rate."""
    p = clip(p_decided, 1e-9)
    t = F.greatest(F.least(_c(p_tie), F.lit(0.5)), F.lit(0.0))
    return (1 - t) * (1 - p), t, (1 - t) * p
