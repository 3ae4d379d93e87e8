"""Mixing to target weights by soft membership: a classifier fitted on the labelled table says how much of each document belongs to
each domain, and projected gradients fit document rates whose expected domain token totals meet the targets.

Built-in expressions and aggregates only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowntime.llm.common import saved, whole_text

#: Domains of the labelled table, with the condition that puts a labelled row into them.
DOMAINS = (("clean", "quality = 1 and toxic = 0"), ("rough", "quality = 0 and toxic = 0"), ("toxic", "toxic = 1"))
TARGETS = (0.9, 0.1, 0.0)
BUCKETS = 1 << 16
_SPACES = r"[ \t\n\r\u000B\f]+"


def word_buckets(text: Column) -> Column:
    """Hash buckets of the lower-cased words."""
    words = F.filter(F.split(F.lower(text), _SPACES), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit_domains(docs: DataFrame, labels: DataFrame, domains: Sequence[tuple[str, str]] = DOMAINS, most: int = 5000, sure: float = 4.0) -> list[list[float]]:
    """Multinomial naive Bayes on at most ``most`` labelled rows (least hashes of doc_id): per domain its log prior, then a weight
    per word bucket.

    A bucket's weight is its log-odds for the domain against the rest where that is ``sure`` standard errors from 0, else 0. The
    driver gets these (domains x buckets) numbers, whatever the size.
    """
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.join(chosen, "doc_id").select("doc_id", *[F.expr(f"int({c})").alias(f"d{i}") for i, (_, c) in enumerate(domains)],
                                              word_buckets(whole_text()).alias("words"))
    rows = saved(rows, "labelled")
    k = range(len(domains))
    size = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"d{i}").alias(f"d{i}") for i in k]).first()
    counts = rows.select(*[f"d{i}" for i in k], F.explode("words").alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"d{i}").alias(f"c{i}") for i in k])
    counts = saved(counts, "labelled")
    total = counts.agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in k]).first()
    priors = [math.log(((size[f"d{i}"] or 0) + 1) / ((size["n"] or 0) + len(domains))) for i in k]

    def weight(i: int) -> Column:
        inside, rest = F.col(f"c{i}") + 0.5, F.col("n") - F.col(f"c{i}") + 0.5
        n_in, n_rest = float(total[f"c{i}"] or 0) + 1, float((total["n"] or 0) - (total[f"c{i}"] or 0)) + 1
        odds = F.log(inside / n_in) - F.log(rest / n_rest)
        return F.when(F.abs(odds) > sure * F.sqrt(1 / inside + 1 / rest), odds).otherwise(F.lit(0.0))

    out = [[0.0] * BUCKETS for _ in k]
    weighed = counts.select("bucket", *[weight(i).alias(f"w{i}") for i in k]).where(reduce(lambda a, b: a | b, [F.col(f"w{i}") != 0 for i in k]))
    for r in weighed.collect():
        for i in k:
            out[i][r["bucket"]] = r[f"w{i}"]
    return [[p, *w] for p, w in zip(priors, out)]


def posteriors(docs: DataFrame, model: list[list[float]], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens (words) and p (a share per domain that add up to 1); a text without words gets the priors."""
    k = range(len(model))
    tables = [F.from_json(F.lit(json.dumps(m[1:])), "array<double>") for m in model]       # folded to a constant once
    start = F.struct(*[F.lit(m[0]).alias(f"s{i}") for i, m in enumerate(model)])
    score = F.aggregate("words", start, lambda acc, b: F.struct(*[(acc[f"s{i}"] + F.get(tables[i], b)).alias(f"s{i}") for i in k]))
    rows = docs.select(*keep, word_buckets(whole_text()).alias("words")).select(
        *keep, F.size("words").cast("long").alias("n_tokens"), score.alias("s"))
    top = F.greatest(*[F.col(f"s.s{i}") for i in k])
    rows = rows.select(*keep, "n_tokens", *[F.exp(F.col(f"s.s{i}") - top).alias(f"e{i}") for i in k])
    whole = reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in k])
    return rows.select(*keep, "n_tokens", F.array(*[F.col(f"e{i}") / whole for i in k]).alias("p"))


def rate_after(pulls: Sequence[Sequence[float]], pull_home: float, step: float) -> Column:
    """A document's rate after the given residuals: each step goes down the gradient and is cut off at 0."""
    rate = F.lit(1.0)
    for e in pulls:
        slope = reduce(lambda a, b: a + b, [F.get("p", F.lit(i)) * float(x) for i, x in enumerate(e)])
        rate = F.greatest(F.lit(0.0), rate * (1 - step * pull_home) + (step * pull_home - step * slope))
    return rate


def fit_rates(members: DataFrame, targets: Sequence[float] = TARGETS, iterations: int = 12, pull_home: float = 0.02) -> tuple[DataFrame, list[float]]:
    """Rates of documents (n_tokens, p) whose expected domain totals are nearest to ``targets`` times all tokens.

    Projected gradient on |sum(rate * tokens * p) - target|^2 plus a slight pull to a rate of 1. The gradient is taken per token and
    scaled by the inverse of the domains' second moments (a domains x domains matrix), so few steps suffice. A step needs one
    aggregate over the narrow table: a rate is a fold over the residuals so far, so nothing is written between steps, and one
    number per domain reaches the driver. The steps up to the least residual count. Returns members with ``rate``, and the shares reached.
    """
    k = range(len(targets))
    moments = members.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"m{i}_{j}")
                                                          for i in k for j in k]).first()
    total = float(moments["n"] or 0)
    metric = np.array([[float(moments[f"m{i}_{j}"] or 0) / (total or 1) for j in k] for i in k]) + pull_home * np.eye(len(targets))
    pulls: list[list[float]] = []
    tried: list[tuple[float, list[float]]] = []
    step = 0.8
    for _ in range(iterations + 1):
        weight = rate_after(pulls, pull_home, step) * F.col("n_tokens")
        row = members.agg(*[F.sum(weight * F.get("p", F.lit(i))).alias(f"t{i}") for i in k]).first()
        share = [float(row[f"t{i}"] or 0) / total if total else 0.0 for i in k]
        residual = np.array(share) - np.array(targets)
        tried.append((float(np.abs(residual).sum()), share))
        pulls.append(np.linalg.solve(metric, residual).tolist())
    best = min(range(len(tried)), key=lambda i: tried[i][0])
    return members.withColumn("rate", rate_after(pulls[:best], pull_home, step)), tried[best][1]


def mix(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, keep: Sequence[str] = ("doc_id",), most: int = 5000) -> DataFrame:
    """Posteriors, rate and copies of every document (doc_id, text): copies is the rate's whole part, plus one with the chance of the
    rest, drawn from a hash of id, word count and posteriors (so a rerun draws alike).

    ``reached`` (alike in all rows) has the expected share of each domain in words, over all words of the input: how far it is from
    ``targets`` tells whether they can be met, as rates are nonnegative but a domain may lack words. A null or empty text has no tokens: it weighs nothing and its rate follows its priors. Repeated rows are rated alike.
    """
    model = fit_domains(docs.select("doc_id", "text"), labels, most=most)
    members = saved(posteriors(docs, model, keep), "members")
    rated, shares = fit_rates(members, targets)
    reached = F.array(*[F.lit(float(x)) for x in shares]).alias("reached")
    names = [d for d, _ in DOMAINS]
    draw = F.pmod(F.xxhash64("doc_id", "n_tokens", "p"), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("int")).select(
        *keep, "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(names)], "rate", "copies", reached)
