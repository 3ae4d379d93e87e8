"""Secret scans: three fixed patterns, and beside them two character Markov models that tell random strings from ordinary identifiers.

Both models are tables of transition frequencies, counted over labelled strings: random are the values that the patterns find,
ordinary are words that stand outside them; callers may add labelled strings of their own. A long token that no pattern touches is a
secret where the log-likelihood ratio of the models says so. Built-in expressions and aggregates only.

Places come without a UDF: the pieces between a pattern's matches and the matches themselves alternate, so running sums of
their lengths are the matches' starts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowntime.llm.common import saved, whole_text

# The patterns of the base rules, the least length of what they find, and the kinds in the order of listing.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"                          # AKIA and more, 18 characters at least
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")

#: What a token to be judged by the models consists of, and how long it is at least.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z_][A-Za-z0-9+/_=-]{7,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LETTERS = len(ALPHABET)


def matches(text: Column, kind: int, pattern: str) -> Column:
    """Array of (kind, gap, length, value): each match with the count of code points between it and the one before."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(pieces, found, lambda p, m: F.struct(F.lit(kind).alias("kind"), F.char_length(p).cast("long").alias("gap"),
                                                           F.char_length(m).cast("long").alias("length"), m.alias("value")))
    return F.filter(rows, lambda r: r["length"].isNotNull())


def transitions(token: Column) -> Column:
    """Numbers of the pairs of neighbouring characters; characters outside the alphabet part a token."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = F.size(codes)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(codes, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.when((a >= 0) & (b >= 0), a * LETTERS + b))
    return F.filter(pairs, lambda p: p.isNotNull())


def log_ratio(token: Column, model: list[float]) -> tuple[Column, Column]:
    """Log-likelihood ratio (random to ordinary) of a token, and the count of its transitions."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")      # folded to a constant once
    pairs = transitions(token)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.get(table, p)), F.size(pairs)


def fit_ratio(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-ratios of the two models' transition frequencies, from (sample, random) rows.

    The driver gets one count per model and pair of characters, whatever the size.
    """
    counts = (labelled.where("sample is not null and random is not null").select("random", F.explode(transitions(F.col("sample"))).alias("pair"))
              .groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")))
    n = {True: [0] * LETTERS ** 2, False: [0] * LETTERS ** 2}
    for r in counts.collect():
        n[r["random"]][r["pair"]] = r["n"]

    def logs(c: list[int]) -> list[float]:
        out = []
        for a in range(LETTERS):
            row = c[a * LETTERS:(a + 1) * LETTERS]
            whole = sum(row) + smooth * LETTERS
            out += [math.log((x + smooth) / whole) for x in row]
        return out
    return [r - o for r, o in zip(logs(n[True]), logs(n[False]))]


def with_places(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of every match of a table (row, found)."""
    each = found.select("row", F.posexplode("found").alias("at", "m")).select("row", "at", "m.*")
    upto = F.sum(F.col("gap") + F.col("length")).over(W.partitionBy("row", "kind").orderBy("at"))
    return each.select("row", "kind", (upto - F.col("length")).alias("start"), upto.alias("end"), "value")


def ordinary_words(docs: DataFrame, most: int) -> DataFrame:
    """Distinct words outside all base matches of about ``most`` documents, drawn by hash, that at least two different texts have (a secret
    without a name stands in one)."""
    every = max(1, docs.count() // most)
    bare = whole_text()
    for p in (ASSIGN, ACCESS, HEX):
        bare = F.regexp_replace(bare, p, " ")
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.char_length("text")), F.lit(every)) == 0)
    words = drawn.select(F.xxhash64("text").alias("in"), F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0)))).alias("sample"))
    return words.groupBy("sample").agg(F.min("in").alias("a"), F.max("in").alias("b")).where("a < b").select("sample")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, most: int = 4000, prior: float = 1e-4, spare: float = 0.99) -> DataFrame:
    """Secrets in every text of (doc_id, text): doc_id, n_assign, n_access, n_hex, n_markov, base (spans of the patterns) and spans
    (all), both as kind:start:end by start and kind, comma-joined, in code points with the end exclusive.

    A token is added where its log-likelihood ratio exceeds the odds against secrets (``prior``) and its ratio per transition that
    of ``spare`` of the ordinary words held out; tokens that touch a base span are part of it already. Labelled strings: base values and
    words of about ``most`` documents each, by hash, and the rows of ``labelled`` (sample, random). Null and empty texts have no spans;
    repeated rows get one result each; other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    text = whole_text()
    hits = [matches(text, k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))]
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*hits).alias("found")), "secrets")
    value = F.when(F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    placed = with_places(rows.where(F.size("found") > 0)).withColumn("value", value).where(
        f"kind > 0 or char_length(value) >= {ASSIGN_LEAST}")

    # a token goes where a base span begins before its end and ends after its start
    by_start = W.partitionBy("row").orderBy("start")
    begun = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(by_start.rangeBetween(W.unboundedPreceding, W.currentRow))
    next_ = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(by_start.rangeBetween(W.currentRow, W.unboundedFollowing))
    free = (F.coalesce(begun, F.lit(-1)) <= F.col("start")) & (F.coalesce(next_, F.col("end")) >= F.col("end"))
    spans = saved(placed.withColumn("free", free).where("kind < 3 or free").drop("free"), "secrets")

    values = spans.where("kind < 3")
    every = max(1, values.count() // most)
    random = values.where(F.pmod(F.xxhash64("row", "start"), F.lit(every)) == 0).select(F.col("value").alias("sample")).distinct()
    samples = random.withColumn("random", F.lit(True)).unionByName(ordinary_words(docs, most).withColumn("random", F.lit(False)))
    if labelled is not None:
        samples = samples.unionByName(labelled.select("sample", F.col("random").cast("boolean").alias("random")))
    samples = saved(samples, "labelled")
    held = (F.pmod(F.xxhash64("sample"), F.lit(4)) == 0) & ~F.col("random")
    model = fit_ratio(samples.where(~held))
    ratio, steps = log_ratio(F.col("sample"), model)
    edge = samples.where(held & (F.char_length("sample") >= 12)).agg(F.percentile_approx(ratio / F.greatest(steps, F.lit(1)), spare, 10000)).first()[0]

    ratio, steps = log_ratio(F.col("value"), model)
    secret = (ratio > math.log((1 - prior) / prior)) & (ratio > F.lit(float(edge or 0.0)) * steps)
    kept = values.unionByName(spans.where("kind = 3").where(secret))
    named = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"], s["end"])), ",")
    each = F.struct("start", "kind", "end")
    of = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}")
    found = kept.groupBy("row").agg(*[of(k) for k in range(4)], F.sort_array(F.collect_list(each)).alias("all"))
    found = found.select("row", *[f"n_{k}" for k in KINDS], joined(F.filter("all", lambda s: s["kind"] < 3)).alias("base"), joined(F.col("all")).alias("spans"))
    return rows.select("row", "doc_id").join(found, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))
