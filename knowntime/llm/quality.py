"""Quality rules by tokeniser fertility: text that public vocabularies cut unlike other text of its language is rejected."""

from __future__ import annotations

from itertools import chain, islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowntime.llm.common import WHITE, per_text, saved

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Metric, width of a histogram bin, and which sides of the band reject.
BANDS = (("chars_per_token", 0.01, "both"), ("chars_per_unit", 0.01, "both"), ("byte_share", 0.001, "high"), ("entropy", 0.001, "low"))
#: Quartile distances from the quartiles to the ends of a band.
REACH = 4.0
METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "chars_per_token double, chars_per_unit double, byte_share double, entropy double")


class Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Cuts:
    """How two vocabularies cut words: a table of bounded size, afresh when it has grown past its limit.

    A word has a number; its tokens of the first vocabulary lie in one flat array, its token count of the second in another.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str, limit: int):
        import base64

        import sentencepiece
        import tiktoken
        self.sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        with open(ranks, "rb") as f:
            order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.units = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=order, special_tokens={})
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number, self.flat, self.starts, self.n_units = Numbers(), np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int32)

    def codes(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; new words are cut in one go."""
        if len(self.number) > self.limit:
            self.clear()
        known = len(self.number)
        codes = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > known:
            fresh = [w.decode("utf-8", "replace") for w in islice(self.number, known, None)]
            pieces = self.sp.encode(fresh, num_threads=1)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(pieces), np.int32, int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            count = self.units.encode_ordinary
            self.n_units = np.concatenate([self.n_units, np.fromiter((len(count(" " + w)) for w in fresh), np.int32, len(fresh))])
        return codes

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of a run of words, in order."""
        first, sizes = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)]


def repeated_words(codes: np.ndarray, n_codes: int) -> int:
    """Words inside three-word windows that occur at least twice in the sequence."""
    if len(codes) < 4:
        return 0
    three = np.lib.stride_tricks.sliding_window_view(codes, 3)
    if n_codes < 1 << 21:
        keys = (three[:, 0] << 42) | (three[:, 1] << 21) | three[:, 2]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(three, axis=0, return_inverse=True, return_counts=True)
    if len(counts) == len(three):
        return 0
    again = counts[inverse.ravel()] >= 2
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def measure(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, drop: tuple[str, ...] = (), cache: int = 250_000) -> DataFrame:
    """Append the base counts and the fertility metrics of each text; one pass, no shuffle.

    ``vocabulary``: a sentencepiece model with byte fallback; ``ranks``: a tiktoken rank file for another, cut by
    ``pattern``. Words are cut one by one, so a bounded table of frequent words serves most of them. Metrics: code points of
    words per token of each vocabulary, share of byte-fallback tokens, and token entropy over the log of the token count (1
    where all tokens differ). A text without words has 0 words and null metrics.
    """
    held: dict = {}                                    # a task's table

    def fn(texts: list[str]) -> list[tuple]:
        cuts = held.get("cuts") or held.setdefault("cuts", Cuts(vocabulary, ranks, pattern, cache))
        split = [text.encode("utf-8", "replace").split() for text in texts]
        all_codes = cuts.codes(list(chain.from_iterable(split)))
        out, at = [], 0
        for text, words in zip(texts, split):
            n = len(words)
            codes = all_codes[at:at + n]
            at += n
            chars = len(text) - sum(map(text.count, WHITE))
            symbols = sum(map(text.count, SYMBOLS))
            lines = [x for x in text.split("\n") if x.strip(WHITE)]
            if not n:
                out.append((0, chars, symbols, 0, 0, None, None, None, None))
                continue
            tokens = cuts.tokens(codes)
            m = len(tokens)
            counts = np.bincount(tokens)
            share = counts[counts > 0] / m
            entropy = float(-(share * np.log(share)).sum() / np.log(m)) if m > 1 else 1.0
            out.append((n, chars, symbols, len(lines) - len(set(lines)), repeated_words(codes, len(cuts.number)),
                        chars / m, chars / int(cuts.n_units[codes].sum()), float(cuts.is_byte[tokens].mean()), entropy))
        return out

    def ended() -> None:
        held.clear()

    return per_text(docs, "text", METRICS, fn, drop, ended=ended)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def language() -> Column:
    """Language of a row; rows without one form a group of their own."""
    return F.coalesce("lang", F.lit("und"))


def bands(measured: DataFrame, reach: float) -> DataFrame:
    """Per language and metric: quartiles over all rows that pass the base rules, widened by ``reach`` quartile distances.

    Exact quartiles of binned values: counts per bin are summed before the shuffle, then one row per bin is accumulated.
    """
    rows = measured.where(~base_failed()).select(
        language().alias("_lang"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.floor(F.col(m) / w).alias("bin"), F.lit(w).alias("w"))
                                                       for m, w, _ in BANDS])).alias("x")).select("_lang", "x.*")
    bins = rows.groupBy("_lang", "metric", "bin", "w").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("_lang", "metric")
    run = bins.withColumns({"upto": F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("n").over(by)})
    at = [F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 0.5) * F.col("w"))).alias(c) for q, c in ((0.25, "q1"), (0.75, "q3"))]
    cut = run.groupBy("_lang", "metric").agg(*at, F.max("w").alias("w"))
    wide = F.greatest(F.col("q3") - F.col("q1"), 5 * F.col("w")) * reach
    low, high = (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high")
    return cut.select("_lang", "metric", F.struct(low, high).alias("band")).groupBy("_lang").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "band"))).alias("_bands"))     # one entry per metric


def judge(measured: DataFrame, reach: float = REACH) -> DataFrame:
    """Append base_failed, fertility_failed (the metrics outside their language's band, comma-separated) and kept.

    Text whose language has no band (no row passed the base rules) fails by the base rules alone.
    """
    def outside(m: str, side: str) -> Column:
        v, band = F.col(m), F.col("_bands")[m]
        low, high = v < band["low"], v > band["high"]
        return F.coalesce(low | high if side == "both" else high if side == "high" else low, F.lit(False))

    failed = F.concat_ws(",", *[F.when(outside(m, side), m) for m, _, side in BANDS])
    return (measured.withColumn("_lang", language()).join(bands(measured, reach), "_lang", "left")
            .withColumns({"base_failed": base_failed(), "fertility_failed": failed}).drop("_bands", "_lang")
            .withColumn("kept", ~F.col("base_failed") & (F.col("fertility_failed") == "")))


def rate_quality(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, reach: float = REACH, drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """Measure every document (doc_id, text, lang, ...) once, keep the figures in the shared folder, and judge them."""
    return judge(saved(measure(docs, vocabulary, ranks, pattern, drop), "quality"), reach)
