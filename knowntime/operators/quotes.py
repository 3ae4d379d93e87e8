"""Price quotes as of a decision: latest revisions, de-vig, consensus and offers."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from knowntime.functions.times import micros

QUOTE_FIELDS = ("quote_id", "quote_at", "available_at", "home_odds", "away_odds")


def fair_home(home: str = "home_odds", away: str = "away_odds") -> Column:
    """Proportional de-vig: the home share of the two implied probabilities."""
    return (1 / F.col(home)) / (1 / F.col(home) + 1 / F.col(away))


def overround(home: str = "home_odds", away: str = "away_odds") -> Column:
    return 1 / F.col(home) + 1 / F.col(away) - 1


def valid_prices(home: str = "home_odds", away: str = "away_odds") -> Column:
    """Both decimal prices finite and above one."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 1) & (F.col(c) < float("inf"))
          for c in (home, away)]
    return ok[0] & ok[1]


def latest_quotes(quotes: DataFrame, decisions: DataFrame, *, max_age_us: int,
                  keys: Sequence[str] = ("contest_id",), cutoff: str = "decision_at",
                  fields: Sequence[str] = QUOTE_FIELDS) -> DataFrame:
    """Latest visible revision per decision and book (inclusive cutoff, bounded age).

    A quote counts when quoted and available at or before the cutoff and no older than
    ``max_age_us``. The latest is by (available_at, quote_at, quote_id). Quotes and decisions pass in
    order of time, nothing is paired: a book keeps only the quotes that can still become the
    latest once newer ones expire (``Standing``). A contest is cut into stretches of ``max_age_us``, to
    which a quote belongs at most twice, so a busy one spreads over time. Rows without a key or time
    see and show nothing.
    """
    keys = list(keys)
    known = [F.col(c).isNotNull() for c in keys]
    bucket = lambda c: F.floor(F.col(c) / F.lit(max_age_us)).cast("bigint")
    q = (quotes.where(reduce(and_, [*known, F.col("quote_at").isNotNull(), F.col("available_at").isNotNull()]))
         .select(*keys, F.greatest(micros("quote_at"), micros("available_at")).alias("_time"),
                 (micros("quote_at") + F.lit(max_age_us)).alias("_until"), F.lit(0).alias("_kind"), "book",
                 micros("available_at").alias("_known"), micros("quote_at").alias("_quoted"), F.col("quote_id").alias("_id"),
                 F.struct(*fields).alias("_quote"))
         .where("_time <= _until").withColumn("_stretch", F.explode(F.sequence(bucket("_time"), bucket("_until")))))
    d = (decisions.where(reduce(and_, [*known, F.col(cutoff).isNotNull()]))
         .select(*keys, micros(cutoff).alias("_time"), F.lit(1).alias("_kind"), F.struct(*decisions.columns).alias("_decision"))
         .withColumn("_stretch", bucket("_time")))
    group = [*keys, "_stretch"]
    stack = q.unionByName(d, allowMissingColumns=True).repartition(*group).sortWithinPartitions(*group, "_time", "_kind")
    shape = StructType([stack.schema["_decision"], stack.schema["book"], stack.schema["_quote"]])

    def sweep(batches):
        now, books, held = None, {}, None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            plain = {n: column[n].to_pylist() for n in (*group, "_kind", "_time", "_until", "book", "_known", "_quoted", "_id")}
            # Quotes stay in Arrow: books hold places in what earlier batches left, followed by this batch.
            first = len(held) if held is not None else 0
            pool = pa.concat_arrays([held, column["_quote"]]) if first else column["_quote"]
            who, book, quote = [], [], []
            rows = zip(zip(*[plain[n] for n in group]), plain["_kind"], plain["_time"], plain["_until"], plain["book"],
                       plain["_known"], plain["_quoted"], plain["_id"])
            for i, (g, kind, time, until, name, known_at, quoted, quote_id) in enumerate(rows):
                if g != now:
                    now, books = g, {}
                if kind == 0:
                    standing = books.get(name)
                    if standing is None:
                        standing = books[name] = Standing()
                    standing.add((known_at, quoted, quote_id is not None, quote_id), until, first + i)
                    continue
                for name, standing in books.items():
                    best = standing.latest(time)
                    if best is not None:
                        who.append(i), book.append(name), quote.append(best)
            yield pa.RecordBatch.from_arrays(
                [column["_decision"].take(pa.array(who, pa.int64())), pa.array(book, column["book"].type),
                 pool.take(pa.array(quote, pa.int64()))], names=["_decision", "book", "_quote"])
            kept = [at for standing in books.values() for at in standing.quotes]
            held = pool.take(pa.array(kept, pa.int64()))
            places = iter(range(len(kept)))
            for standing in books.values():
                standing.quotes = [next(places) for _ in standing.quotes]

    got = stack.mapInArrow(sweep, shape)
    return got.select("_decision.*", "book", "_quote.*")


class Standing:
    """One book's quotes that are or may become its latest: the higher a quote ranks, the earlier it expires."""

    def __init__(self):
        self.ranks, self.until, self.quotes = [], [], []

    def add(self, rank: tuple, until: int, quote) -> None:
        at = bisect_left(self.ranks, rank)
        if at < len(self.ranks) and self.until[at] >= until:
            return                                # one that ranks higher outlives it
        low = at
        while low and self.until[low - 1] <= until:
            low -= 1                              # those that rank lower and expire no later
        for kept, new in ((self.ranks, rank), (self.until, until), (self.quotes, quote)):
            kept[low:at] = [new]

    def latest(self, now: int):
        while self.until and self.until[-1] < now:
            self.ranks.pop(), self.until.pop(), self.quotes.pop()
        return self.quotes[-1] if self.quotes else None


def later_quotes(quotes: DataFrame, decisions: DataFrame, *, max_age_us: int, delay_minutes: int,
                 keys: Sequence[str] = ("contest_id",)) -> DataFrame:
    """Per decision and book, the revision a slower reader would see ``delay_minutes`` later.

    Age is measured against the later cutoff, and only quotes that became available after
    the decision count.
    """
    later = decisions.withColumn("_later", F.col("decision_at") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(delay_minutes)))
    got = latest_quotes(quotes, later, max_age_us=max_age_us, keys=keys, cutoff="_later")
    return got.where(F.col("available_at") > F.col("decision_at")).drop("_later")


def consensus(latest: DataFrame, keys: Sequence[str], *, min_books: int,
              cutoff: str = "decision_at", execution_book: Column | str | None = None) -> DataFrame:
    """Median fair probability over the reference books, with spread, age and abstention.

    The book a bet would be placed at (``execution_book``: a name, or a column of ``latest``) is no reference for
    itself and is left out. A group holds at most one row per book, so the exact median is taken per group.
    """
    if execution_book is not None:
        own = F.lit(execution_book) if isinstance(execution_book, str) else execution_book
        counted = ~F.col("book").eqNullSafe(own)
    else:
        counted = F.lit(True)
    q = latest.select("*", F.when(counted, fair_home()).alias("_q"), F.when(counted, overround()).alias("_over"), F.when(
        counted, (micros(cutoff) - micros("quote_at")) / F.lit(60_000_000.0)).alias("_age"))
    out = q.groupBy(*keys).agg(
        F.count("_q").alias("books"), F.expr("percentile(_q, 0.5D)").alias("q"),
        F.stddev_pop("_q").alias("dispersion"), (F.max("_q") - F.min("_q")).alias("spread"),
        F.avg("_over").alias("mean_overround"), F.max("_age").alias("age_minutes"))
    enough = F.col("books") >= min_books
    return out.select(*keys, "books", *[F.when(enough, F.col(c)).alias(c) for c in
                                        ("q", "dispersion", "spread", "mean_overround",
                                         "age_minutes")],
                      F.when(~enough, f"fewer than {min_books} reference books").alias("abstain_reason"))


def best_offers(latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best price per side; equal prices go to the lowest book name."""
    pick = []
    for side in ("home", "away"):
        best = F.min_by(F.struct(F.col(f"{side}_odds").alias("odds"), "book", "quote_at"),
                        F.struct(-F.col(f"{side}_odds"), F.col("book")))
        pick.append(best.alias(f"_{side}"))
    out = latest.groupBy(*keys).agg(*pick)
    return out.select(*keys, *[F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in ("home", "away")
                               for c in ("odds", "book", "quote_at")])


def exclusion_reason(*rules: tuple[str, Column]) -> Column:
    """First matching reason in order, NULL when the row stays."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def snapshot_times(decisions: DataFrame, delay_minutes: int = 5) -> DataFrame:
    """The instants at which prices are wanted: each cutoff and a few minutes later."""
    t = F.col("decision_at")
    later = t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(delay_minutes))
    return decisions.select(F.explode(F.array(t, later)).alias("snapshot_at")).distinct()
