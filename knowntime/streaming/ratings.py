"""Incremental ratings: the batch fold as a stateful stream.

State per pool: one rating per competitor, and the results whose availability the watermark has not passed, by stretch of time. A
stretch has a timer; when the watermark is past its end, its results are applied in (available_at, id) order and dropped. So arrival
order within the watermark delay does not matter, the outcome equals the batch fold, and a timer touches one stretch only. Arriving
results are added as parts: what waits is written once and read once, however many batches bring it.

A result that is delivered again counts once: while it waits it is known by its id, and once it is applied the watermark is past it, so
it is dropped as late. Late rows are counted by the stream (``polls.run_available``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from knowntime.operators.ratings import INITIAL

OUTPUT = ("league string, contest_id bigint, available_us bigint, home_id bigint, away_id bigint, "
          "home_rating double, away_rating double")
PENDING = "available_us bigint, contest_id bigint, home_id bigint, away_id bigint, outcome double, neutral int"
FIELDS = [f.split()[0] for f in PENDING.split(", ")]
#: Arriving rows that are gathered before they are written as parts.
GATHERED = 200_000


def in_order(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each contest once, as its least row by ``FIELDS``, in (available_us, contest_id) order."""
    place = np.lexsort([held[c] for c in ("neutral", "outcome", "away_id", "home_id", "available_us", "contest_id")])
    ids = held["contest_id"][place]
    place = place[np.r_[True, ids[1:] != ids[:-1]]]
    place = place[np.lexsort([held["contest_id"][place], held["available_us"][place]])]
    return {c: v[place] for c, v in held.items()}


class RatingProcessor(StatefulProcessor):
    def __init__(self, k: float = 20.0, scale: float = 400.0, advantage: float = 65.0, stretch_ms: int = 7 * 86_400_000):
        self.k, self.scale, self.advantage, self.stretch = k, scale, advantage, stretch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getValueState("ratings", "held binary")
        self.parts = handle.getMapState("parts", "stretch bigint", "parts bigint")
        self.pending = handle.getMapState("pending", "stretch bigint, part bigint", "held binary")

    def add(self, rows: pd.DataFrame) -> None:
        """A further part for every stretch that the rows touch."""
        for stretch, part in rows.groupby(rows["available_us"] // (self.stretch * 1000)):
            stretch = int(stretch)
            n = self.parts.getValue((stretch,))[0] if self.parts.containsKey((stretch,)) else 0
            if not n:
                self.handle.registerTimer((stretch + 1) * self.stretch)
            self.pending.updateValue((stretch, n), (pickle.dumps({c: part[c].to_numpy() for c in FIELDS}),))
            self.parts.updateValue((stretch,), (n + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gathered, n = [], 0
        for pdf in rows:
            gathered.append(pdf[FIELDS])
            n += len(pdf)
            if n >= GATHERED:
                self.add(pd.concat(gathered))
                gathered, n = [], 0
        if n:
            self.add(pd.concat(gathered))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stretch = expiredTimerInfo.getExpiryTimeInMs() // self.stretch - 1
        if not self.parts.containsKey((stretch,)):
            return
        held = []
        for i in range(self.parts.getValue((stretch,))[0]):
            held.append(pickle.loads(self.pending.getValue((stretch, i))[0]))
            self.pending.removeKey((stretch, i))
        self.parts.removeKey((stretch,))
        # A result that came more than once counts as the least of what came.
        due = in_order({c: np.concatenate([h[c] for h in held]) for c in FIELDS})
        now = pickle.loads(self.ratings.get()[0]) if self.ratings.exists() else {}
        home_after, away_after = [], []
        k, scale, advantage = self.k, self.scale, self.advantage
        for home, away, outcome, neutral in zip(*[due[c].tolist() for c in ("home_id", "away_id", "outcome", "neutral")]):
            a, b = now.get(home, INITIAL), now.get(away, INITIAL)
            chance = 1.0 / (1.0 + 10.0 ** (-(a - b + advantage * (1 - neutral)) / scale))
            move = k * (outcome - chance)
            now[home], now[away] = a, b = a + move, b - move
            home_after.append(a)
            away_after.append(b)
        self.ratings.update((pickle.dumps(now),))
        yield pd.DataFrame({"league": key[0], "contest_id": due["contest_id"], "available_us": due["available_us"], "home_id": due["home_id"],
                            "away_id": due["away_id"], "home_rating": home_after, "away_rating": away_after})

    def close(self) -> None:
        pass


def rating_stream(results: DataFrame, *, delay: str = "1 day", advantage: float = 65.0, stretch_days: int = 7) -> DataFrame:
    """Ratings after each result; ``available_at`` is the event time (a TIMESTAMP). Results are applied once the watermark is past their stretch of
    ``stretch_days``. To be run with ``map_state``. Results without an id or time are left out."""
    rows = (results.where("contest_id IS NOT NULL AND available_at IS NOT NULL").withWatermark("available_at", delay)
            .withColumn("available_us", F.unix_micros("available_at")))
    return rows.groupBy("league").transformWithStateInPandas(
        RatingProcessor(advantage=advantage, stretch_ms=stretch_days * 86_400_000), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
