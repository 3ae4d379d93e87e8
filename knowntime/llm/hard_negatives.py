"""Hard-negative mining by the threshold algorithm over per-dimension sorted lists.

Candidates lie in blocks; a block keeps the order of its rows along every dimension. For anchors the lists are read from the ends
where the anchors' signs make large products, all to the same depth; the rows met are scored at once by their whole integer inner
products with all anchors. No unmet row can score above the sum of the products at the depth reached, so reading stops for an anchor once
this threshold is strictly below the worst score that it still wants. Strictly, as ties go by id.

Anchors (the stated query set) meet candidates in groups by stripes of blocks: an equi-join on (group, stripe). A task goes through the
blocks of a stripe and keeps each anchor's best rows so far, so what one block has found stops the reading of the next. Positives read
the lists of the anchor's label only. What a stripe finds is a few rows per anchor; a window ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowntime.llm.common import saved

#: Rows of a block and anchors of a group, on average; anchors that read together.
BLOCK, GROUP, TOGETHER = 2048, 16384, 512
#: Depth of the first read; each further read doubles it.
FIRST_DEPTH = 16
#: Stripes of blocks per core, over all groups, and the most blocks of one.
STRIPES, LONGEST = 4, 64
#: Candidates per wanted row beyond which a batch is first cut to its own best.
CROWD = 8
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BINARY = "size int, ids binary, labels binary, x binary, kind string"


def integer_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """Distinct (vec_id, label, x) of the rows that take part: id, label and vector known, all components finite numbers."""
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (rows.where("vec_id is not null and label is not null and embedding is not null").where(usable)
            .select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                    F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")).distinct())


def _most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Lists:
    """Vectors and the order of their rows along each dimension, ascending (dimensions x rows)."""

    def __init__(self, x: np.ndarray, order: np.ndarray):
        self.x, self.order = x, order
        self.most = _most(x)
        self.as_float: dict[type, np.ndarray] = {}

    def bound(self, a: np.ndarray) -> int:
        """No sum of products with the anchors passes it."""
        bound = self.most * _most(a) * a.shape[-1]
        if bound >= 1 << 63:
            raise OverflowError("scores do not fit 64 bits")
        return bound

    def products(self, at: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Integer inner products of anchors (one, or one a row) with rows; in floating-point arithmetic where it is exact."""
        bound = self.bound(a)
        if bound >= 1 << 53:
            return a @ self.x[at].T
        kind = np.float32 if bound < 1 << 24 else np.float64
        if kind not in self.as_float:
            self.as_float[kind] = self.x.astype(kind)
        return a.astype(kind) @ self.as_float[kind][at].T

    def scores(self, at: np.ndarray, a: np.ndarray) -> np.ndarray:
        return self.products(at, a).astype(np.int64)

    def edge(self, a: np.ndarray, depth: int) -> np.ndarray:
        """Thresholds of anchors, one a row: no row beyond this depth (from 1) scores above."""
        self.bound(a)
        dims = np.arange(len(self.order))
        return np.maximum(a, 0) @ self.x[self.order[:, -depth], dims] + np.minimum(a, 0) @ self.x[self.order[:, depth - 1], dims]

    def steps(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, int | None]]:
        """Ever deeper for all anchors alike: rows not met before, and the depth reached (None: all rows are met)."""
        n = len(self.x)
        up, down = np.flatnonzero((a > 0).any(axis=0)), np.flatnonzero((a < 0).any(axis=0))
        if not len(up) and not len(down):
            yield np.arange(n), None
            return
        met, depth = np.zeros(n, bool), 0
        while depth < n:
            to = min(n, max(FIRST_DEPTH, 2 * depth))
            fresh = np.zeros(n, bool)
            fresh[self.order[up, n - to:n - depth].ravel()] = True
            fresh[self.order[down, depth:to].ravel()] = True
            fresh &= ~met
            met |= fresh
            depth = n if met.all() else to
            yield np.flatnonzero(fresh), depth if depth < n else None

    def read(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """For one anchor: rows not met before, their scores, and the threshold (None: all rows are met)."""
        for at, depth in self.steps(a[None]):
            yield at, self.scores(at, a), None if depth is None else int(self.edge(a[None], depth)[0])


class Best:
    """The first ``k`` rows found so far for each wish, by falling score, then id."""

    def __init__(self, wishes: int, k: int):
        self.scores, self.ids = np.full((wishes, k), LEAST), np.zeros((wishes, k), np.int64)

    def add(self, wish: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.scores.shape[1]
        late = (scores < self.scores[wish, -1]) | ((scores == self.scores[wish, -1]) & (ids > self.ids[wish, -1]))
        wish, ids, scores = wish[~late], ids[~late], scores[~late]
        if not len(wish):
            return
        of = np.unique(wish)
        wish = np.concatenate([wish, np.repeat(of, k)])
        ids, scores = np.concatenate([ids, self.ids[of].ravel()]), np.concatenate([scores, self.scores[of].ravel()])
        by = np.lexsort((ids, ~scores, wish))                       # ~ falls as scores rise, and cannot overflow
        first = by[np.searchsorted(wish[by], of)[:, None] + np.arange(k)]
        self.ids[of], self.scores[of] = ids[first], scores[first]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Wishes, ids, scores."""
        wish, place = np.nonzero(self.scores > LEAST)
        return wish, self.ids[wish, place], self.scores[wish, place]


def look(lists: Lists, ids: np.ndarray, labels: np.ndarray | None, me: np.ndarray, own: np.ndarray, a: np.ndarray,
         lo: np.ndarray, hi: np.ndarray, wish: np.ndarray, best: Best) -> None:
    """Bring ``best`` up to date with the rows of a block for all anchors ``a`` (ids ``me``, labels ``own``), one a row.

    An anchor has windows of scores (``lo`` to ``hi``, anchors x windows), whose wishes ``wish`` numbers. Rows of the anchor's id count
    for nothing, nor do those of its label if the rows' ``labels`` are given.
    """
    k = best.scores.shape[1]
    floors = lambda live: np.where(lo[live] > hi[live], MOST, np.maximum(lo[live], best.scores[wish[live], -1]))
    live = np.arange(len(a))
    live = live[lists.edge(a, 1) >= floors(live).min(axis=1)]
    if not len(live):
        return
    for at, depth in lists.steps(a[live]):
        s, floor = lists.products(at, a[live]), floors(live)
        top = hi[live].max(axis=1).astype(s.dtype)[:, None]
        hit = (s >= floor.min(axis=1).astype(s.dtype)[:, None]) & (s <= top)
        if np.count_nonzero(hit) > CROWD * k * len(live) and len(at) > k:
            # no row below the k-th of this batch alone can be among the best
            allowed = hit & (ids[at] != me[live][:, None])
            if labels is not None:
                allowed &= labels[at] != own[live][:, None]
            least = -np.inf if s.dtype.kind == "f" else LEAST
            for w in range(lo.shape[1]):
                inside = allowed & (s >= floor[:, w].astype(s.dtype)[:, None]) & (s <= hi[live, w].astype(s.dtype)[:, None])
                kth = np.partition(np.where(inside, s, least), -k, axis=1)[:, -k]
                full = kth > least
                floor[full, w] = kth[full].astype(np.int64)
            hit &= s >= floor.min(axis=1).astype(s.dtype)[:, None]
        who, row = np.nonzero(hit)
        score, anchor, row = s[who, row].astype(np.int64), live[who], at[row]
        other = ids[row] != me[anchor]
        if labels is not None:
            other &= labels[row] != own[anchor]
        who, score, anchor, row = who[other], score[other], anchor[other], row[other]
        inside = [(score >= floor[who, w]) & (score <= hi[anchor, w]) for w in range(lo.shape[1])]
        best.add(np.concatenate([wish[anchor[i], w] for w, i in enumerate(inside)]), np.concatenate([ids[row[i]] for i in inside]),
                 np.concatenate([score[i] for i in inside]))
        if depth is None:
            return
        live = live[lists.edge(a[live], depth) >= floors(live).min(axis=1)]
        if not len(live):
            return


def nearest(lists: Lists, ids: np.ndarray, me: int, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best rows but for those of the anchor's own id."""
    best, one = Best(1, k), np.zeros((1, 1), np.int64)
    look(lists, ids, None, np.array([me]), one[0], a[None], one + LEAST, one + MOST, one, best)
    return best.found()[1:]


def _matrix(x: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros."""
    x = x.combine_chunks()
    sizes = x.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(x), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
    return out


def _pair(block: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of the same width."""
    wide = max(block.shape[1], anchors.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in (block, anchors))


def _small(x: np.ndarray) -> np.ndarray:
    """In the narrowest kind of integers that holds the values."""
    ends = (x.min(initial=0), x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= ends[0] and ends[1] <= np.iinfo(t).max))


def _packed(table: pa.Table, x: np.ndarray) -> dict:
    x = _small(x)
    return {"size": pa.array([len(x)], pa.int32()), "ids": pa.array([table.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "labels": pa.array([table.column("label").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "x": pa.array([x.tobytes()], pa.binary()), "kind": pa.array([x.dtype.str])}


def _opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, vectors."""
    return (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64),
            np.frombuffer(r["x"], r["kind"]).astype(np.int64).reshape(r["size"], -1))


def _number(table: pa.Table, name: str) -> pa.Array:
    return pa.array([table.column(name)[0].as_py()], pa.int32())


def candidate_blocks(rows: DataFrame, count: int) -> DataFrame:
    """(block, size, ids, labels, x, kind, order): packed rows dealt by hash, and the order of each block along every dimension."""
    def pack(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x"))
        order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16 if len(x) <= 1 << 16 else np.uint32)
        return pa.table({"block": _number(table, "block"), **_packed(table, x), "order": pa.array([np.ascontiguousarray(order).tobytes()], pa.binary())})
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(count)).cast("int").alias("block"), "vec_id", "label", "x")
    return dealt.groupBy("block").applyInArrow(pack, f"block int, {_BINARY}, order binary")


def anchor_groups(anchors: DataFrame, count: int) -> DataFrame:
    """(group, rows, size, ids, labels, x, kind, wanted): packed anchors; ``wanted`` has the scores of their positives, if any are known."""
    known = "positives" in anchors.columns

    def pack(table: pa.Table) -> pa.Table:
        wanted = [p for one in table.column("positives").to_pylist() for p in (len(one), *one)] if known else []
        return pa.table({"group": _number(table, "group"), "rows": pa.array([table.column("row").to_numpy().tobytes()], pa.binary()),
                         **_packed(table, _matrix(table.column("x"))), "wanted": pa.array([np.array(wanted, np.int64).tobytes()], pa.binary())})
    dealt = anchors.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    return dealt.groupBy("group").applyInArrow(pack, f"group int, rows binary, {_BINARY}, wanted binary")


def open_block(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, x = _opened(r)
    return ids, labels, x, np.frombuffer(r["order"], np.uint16 if len(x) <= 1 << 16 else np.uint32).reshape(-1, len(x))


def meet(groups: DataFrame, blocks: DataFrame, n_groups: int, n_blocks: int) -> DataFrame:
    """Each group of anchors (struct ``g``) with each block (struct ``b``), joined on (group, stripe of blocks): the blocks stream past one
    group, sorted by both."""
    cores = groups.sparkSession.sparkContext.defaultParallelism
    stripes = min(n_blocks, max(-(-STRIPES * cores // n_groups), -(-n_blocks // LONGEST)))
    left = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"), (F.col("block") % stripes).alias("stripe"),
                         F.struct("size", "ids", "labels", "x", "kind", "order").alias("b"))
    right = groups.select("group", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"),
                          F.struct("rows", "size", "ids", "labels", "x", "kind", "wanted").alias("g"))
    return left.join(right.hint("merge"), ["group", "stripe"]).select("group", "stripe", "g", "b")


def _sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[dict]]]:
    """The anchors of every run of rows of one (group, stripe), and its blocks."""
    rows = ((batch.column("group")[i].as_py(), batch.column("stripe")[i].as_py(), batch, i) for batch in batches for i in range(batch.num_rows))
    for _, run in groupby(rows, key=lambda r: r[:2]):
        first = next(run)
        yield first[2].column("g")[first[3]].as_py(), (b.column("b")[i].as_py() for _, _, b, i in (r for part in ([first], run) for r in part))


def _with_lists(block: dict, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, vectors and order of a block, and the anchors, of the same width."""
    ids, labels, x, order = open_block(block)
    x, a = _pair(x, a)
    flat = np.tile(np.arange(len(ids), dtype=order.dtype), (x.shape[1] - len(order), 1))
    return ids, labels, x, np.concatenate([order, flat]), a


def find_positives(met: DataFrame, k: int) -> DataFrame:
    """(row, positive_id, positive_score): what each stripe has among the best of an anchor's label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, blocks in _sweeps(batches):
            me, own, vectors = _opened(group)
            n = len(me)
            best, wish = Best(n, k), np.arange(n)[:, None]
            lo, hi = np.full((n, 1), LEAST), np.full((n, 1), MOST)
            by_label = np.argsort(own, kind="stable")
            alike = np.split(by_label, np.flatnonzero(np.diff(own[by_label])) + 1)
            for block in blocks:
                ids, labels, x, order, a = _with_lists(block, vectors)
                for of_label in alike:
                    mine = labels == own[of_label[0]]
                    if not mine.any():
                        continue
                    number = np.cumsum(mine) - 1
                    # the block's lists without the rows of other labels
                    lists = Lists(x[mine], number[order[mine[order]]].reshape(len(order), -1))
                    for i in range(0, len(of_label), TOGETHER):
                        q = of_label[i:i + TOGETHER]
                        look(lists, ids[mine], None, me[q], own[q], a[q], lo[q], hi[q], wish[q], best)
            wishes, found, scores = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(group["rows"], np.int64)[wishes]), pa.array(found), pa.array(scores)],
                                             names=["row", "positive_id", "positive_score"])
    return met.mapInArrow(run, "row long, positive_id long, positive_score long")


def windows(wanted: np.ndarray, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends (anchors x places) of the windows of negatives, by the packed scores of the positives; 1 to 0: none."""
    scores, at = [], 0
    for _ in range(n):
        size = int(wanted[at])
        scores.append([int(p) for p in wanted[at + 1:at + 1 + size]])
        at += 1 + size
    wide = max((len(p) for p in scores), default=0)
    fit = lambda v: min(max(v, LEAST), MOST)
    lo = [[fit(-(-low * s // 100)) for s in p] + [1] * (wide - len(p)) for p in scores]
    hi = [[fit(high * s // 100) for s in p] + [0] * (wide - len(p)) for p in scores]
    return np.array(lo, np.int64).reshape(n, wide), np.array(hi, np.int64).reshape(n, wide)


def find_negatives(met: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(row, place, negative_id, negative_score): what each stripe has among the best inside the window of each positive (its
    place in ``positives``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, blocks in _sweeps(batches):
            me, own, vectors = _opened(group)
            lo, hi = windows(np.frombuffer(group["wanted"], np.int64), len(me), low, high)
            best, wish = Best(lo.size, k), np.arange(lo.size).reshape(lo.shape)
            for block in blocks:
                ids, labels, x, order, a = _with_lists(block, vectors)
                lists = Lists(x, order)
                for i in range(0, len(me), TOGETHER):
                    q = slice(i, i + TOGETHER)
                    look(lists, ids, labels, me[q], own[q], a[q], lo[q], hi[q], wish[q], best)
            wishes, found, scores = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(group["rows"], np.int64)[wishes // lo.shape[1]]),
                                              pa.array((wishes % lo.shape[1]).astype(np.int32)), pa.array(found), pa.array(scores)],
                                             names=["row", "place", "negative_id", "negative_score"])
    return met.mapInArrow(run, "row long, place int, negative_id long, negative_score long")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Hard negatives of every anchor for each of its positives, both DataFrames of (vec_id, embedding, label).

    A score is the inner product of floor(scale * component) vectors; higher comes first, ties go by smaller vec_id. Positives are
    the first ``positives`` rows of the anchor's label with another vec_id; negatives the first ``negatives`` rows of other labels
    with low * positive <= 100 * negative <= high * positive. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. Rows without id, label or vector, or with a null or non-finite component take no part; repeated
    rows count once; different rows of one vec_id are rows of their own; short vectors count as filled up with zeros; other columns
    are ignored. Scores past 64 bits are an error. No rows or no anchors give no rows.
    """
    cand = saved(integer_rows(rows, scale), "candidates")
    asked = saved(integer_rows(anchors, scale).withColumn("row", F.monotonically_increasing_id()), "anchors")
    n_blocks, n_groups = max(1, -(-cand.count() // BLOCK)), max(1, -(-asked.count() // GROUP))
    blocks = saved(candidate_blocks(cand, n_blocks), "blocks")
    near = find_positives(meet(anchor_groups(asked, n_groups), blocks, n_groups, n_blocks), positives)
    first = W.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    near = saved(near.withColumn("place", F.row_number().over(first) - 1).where(f"place < {positives}"), "positives")
    of_anchor = near.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    found = find_negatives(meet(anchor_groups(asked.join(of_anchor, "row"), n_groups), blocks, n_groups, n_blocks), negatives, low, high)
    first = W.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(first)).where(f"rank <= {negatives}")
    return found.join(near, ["row", "place"]).join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
