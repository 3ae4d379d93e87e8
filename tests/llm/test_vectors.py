"""Hard negatives and whitening against brute force."""

import math
import random

import numpy as np
import pytest

from knowntime.llm import hard_negatives, queries, whitening

COLUMNS = "vec_id long, embedding array<float>, label int, block int, row int, x string"


def vectors(n, dims, seed=3, grid=1.0):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) * grid for _ in range(dims)], r.randrange(4), 0, 0, "") for i in range(n)]
    hot = rows[5][1]
    rows += [(n + i, hot, r.randrange(2), 0, 0, "") for i in range(n // 3)]              # one very common vector
    rows += [rows[7], rows[7], (2 * n, None, 1, 0, 0, ""), (2 * n + 1, [1.0, None], 1, 0, 0, ""), (2 * n + 2, [float("nan")] * dims, 1, 0, 0, ""),
             (2 * n + 3, [float("inf")] * dims, 1, 0, 0, ""), (100 * n, [0.0] * dims, 1, 0, 0, ""), (2 * n + 5, [0.5] * (dims - 1), None, 0, 0, ""),
             (2 * n + 6, [0.5] * (dims - 1), 2, 0, 0, "")]
    return rows


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def integers(v, dims):
    x = [math.floor(256 * float(np.float32(c))) for c in v]
    return tuple(x + [0] * (dims - len(x)))


def plain_negatives(rows, dims, anchor_ids):
    seen = {(i, lab, integers(v, dims)) for i, v, lab, *_ in rows if whole(v) and lab is not None}
    out = []
    for me, lab, a in sorted(seen):
        if me not in anchor_ids:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, x)), i, other) for i, other, x in seen if i != me))
        for s, i, _ in [t for t in scored if t[2] == lab][:5]:
            ok = [t for t in scored if t[2] != lab and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(me, i, rank, j, -s, -t) for rank, (t, j, _) in enumerate(ok, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,group,grid", [(2048, 1024, 1.0), (40, 3, 0.01)])
def test_negatives_by_brute_force(spark, monkeypatch, block, group, grid):
    monkeypatch.setattr(hard_negatives, "BLOCK", block), monkeypatch.setattr(hard_negatives, "GROUP", group)
    rows = vectors(300, 6, grid=grid)                    # the small grid makes many ties
    df = spark.createDataFrame(rows, COLUMNS)
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                 for r in hard_negatives.mine(df, df.where("vec_id % 10 = 0")).collect())
    want = plain_negatives(rows, 6, {i for i, *_ in rows if i % 10 == 0})
    assert got == want and want


def test_reading_stops_before_the_lists_end():
    r = np.random.default_rng(0)
    x = r.integers(-200, 200, (4000, 3))
    lists = hard_negatives.Lists(x, np.argsort(x, axis=0, kind="stable").T)
    a, met = np.array([100, -50, 7]), 0
    for at, scores, edge in lists.read(a):
        met += len(at)
        assert (scores == x[at] @ a).all()
        if edge is not None and edge < np.sort(scores)[-3]:
            break
    assert met < 2000
    ids, scores = hard_negatives.nearest(lists, np.arange(4000), 17, a, 5)
    order = sorted((-int(s), i) for i, s in enumerate(x @ a) if i != 17)[:5]
    assert list(zip((-scores).tolist(), ids.tolist())) == order


def test_scores_past_double_precision_stay_exact():
    x = np.array([[1 << 28, 1], [1 << 28, 0]])
    lists = hard_negatives.Lists(x, np.argsort(x, axis=0, kind="stable").T)
    assert lists.scores(np.arange(2), np.array([1 << 28, 1])).tolist() == [(1 << 56) + 1, 1 << 56]


def test_no_rows_no_anchors(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert hard_negatives.mine(empty, empty).collect() == [] and whitening.whiten(empty).collect() == []
    df = spark.createDataFrame(vectors(20, 3), COLUMNS)
    assert hard_negatives.mine(df, df.where("false")).collect() == []


def plain_whitening(rows, dims):
    kept = [(i, integers(v, dims)) for i, v, *_ in rows if whole(v)]
    fit = sorted({x for _, x in kept})
    n = len(fit)
    s = [sum(c) for c in zip(*fit)]
    y = [[n * v - t for v, t in zip(x, s)] for x in fit]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n ** 3 for j in range(dims)] for i in range(dims)])
    return kept, n, s, cov


@pytest.mark.parametrize("dims", [3, 8])
def test_whitening_by_brute_force(spark, dims):
    rows = vectors(200, dims)
    kept, n, s, cov = plain_whitening(rows, dims)
    e, v = np.linalg.eigh(cov)
    got = whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect()
    k = min(4, dims)
    assert len(got) == k * len(kept) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), set()).add((r.deviation, r.whitened, r.explained))
    signs = {}
    for i, x in kept:
        y = [n * a - b for a, b in zip(x, s)]
        for c in range(1, k + 1):
            (dev, w, share), = by[i, c]
            assert dev == sum(a * a for a in y)
            assert math.isclose(share, e[-c] / np.trace(cov), rel_tol=1e-9)
            want = float(np.array(y) / n @ v[:, -c] / math.sqrt(e[-c]))
            assert math.isclose(abs(w), abs(want), rel_tol=1e-7, abs_tol=1e-7)
            if abs(want) > 1e-3:
                signs.setdefault(c, set()).add(w * want > 0)
    assert all(len(x) == 1 for x in signs.values()) and all(r.identity_error < 1e-9 for r in got)


def test_covariances_are_exact_whatever_the_size(spark):
    r = random.Random(1)
    for top in (5, 1 << 30, 1 << 44):
        fit = sorted({tuple(r.randrange(-top, top) for _ in range(4)) for _ in range(50)})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        y = [[n * v - t for v, t in zip(x, s)] for x in fit]
        df = spark.createDataFrame([(list(x),) for x in fit], "x array<long>")
        assert whitening.covariance(df, n, s) == [[2 * sum(q[i] * q[j] for q in y) for j in range(4)] for i in range(4)]


def test_no_variance(spark):
    flat = spark.createDataFrame([(i, [0.5, float(i % 2), 2.0]) for i in range(6)], "vec_id long, embedding array<float>")
    got = whitening.whiten(flat).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in got} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    one = whitening.whiten(flat.limit(1)).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(c, None, None, None, 0) for c in (1, 2, 3)]


def test_registered_queries_take_every_row(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if whole(r.embedding)]
    got = queries.op13_whitening(spark, sf).collect()
    assert len(got) == 4 * len(rows) and max(r.identity_error for r in got) < 1e-9
    mined = queries.op12_hard_negatives(spark, sf).collect()
    assert mined and all(r.anchor_id % 100 == 0 and 30 * r.positive_score <= 100 * r.negative_score <= 90 * r.positive_score for r in mined)


@pytest.mark.parametrize("together,crowd,group", [(2, 0, 9), (512, 8, 4096)])
def test_batches_of_anchors_by_brute_force(spark, monkeypatch, together, crowd, group):
    for name, value in (("TOGETHER", together), ("CROWD", crowd), ("GROUP", group), ("BLOCK", 50), ("LONGEST", 3), ("FIRST_DEPTH", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(200, 5, seed=8, grid=0.02)
    rows += [(i, v, (lab + 1) % 4, 0, 0, "") for i, v, lab, *_ in rows[:60:10]]          # an anchor's id under another label
    df = spark.createDataFrame(rows, COLUMNS)
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                 for r in hard_negatives.mine(df, df.where("vec_id % 10 = 0")).collect())
    assert got == plain_negatives(rows, 5, {i for i, *_ in rows if i % 10 == 0}) and got


def test_what_one_block_found_stops_the_reading_of_the_next(monkeypatch):
    r = np.random.default_rng(1)
    a, one = np.array([[100, -50, 7], [90, -60, 1]]), np.zeros((2, 1), np.int64)
    near, far = r.integers(100, 200, (500, 3)) * [1, -1, 1], r.integers(-20, 20, (500, 3))
    scored, products = [], hard_negatives.Lists.products
    monkeypatch.setattr(hard_negatives.Lists, "products", lambda self, at, a: scored.append(len(at)) or products(self, at, a))
    best = hard_negatives.Best(2, 5)
    for x in (near, far):
        scored.clear()
        lists = hard_negatives.Lists(x, np.argsort(x, axis=0, kind="stable").T)
        hard_negatives.look(lists, np.arange(500), None, np.array([3, 4]), one[:, 0], a, one + hard_negatives.LEAST, one + hard_negatives.MOST,
                            np.arange(2)[:, None], best)
        assert sum(scored) == 0 if x is far else scored
    wishes, ids, scores = best.found()
    for w, me in enumerate((3, 4)):
        assert list(zip((-scores[wishes == w]).tolist(), ids[wishes == w].tolist())) == sorted((-int(s), i) for i, s in enumerate(near @ a[w]) if i != me)[:5]


@pytest.mark.parametrize("size", [1 << 8, 1 << 20, 1 << 28])
def test_batched_products_are_exact_in_every_kind_of_number(size):
    r = np.random.default_rng(2)
    x, a = r.integers(-size, size, (50, 4)), r.integers(-size, size, (3, 4))
    lists = hard_negatives.Lists(x, np.argsort(x, axis=0, kind="stable").T)
    assert (lists.scores(np.arange(50), a) == a @ x.T).all()
    with pytest.raises(OverflowError):
        lists.edge(a * ((1 << 62) // size), 1)
