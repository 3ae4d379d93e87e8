"""Suffix dedup against a dictionary of all strings of every text."""

import hashlib
import random

import numpy as np
import pytest

from knowntime.llm import suffix_dedup as sd


def brute(rows, width=50):
    least = {}
    ids = [(1 << 63) if d is None else d for d, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    for d, b in zip(ids, texts):
        for i in range(len(b) - width + 1):
            s = b[i:i + width]
            least[s] = min(least.get(s, d), d)
    out = []
    for (doc, _), d, b in zip(rows, ids, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if least[b[i:i + width]] < d:
                gone[i:i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sd.remove_repeats(df)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == 2 * r.n_spans for r in out.collect())
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.drop("kept", "spans").collect()], key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(60)]
    for _ in range(90):                                # cuts of 30 to 130 characters put into other texts
        a, b = rng.randrange(60), rng.randrange(60)
        i, n, j = rng.randrange(len(texts[a]) + 1), rng.choice([30, 47, 49, 50, 51, 55, 64, 80, 130]), rng.randrange(len(texts[b]) + 1)
        texts[b] = texts[b][:j] + texts[a][i:i + n] + texts[b][j:]
    texts += [texts[3], texts[3], texts[7], "", "short", None, "x" * 400, "x" * 60, "ab" * 200, "y" + "ab" * 150]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(3, texts[3]), (5, texts[9]), (None, texts[2]), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_merge_equals_sort_and_marks_repeats():
    rng = random.Random(5)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randint(0, 40))}) for _ in range(7)]
    runs = [r for r in runs if r]
    coded = []
    for r in runs:
        a = np.array(r, "S8")
        coded.append((*sd.front_code(a), np.arange(len(r), dtype=np.int64).tobytes()))
        assert [s for _, s in sd.decode(*coded[-1][:2], 8)] == r
    order, new = sd.merge([sd.decode(a, b, 8) for a, b, _ in coded], 8)
    at = [iter(r) for r in runs]
    merged = [next(at[i]) for i in order]
    assert merged == sorted(x for r in runs for x in r)
    assert new == [i == 0 or merged[i] != merged[i - 1] for i in range(len(merged))]


def test_what_a_block_keeps_comes_back_unchanged():
    arrays = [np.empty(0, np.uint32), np.array([3, -2, 1 << 40]), np.array([True, False, True]), np.empty(0, bool), np.arange(1000, dtype=np.uint32)]
    for a, b in zip(arrays, sd.unpacked(sd.packed(*arrays))):
        assert a.dtype == b.dtype and (a == b).all() and len(a) == len(b)


def test_texts_too_short_long_and_copied(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300_000))
    rows = [(1, "x" * 49), (2, "x" * 49), (3, long), (4, long[:150_000] + "!" + long[150_000:]), (5, long), (None, None), (6, ""), (6, ""), (7, "y" * 400), (8, "y" * 50)]
    assert found(spark, rows) == brute(rows)
    df = spark.createDataFrame([(1, "a" * 60, 5, "k"), (2, "a" * 60, 6, "k")], "doc_id long, text string, block int, key string")
    assert sorted((r.doc_id, r.n_removed) for r in sd.remove_repeats(df, give="digest").collect()) == [(1, 0), (2, 60)]
    assert sd.remove_repeats(df.where("false")).collect() == []
