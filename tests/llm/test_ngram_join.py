"""Similarity classes against all pairs of shingle sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from knowntime.llm import ngram_join


def brute(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, group):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for size in [60, 90, 33, 200]:
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(group):                         # copies with edits around the threshold
            c = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                k = rng.random()
                i = rng.randrange(len(c))
                if k < 0.6:
                    c[i] = rng.choice(words)
                elif k < 0.8:
                    c = c[:i] + c[i + rng.randint(1, size // 8):] or c
                else:
                    c[i:i] = rng.choices(words, k=rng.randint(1, 4))
            texts.append(" ".join(c))
    passage = " ".join(rng.choices(words, k=30))
    texts += [" ".join(rng.choices(words, k=rng.randint(5, 60))) + " " + passage for _ in range(25)]
    texts += [texts[0], texts[0].upper(), "a b c", "A b\tC", "a b", "", None, "  \n", "a b c d e", "x " * 300]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(2, texts[2]), (3, texts[7]), (None, texts[4]), (None, None)]


@pytest.mark.parametrize("seed,short,one_task", [(1, 8, 8_000_000), (2, 2, 0)])
def test_matches_all_pairs(spark, monkeypatch, seed, short, one_task):
    """With clusters in one task, and with lists that go on round by round."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "ONE_TASK", one_task)
    rows = corpus(seed, 30)
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def small_sets(seed):
    """A few dozen small sets around some bases, of tokens 0 to 39."""
    rng = random.Random(seed)
    top = rng.randint(12, 40)
    bases = [rng.sample(range(top), min(top, rng.randint(5, 14))) for _ in range(rng.randint(2, 5))]
    out = set()
    for _ in range(rng.randint(6, 20)):
        b = set(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5 and len(b) > 3:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(top))
        out.add(frozenset(b))
    return sorted(sorted(x) for x in out)


@pytest.mark.parametrize("one_task", [0, 60])
def test_members_met_in_earlier_rounds(spark, monkeypatch, one_task):
    """A leader's new members are compared with those it met before; groups of sets with tokens of their own, against all pairs."""
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "ONE_TASK", one_task)
    posts, stored, want = [], [], set()
    for seed in (34, 310, 318):
        sets = [[100 * seed + t for t in s] for s in small_sets(seed)]
        df = Counter(t for s in sets for t in s)
        for i, s in enumerate(sets):
            s = sorted(s, key=lambda t: (df[t], t))
            sig, size, alone = b"%04d.%02d" % (seed, i), len(s), sum(df[t] < 2 for t in s)
            upto = ngram_join.first_size(size, 80)
            stored.append((sig, size, alone, 1 - alone / size, np.array(s[alone:], np.int64).tobytes()))
            posts += [(sig, size, 1 - alone / size, 1, s[k], k) for k in range(alone, upto)]
            like = {sig} | {b"%04d.%02d" % (seed, j) for j, z in enumerate(sets) if 100 * len({*s} & {*z}) >= 80 * len({*s} | {*z})}
            want = {c for c in want if not c & like} | {frozenset(like.union(*(c for c in want if c & like)))}
    got = ngram_join.join_lists(
        spark.createDataFrame(posts, "sig binary, size int, common double, ell int, token long, place int"),
        spark.createDataFrame(stored, "sig binary, size int, alone int, common double, stored binary"), 80)
    classes = {}
    for r in got.collect():
        classes.setdefault(bytes(r.component), set()).add(bytes(r.node))
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == {c for c in want if len(c) > 1}


def test_short_texts_one_word_longer(spark):
    """Sets of 4 and 5 to 6 and 7 shingles share less than MOST_MATCHES or as many as they need; alone and beside texts with the same start."""
    rows = []
    for n in (8, 9, 10):
        for others in (0, 1, 3):
            words = [f"n{n}o{others}w{i}" for i in range(n)]
            rows += [" ".join(words), " ".join(words + ["more"])]
            rows += [" ".join(words[:7] + [f"x{n}{others}{k}y{i}" for i in range(12)]) for k in range(others)]
    rows = list(enumerate(rows))
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sum(d != c for d, _, c in want) == 9
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    for size in range(1, 12):
        for df in ([2] * size, [8] * size, list(range(1, size + 1)), [300] * size):
            assert 1 <= ngram_join.matches(np.array(df), size, 80) <= -(-80 * size // 100)


def test_empty_table(spark):
    assert ngram_join.similarity_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
