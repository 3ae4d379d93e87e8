"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the classes that its links make.

A document is the set of its word shingles, rarest first. Two similar sets share at least m shingles of their m-prefixes (the
first |x| - ceil(0.8 |x|) + m), for any m up to ceil(0.8 |x|). Each document picks the m for which postings to scan and candidates to verify are
estimated cheapest, from the shingles' document frequencies; a pair is verified once it shares as many prefix shingles as the
smaller m of the two asks for.

Long posting lists make no pairs. Their members are verified against one leader; members linked to it are in one class, and
classes are all that is asked for. A member y that is not linked to leader L can only be similar to a member x of at least L's
size if they share a shingle outside L: |x and y| >= 4/9 (|x| + |y|) >= 4/9 (|L| + |y|) > |y and L|. Where a leader's members lie in
more than one class, they are compared across classes in a task of their own (pairs of one class need no look). If their sets are
too many for a task, they go on with the prefix of what they hold outside L, in a list for each leader and shingle; members
smaller than L go on in a list without L. Members that met L in an earlier round count again among its members; they are only
not verified again. L is the greatest of its members in a fixed order, so leaders of the next lists are less, and rounds end: at the
latest when every list lies in one class. No pair is capped or dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm.common import block_count, give_back, partitions, saved
from knowntime.llm.components import connected_components

#: Lists up to this length pair up directly; longer ones go by leaders. Any value gives the same result.
SHORT = 8
#: A leader's members are compared in one task if their sets hold up to so many shingles (64 MB); more go on in lists of their own.
#: Any value gives the same result.
ONE_TASK = 8_000_000
#: Verifying a pair costs about as much as scanning this many postings.
VERIFY = 16
MOST_MATCHES = 6
#: Bytes of the texts of a block, on average.
BLOCK_BYTES = 8 << 20


class WordHashes(dict):
    """64-bit hash of a word; a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles (A-Z lower-cased, words parted by ASCII white space)."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    out = np.zeros(max(1, len(h) - n + 1), np.uint64)
    if len(h) >= n:
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i]
    else:
        for x in h:
            out = out * np.uint64(0x9E3779B97F4A7C15) + x
        out += np.uint64(len(h))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def first_size(size: int, percent: int) -> int:
    """Length of the 1-prefix."""
    return size - -(-percent * size // 100) + 1


def matches(df: np.ndarray, size: int, percent: int) -> int:
    """How many shared prefix shingles to ask for, at most the overlap that any similar set has: least of postings scanned plus VERIFY
    times the candidates expected."""
    base = first_size(size, percent)
    most = min(MOST_MATCHES, size - base + 1)
    scan = np.concatenate([[0], np.cumsum(np.minimum(df[:base + MOST_MATCHES - 1], SHORT + 1) - 1)])
    cost = [scan[min(base + m - 1, len(scan) - 1)] * (1 + VERIFY / m) for m in range(1, most + 1)]
    return int(np.argmin(cost)) + 1


def measure_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, block, n_shingles and sig (128-bit digest of the set) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sets = [shingles(t or "", words, n) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())], names=["block", "doc_id", "n_shingles", "sig"])
        del words
        give_back()
    return docs.mapInArrow(run, "block int, doc_id long, n_shingles long, sig binary")


def _table(names: str, kinds: list, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names.split())


def similarity_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row of (doc_id, text).

    Rows link when 100 * intersection >= percent * union of their shingle sets. Texts without words (and null texts) have an
    empty set and link with nothing; equal sets are joined as one. Repeated rows are rows of one class; a null doc_id is never
    the least. Shingles are told apart by 64-bit hashes.
    """
    blocks = block_count(docs, BLOCK_BYTES)
    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    sets = saved(measure_sets(dealt, n), "sets")
    groups = saved(sets.where("n_shingles > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "block")).alias("rep"), F.count(F.lit(1)).alias("rows"))
                   .where("rows > 1").select("sig", "rep"), "sets")
    others = saved(sets.where("n_shingles > 0").join(groups, "sig").where("struct(doc_id, block) <> rep").select("block", "doc_id", "sig").distinct(), "sets")

    posts, stored = prefixes(dealt, others, n, percent)
    parts = join_lists(posts, stored, percent)

    named = sets.join(parts.select(F.col("node").alias("sig"), "component"), "sig", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "sig").alias("class"))
    named = saved(named, "sets")
    least = saved(named.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least")), "sets")
    full = named.where("n_shingles > 0").join(least, "class").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return full.unionByName(named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def prefixes(dealt: DataFrame, others: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Postings of the documents' prefixes, and the sets of the documents that have any.

    One document stands for each set. Frequencies are counted exactly for all shingles (40 bits of hash besides the bucket; they
    only order the shingles): each block sends its distinct ones to bucket tasks and gets their counts back.
    """
    parts = partitions(dealt)

    def members(left: pa.Table, right: pa.Table) -> Iterator[tuple[bytes, np.ndarray]]:
        words = WordHashes()
        skip = set(zip(right.column("doc_id").to_pylist(), right.column("sig").to_pylist())) if right.num_rows else set()
        done = set()
        rows = sorted(zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        for doc, text in rows:
            s = shingles(text, words, n)
            sig = hashlib.md5(s.tobytes()).digest()
            if len(s) and (doc, sig) not in skip and sig not in done:
                done.add(sig)
                yield sig, s

    def bucket(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)

    def code(keys: np.ndarray) -> np.ndarray:
        """(bucket, low 40 bits) of each key."""
        return (bucket(keys) << np.uint64(40)) | (keys & np.uint64((1 << 40) - 1))

    def emit(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        found = [code(s) for _, s in members(left, right)] if left.num_rows else []
        if not found:
            return _table("part block keys counts", kinds, [])
        flat = np.concatenate(found)
        del found
        flat.sort()
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        few = np.minimum(np.diff(starts, append=len(flat)), 65535).astype("<u2")
        codes = flat[starts]
        del flat, starts
        low = np.ascontiguousarray(codes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        edges = np.searchsorted(codes, np.arange(parts + 1, dtype=np.uint64) << np.uint64(40))
        me = left.column("block")[0].as_py()
        out = _table("part block keys counts", kinds, [(i, me, low[a:b].tobytes(), pa.compress(few[a:b].tobytes(), "zstd", asbytes=True))
                                                       for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a])
        del low, codes, few
        give_back()
        return out

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, counts = [], []
        for r in rows:
            low = np.frombuffer(r["keys"], np.uint8).reshape(-1, 5)
            wide = np.zeros((len(low), 8), np.uint8)
            wide[:, :5] = low
            keys.append(wide.view("<u8").ravel())
            counts.append(np.frombuffer(pa.decompress(r["counts"], 2 * len(low), "zstd", asbytes=True), "<u2"))
        _, index = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(index, np.concatenate(counts).astype(float))[index]
        grade = np.where(total < 200, total, np.minimum(255, 200 + np.log2(np.maximum(total, 200) / 200) * 2)).astype(np.uint8)
        parts = np.split(grade, np.cumsum([len(k) for k in keys])[:-1])
        return _table("block part grades", [pa.int32(), pa.int32(), pa.binary()],
                      [(r["block"], r["part"], pa.compress(g.tobytes(), "zstd", asbytes=True)) for r, g in zip(rows, parts)])

    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    names = "sig size alone ell common tokens places stored"

    def post(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        got = list(members(left, right.filter(pa.compute.is_valid(right.column("sig"))))) if left.num_rows else []
        if not got:
            return _table(names, kinds, [])
        codes = np.concatenate([code(s) for _, s in got])
        codes.sort()
        codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])]
        edges = np.searchsorted(codes, np.arange(parts + 1, dtype=np.uint64) << np.uint64(40))
        grade = np.zeros(len(codes), np.uint8)
        for r in rows:
            if r["grades"] is not None:
                a, b = edges[r["part"]], edges[r["part"] + 1]
                grade[a:b] = np.frombuffer(pa.decompress(r["grades"], int(b - a), "zstd", asbytes=True), np.uint8)
        out = []
        for sig, s in got:
            df = grade[np.searchsorted(codes, code(s))]
            if df.max() < 2:
                continue
            order = np.lexsort((s, df))
            s, df, size = s[order].view(np.int64), df[order].astype(int), len(s)
            alone = int((df < 2).sum())
            ell = matches(df, size, percent)
            upto = first_size(size, percent) + ell - 1
            if alone < min(upto, size):
                out.append((sig, size, alone, ell, 1 - alone / size, s[alone:upto].tolist(), list(range(alone, min(upto, size))), s[alone:].tobytes()))
        del got, codes, grade
        made = _table(names, kinds, out)
        del out
        give_back()
        return made

    copies = others.select("block", "doc_id", "sig")
    sent = dealt.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(emit, "part int, block int, keys binary, counts binary")
    grades = sent.groupBy("part").applyInArrow(count, "block int, part int, grades binary")
    both = copies.unionByName(grades, allowMissingColumns=True)
    schema = "sig binary, size int, alone int, ell int, common double, tokens array<long>, places array<int>, stored binary"
    active = saved(dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(post, schema), "prefixes")
    posts = active.select("sig", "size", "common", "ell", F.explode(F.arrays_zip("tokens", "places")).alias("p")).select(
        "sig", "size", "common", "ell", F.col("p.tokens").alias("token"), F.col("p.places").alias("place"))
    return posts, active.select("sig", "size", "alone", "common", "stored")


def verifier(percent: int) -> Callable:
    """Overlap of two sets, whether they link, and the prefix of what the first holds outside the second."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            overlap, linked, beyond = [], [], []
            for r in rows:
                x, y = np.frombuffer(r["x_set"], np.int64), np.frombuffer(r["y_set"], np.int64)
                inside = np.isin(x, y)
                o = int(inside.sum())
                overlap.append(o)
                linked.append(100 * o >= percent * (r["x_size"] + r["y_size"] - o))
                beyond.append(x[~inside][:max(0, first_size(r["x_size"], percent) - r["x_alone"])].tolist() if r["lead"] else [])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 1, 2, 3)] + [pa.array(overlap, pa.int32()), pa.array(linked, pa.bool_()),
                                             pa.array(beyond, pa.list_(pa.int64()))], names=["x", "y", "x_size", "y_size", "overlap", "linked", "beyond"])
    return run


def across_classes(table: pa.Table, percent: int) -> pa.Table:
    """Links between the members of one leader that lie in different classes: for each member outside the largest class, one link
    to every other class that has a similar member."""
    labels = table.column("label").to_pylist()
    sizes = np.array(table.column("size").to_pylist(), np.int64)
    names = table.column("x").to_pylist()
    held = [np.frombuffer(s, np.int64) for s in table.column("stored").to_pylist()]
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    flat = np.concatenate(held)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]            # members of each shingle, in a row
    number = {c: i for i, c in enumerate(sorted(set(labels)))}
    group = np.array([number[c] for c in labels])
    largest = np.bincount(group).argmax()
    out = []
    for i in np.flatnonzero(group != largest):
        lo, hi = np.searchsorted(flat, held[i], "left"), np.searchsorted(flat, held[i], "right")
        ends = np.cumsum(hi - lo)
        at = np.arange(ends[-1]) + np.repeat(lo - ends + hi - lo, hi - lo)
        overlap = np.bincount(owner[at], minlength=len(held))
        like = (100 * overlap >= percent * (sizes[i] + sizes - overlap)) & (group != group[i])
        for g in np.unique(group[like]):
            out.append((names[i], names[int(np.flatnonzero(like & (group == g))[0])]))
    return _table("a b", [pa.binary(), pa.binary()], out)


def join_lists(posts: DataFrame, stored: DataFrame, percent: int, rounds: int = 40) -> DataFrame:
    """Components (node, component) that all similar pairs make; documents without a link are left out."""
    facts = stored.select("sig", "size", "common")
    first = lambda side: F.col(f"{side}_size") - F.ceil(F.col(f"{side}_size") * percent / 100.0) + F.least("x_ell", "y_ell")
    lists = saved(posts.select(F.xxhash64("token").alias("list"), "sig", "size", "common", "ell", "place"), "lists")
    verified = links = labels = None
    for _ in range(rounds):
        tagged = lists if labels is None else lists.join(labels, "sig", "left")
        tagged = tagged.withColumn("class", F.col("sig") if labels is None else F.coalesce("label", "sig")).drop("label")
        tagged = saved(tagged, "lists")
        # a leader holds most that others hold; then the smallest, then the least digest
        heads = saved(tagged.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("c1"), F.max("class").alias("c2"),
                                                 F.max_by(F.struct("sig", "size"), F.struct("common", -F.col("size"), "sig")).alias("lead"))
                      .where("n > 1 and c1 <> c2").select("list", "n", "lead"), "lists")
        if heads.isEmpty():
            return (stored.where("false").select("sig", F.col("sig").alias("label")) if labels is None else labels).toDF("node", "component")
        short = tagged.join(heads.where(f"n <= {SHORT}").select("list"), "list")
        side = lambda s: short.select("list", *[F.col(c).alias(f"{s}_{c}") for c in ("sig", "size", "ell", "place", "class")])
        near = (side("x").join(side("y"), "list").where("x_sig < y_sig and x_class <> y_class")
                .where((100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size")))
                .where((F.col("x_place") < first("x")) & (F.col("y_place") < first("y")))
                .groupBy("x_sig", "y_sig").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("x_ell", "y_ell")).alias("asked"))
                .where("shared >= asked").select(F.col("x_sig").alias("x"), F.col("y_sig").alias("y"), F.lit(False).alias("lead")))
        long = saved(tagged.join(heads.where(f"n > {SHORT}"), "list").select("list", "sig", "size", "lead"), "lists")
        star = long.where("sig <> lead.sig").select(F.col("sig").alias("x"), F.col("lead.sig").alias("y"), F.lit(True).alias("lead")).distinct()
        pairs = near.unionByName(star).groupBy("x", "y").agg(F.max("lead").alias("lead"))
        if verified is not None:
            pairs = pairs.join(verified.select("x", "y"), ["x", "y"], "left_anti")
        get = lambda s: stored.select(F.col("sig").alias(s), F.col("size").alias(f"{s}_size"), F.col("alone").alias(f"{s}_alone"), F.col("stored").alias(f"{s}_set"))
        full = pairs.join(get("x"), "x").join(get("y").drop("y_alone"), "y").select("x", "y", "x_size", "y_size", "lead", "x_alone", "x_set", "y_set")
        out = saved(full.select("x", "y", "x_size", "y_size", "lead", "x_alone", "x_set", "y_set").mapInArrow(
            verifier(percent), "x binary, y binary, x_size int, y_size int, overlap int, linked boolean, beyond array<long>"), "verified")
        fresh = out.join(star, ["x", "y"], "left_semi")
        verified = fresh if verified is None else verified.unionByName(fresh)
        # all that met their leader this round, also those compared with it in an earlier one
        stars = verified.join(star, ["x", "y"], "left_semi")
        new = out.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
        if labels is None or not new.isEmpty():
            links = new if links is None else saved(links.unionByName(new), "links")
            labels = connected_components(links).select(F.col("node").alias("sig"), F.col("component").alias("label"))
        # a leader's members in more than one class
        tag = F.coalesce("label", "sig").alias("label")
        named = stored.join(labels, "sig", "left").select("sig", "size", "alone", tag)
        met = stars.select("x", "y").unionByName(stars.select(F.col("y").alias("x"), "y").distinct()).join(
            named.withColumnRenamed("sig", "x"), "x")
        mixed = saved(met.groupBy("y").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.sum(F.col("size") - F.col("alone")).alias("held"))
                      .where("l1 <> l2").select("y", "held"), "lists")
        inside = met.join(mixed.where(f"held <= {ONE_TASK}").select("y"), "y").select("x", "y", "label")
        found = saved(inside.join(stored.select(F.col("sig").alias("x"), "size", "stored"), "x").groupBy("y").applyInArrow(
            lambda t: across_classes(t, percent), "a binary, b binary"), "links")
        links = saved(links.unionByName(found), "links")
        labels = saved(connected_components(links).select(F.col("node").alias("sig"), F.col("component").alias("label")), "links")
        large = mixed.where(f"held > {ONE_TASK}").select("y")
        if large.isEmpty():
            return labels.toDF("node", "component")
        # what members hold outside their leader, in lists of leader and shingle
        beyond = (stars.join(large, "y").select(F.col("x").alias("sig"), "y", F.explode("beyond").alias("token"))
                  .select(F.xxhash64("y", "token").alias("list"), "sig"))
        # members smaller than the leader, and those not linked that could match them, in a list without the leader
        met = long.where("sig <> lead.sig").select("list", "sig", "size", F.col("lead.sig").alias("y"), F.col("lead.size").alias("y_size")).join(
            verified.join(large, "y").select(F.col("x").alias("sig"), "y", "overlap", "linked"), ["sig", "y"])
        small = met.where("size < y_size").groupBy("list").agg(F.min("size").alias("least"))
        reach = F.floor(F.col("overlap") * (100 + percent) / percent) - F.col("size")
        below = (met.join(small, "list").where((F.col("size") < F.col("y_size")) | (~F.col("linked") & (reach >= F.col("least"))))
                 .select(F.xxhash64("list", "y").alias("list"), "sig"))
        lists = saved(beyond.unionByName(below).distinct().join(facts, "sig")
                      .select("list", "sig", "size", "common", F.lit(1).alias("ell"), F.lit(-1).alias("place")), "lists")
    raise RuntimeError(f"lists not settled after {rounds} rounds")
