"""Suffix-array dedup: remove bytes that already stand in an earlier document, found by a distributed merge of suffix runs.

Documents are dealt into blocks. A block sorts the suffixes of its documents (to ``width`` bytes, equal ones once), front-codes
each sorted run and sends every range of it to that range's task. There a loser tree merges the runs; a player carries the
length of the prefix it shares with the last winner, so known prefixes are never compared again. The least document id of
each string goes back to the blocks that sent it.

Which suffixes take part is settled by three rules that lose no match:

* The least hashed ``gram`` inside a ``width``-byte string is found from the string alone, so equal strings share it. Distributed
  duplicate detection on these grams' hashes drops the suffixes whose gram no other document has.
* The first merge takes suffixes whose least gram stands at one of two fixed offsets. Between two of a document's matches that
  are at most ``width`` apart, all bytes are covered.
* Elsewhere any place is open. A second detection spreads the grams that open places have; a third, on hashes of the whole
  strings with these grams, drops those that no other document has; the second merge takes the rest.

Exact copies of a whole text need no merge: all but those of the least id are covered wholly (if long enough).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from knowntime.llm.common import block_count, give_back, partitions, saved

LAST = (1 << 63) - 1
#: Bytes of the texts of a block, on average.
BLOCK_BYTES = 12 << 20
#: What a block sends to itself: anchors with their marks, and the places of a pass.
KEPT = ("anchors", "first", "hits", "wanted", "second")
MESSAGE = "block int, kind string, part int, blob binary"
RUN = "part int, block int, kind string, lcps binary, tails binary, docs binary"


def sliding(x: np.ndarray, w: int, op: Callable) -> np.ndarray:
    """``op`` over every run of ``w`` neighbours, by doubling."""
    span, y = 1, x
    while span * 2 <= w:
        y = op(y[:-span], y[span:])
        span *= 2
    return op(y[:len(x) - w + 1], y[w - span:w - span + len(x) - w + 1]) if span < w else y


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of the ``k`` bytes from each place on, put together from runs of powers of two."""
    base = 0x9E3779B1

    def power(e: int) -> np.uint32:
        return np.uint32(pow(base, e, 1 << 32))

    runs, m, out, have = {1: data.astype(np.uint32) + np.uint32(1)}, 1, None, 0
    while m * 2 <= k:
        runs[2 * m] = runs[m][:-m] * power(m) + runs[m][m:]
        m *= 2
    for size in sorted(runs, reverse=True):
        if k & size:
            n = len(data) - have - size + 1
            out = runs[size] if out is None else out[:n] * power(size) + runs[size][have:have + n]
            have += size
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return out | np.uint32(1)                          # 0 stands for no gram


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """``gram_hashes`` of single grams."""
    step = 1 << 16
    return np.concatenate([gram_hashes(np.ascontiguousarray(rows[i:i + step]).ravel(), rows.shape[1])[::rows.shape[1]]
                           for i in range(0, len(rows), step)])


def gram_keys(rows: np.ndarray) -> np.ndarray:
    """A 63-bit hash (lowest bit clear) of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for column in wide.view(np.uint64).T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h & ~np.uint64(1)


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers by byte planes: the high ones are nearly constant."""
    flat = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize)
    return pa.compress(np.ascontiguousarray(flat.T).tobytes(), "zstd", asbytes=True)


def unsqueezed(blob: bytes, count: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, size * count, "zstd", asbytes=True), np.uint8).reshape(size, count)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays for a later pass, marks as bits."""
    return pickle.dumps([(len(a), a.dtype.str, np.packbits(a).tobytes() if a.dtype == bool else squeezed(a)) for a in arrays])


def unpacked(blob: bytes) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool) if kind == "|b1" else unsqueezed(p, n, np.dtype(kind))
            for n, kind, p in pickle.loads(blob)]


def steps(places: np.ndarray) -> np.ndarray:
    return np.diff(places, prepend=0).astype(np.uint32)


def from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, an order that sorts the keys, and where each distinct one starts in it."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    return ordered[starts], order, starts


def index_of(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each place's number among the distinct ones of ``grouped``."""
    index = np.empty(len(order), np.uint32)
    index[order] = np.repeat(np.arange(len(starts), dtype=np.uint32), np.diff(starts, append=len(order)))
    return index


class Block:
    """The documents of one block in a fixed order, their anchors, and what earlier passes have found."""

    def __init__(self, table: pa.Table, messages: pa.Table, width: int, gram: int):
        self.width, self.gram, self.slack = width, gram, width - gram + 1
        ids = [LAST if d is None else d for d in table.column("doc_id").to_pylist()]
        plain = {"block", "doc_id", "key", "text"}
        extra = list(zip(*[table.column(c).to_pylist() for c in table.column_names if c not in plain])) or [()] * len(ids)
        rows = sorted(zip(ids, table.column("key").to_pylist(), table.column("text").to_pylist(), extra), key=lambda r: r[:2])
        known = messages.to_pylist()
        copies = {m["blob"] for m in known if m["kind"] == "copy"}
        self.copies, self.docs = [], []
        for d, k, t, x in rows:
            (self.copies if d.to_bytes(8, "little", signed=True) + k in copies else self.docs).append((d, t, x))
        self.told: dict[str, list[tuple[int, bytes]]] = {}
        for m in known:
            if m["kind"] != "copy":
                self.told.setdefault(m["kind"], []).append((m["part"], m["blob"]))
        lengths = np.array([len(t) for _, t, _ in self.docs], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.ids = np.array([d for d, _, _ in self.docs], np.int64)
        self.data = np.frombuffer(b"".join(t for _, t, _ in self.docs), np.uint8)

    def state(self, kind: str) -> list[np.ndarray]:
        return unpacked(self.told[kind][0][1])

    def bits(self, kind: str, sizes: np.ndarray) -> np.ndarray:
        """The answers of all parts in a row; ``sizes``: how many strings or keys each part was asked about."""
        out = np.zeros(int(sizes.sum()), bool)
        ends = np.cumsum(sizes)
        for part, blob in self.told.get(kind, ()):
            out[ends[part] - sizes[part]:ends[part]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=int(sizes[part])).astype(bool)
        return out

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def recall_anchors(self) -> None:
        """Anchors and which of them are shared, as an earlier pass found them."""
        places, self.shared = self.state("anchors")
        self.at = from_steps(places)
        self.doc = self.doc_of(self.at)
        self.hash = np.empty(0, np.uint32) if not len(self.at) else row_hashes(self.windows(self.at, self.gram))

    def find_anchors(self, chunk: int = 1 << 20) -> None:
        """Places of least grams: of every ``width`` bytes of a document, at least one (all of them where they tie)."""
        found, hashes, lo, w = [], [], 0, self.slack
        while lo < len(self.docs):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + chunk, "right")))
            a, b = int(self.starts[lo]), int(self.ends[hi - 1])
            if b - a >= self.width:
                g = gram_hashes(self.data[a:b], self.gram)
                least = sliding(g, w, np.minimum)
                doc = np.repeat(np.arange(hi - lo), self.ends[lo:hi] - self.starts[lo:hi])
                least[doc[:len(least)] != doc[self.width - 1:]] = 0
                pad = np.zeros(w - 1, np.uint32)
                best = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
                here = np.flatnonzero(best[:len(g)] == g)
                found.append(here + a), hashes.append(g[here])
            lo = hi
        self.at = np.concatenate(found) if found else np.empty(0, np.int64)
        self.hash = np.concatenate(hashes) if found else np.empty(0, np.uint32)
        self.doc = self.doc_of(self.at)

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        if not len(at):
            return np.empty((0, size), np.uint8)
        return np.lib.stride_tricks.sliding_window_view(self.data, size)[at]

    def keys(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``grouped`` keys of the strings at the places, and whether two documents here hold each key."""
        keys, order, starts = grouped(gram_keys(self.windows(at, size)))
        doc = self.doc_of(at)[order]
        many = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts) if len(at) else np.zeros(0, bool)
        return keys, order, starts, many

    def learn_shared(self, buckets: int) -> None:
        """Which anchors' grams another document has."""
        keys, order, starts, _ = self.keys(self.at, self.gram)
        self.shared = self.bits("gram", bucket_sizes(keys, buckets))[index_of(order, starts)]

    def shared_grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of shared anchors in order, the anchors, each one's index into the keys, and the least document (number) of each key."""
        here = np.flatnonzero(self.shared)
        keys, order, starts = grouped(gram_keys(self.windows(self.at[here], self.gram)))
        first = np.minimum.reduceat(self.doc[here][order], starts) if len(here) else np.empty(0, np.int64)
        return keys, here, index_of(order, starts), first

    def least_anchor(self, at: np.ndarray) -> np.ndarray:
        """For each place the anchor (index) of its string's least gram, leftmost of ties; -1 where the string leaves the text."""
        if not len(at):
            return np.empty(0, np.int64)
        lo, hi = np.searchsorted(self.at, at, "left"), np.searchsorted(self.at, at + self.slack - 1, "right")
        doc = np.searchsorted(self.ends, at, "right")
        inside = at + self.width <= np.append(self.ends, -1)[doc]
        ranked = np.append((self.hash.astype(np.uint64) << np.uint64(32)) | np.arange(len(self.at), dtype=np.uint64), np.uint64(0))
        least = np.minimum.reduceat(ranked, np.stack([lo, hi], 1).ravel())[::2] & np.uint64(0xFFFFFFFF)
        return np.where(inside, least.astype(np.int64), -1)

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Marks of all places whose string may have one of these anchors' grams as its least."""
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, np.maximum(self.at[anchors] - self.slack + 1, 0), 1)
        np.add.at(step, self.at[anchors] + 1, -1)
        return np.cumsum(step[:-1]) > 0

    def sampled(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether the least gram stands at one of the two fixed offsets."""
        off = self.at[least] - at
        return (off == 0) | (off == self.slack // 2)

    def first_places(self) -> np.ndarray:
        own = self.at[self.shared]
        at = np.unique(np.concatenate([own, own - self.slack // 2]))
        at = at[at >= 0]
        least = self.least_anchor(at)
        return at[(least >= 0) & self.sampled(at, least) & self.shared[least]] if len(self.at) else at

    def open_grams(self, hits: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of shared anchors, and which of them are the least gram of a place that the first merge left open while a
        smaller document has them."""
        keys, here, index, first = self.shared_grams()
        earlier = self.bits("least", bucket_sizes(keys, buckets))
        follows = np.zeros(len(self.at), bool)
        follows[here] = earlier[index] | (self.ids[self.doc[here]] > self.ids[first][index])
        mark = self.around(np.flatnonzero(follows))
        doc = self.doc_of(hits)
        near = (np.diff(hits) <= self.width) & (doc[1:] == doc[:-1])
        step = np.zeros(len(self.data) + 2, np.int32)
        np.add.at(step, hits[:-1][near], 1)
        np.add.at(step, hits[1:][near] + 1, -1)
        at = np.flatnonzero(mark & (np.cumsum(step[:-2]) == 0))
        least = self.least_anchor(at)
        open_ = (least >= 0) & follows[least] & ~self.sampled(at, least) if len(at) else np.empty(0, bool)
        wanted = np.zeros(len(keys), bool)
        number = np.zeros(len(self.at), np.uint32)
        number[here] = index
        wanted[number[least[open_]]] = True
        return keys, wanted

    def wanted_places(self, buckets: int) -> np.ndarray:
        """All places, but for those of the first merge, whose least gram some document has at an open place."""
        keys, here, index, _ = self.shared_grams()
        wanted = np.zeros(len(self.at), bool)
        wanted[here] = self.bits("want", bucket_sizes(keys, buckets))[index]
        at = np.flatnonzero(self.around(np.flatnonzero(wanted)))
        least = self.least_anchor(at)
        return at[(least >= 0) & wanted[least] & ~self.sampled(at, least)] if len(at) else at

    def second_places(self, at: np.ndarray, buckets: int) -> np.ndarray:
        """Those of the wanted places whose whole string another document seems to have."""
        keys, order, starts = grouped(gram_keys(self.windows(at, self.width)))
        return at[self.bits("string", bucket_sizes(keys, buckets))[index_of(order, starts)]]

    def sorted_run(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings at the places in byte order, the least id of each here, each place's index into them, and whether its
        document comes after that of the least id."""
        strings, order, starts = grouped(np.ascontiguousarray(self.windows(at, self.width)).view(f"S{self.width}").ravel())
        index, doc = index_of(order, starts), self.doc_of(at)
        docs = self.ids[np.minimum.reduceat(doc[order], starts) if len(at) else doc]      # documents are in id order
        return strings, docs, index, self.ids[doc] > docs[index]

    def hits(self, kind: str) -> np.ndarray:
        """The places of a merge whose string stands in a document of smaller id: one of another block, or one of this."""
        places, index, later, sizes = self.state(kind)
        return from_steps(places)[self.bits(f"{kind} run", sizes)[index] | later]


def bucket_sizes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """How many of the sorted keys lie in each hash range."""
    return np.diff(np.searchsorted(keys, bucket_edges(buckets)), prepend=0, append=len(keys))


def bucket_edges(buckets: int) -> np.ndarray:
    """Lower ends of the hash ranges 1, 2, ... of the duplicate detection."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def front_code(strings: np.ndarray) -> tuple[bytes, bytes]:
    """Lengths of the prefix shared with the string before, and the bytes after it, packed by zstd."""
    width = strings.dtype.itemsize
    rows = strings.view(np.uint8).reshape(-1, width)
    lcp = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        lcp[1:] = (rows[1:] != rows[:-1]).argmax(1)
    return lcp.tobytes(), pa.compress(rows[np.arange(width) >= lcp[:, None]].tobytes(), "zstd", asbytes=True)


def decode(lcps: bytes, tails: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(shared prefix, string) of a front-coded run."""
    tails = pa.decompress(tails, width * len(lcps) - sum(lcps), "zstd", asbytes=True)
    at, s = 0, b""
    for lcp in lcps:
        s = s[:lcp] + tails[at:at + width - lcp]
        at += width - lcp
        yield lcp, s


def merge(runs: list[Iterator[tuple[int, bytes]]], width: int) -> tuple[list[int], list[bool]]:
    """Merge sorted runs: for each string in order its run, and whether it differs from the string before.

    Loser tree whose players know the prefix they share with the last winner. The longer shared prefix wins unseen; only
    equal ones are compared, from that prefix on, and the loser keeps the prefix it shares with its victor.
    """
    size = 1
    while size < len(runs):
        size *= 2
    nothing = (-1, b"")
    pull = [r.__next__ for r in runs]
    players = []
    for r in range(size):
        lcp, s = next(runs[r], nothing) if r < len(runs) else nothing
        players.append((lcp, s))
    known = [p[0] for p in players]                    # -1: run at its end
    string = [p[1] for p in players]
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = known[a]
        if h < 0:
            return a, b
        x, y = string[a][h:], string[b][h:]
        if x == y:
            known[b] = width
            return a, b
        apart = width - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        if x < y:
            known[b] = apart
            return a, b
        known[a] = apart
        return b, a

    winners = list(range(size))                        # first round, from the leaves up
    level = winners
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, loser[node + i // 2] = play(level[i], level[i + 1])
            up.append(w)
        level = up
    top = level[0]
    order, new = [], []
    while known[top] >= 0:
        order.append(top)
        new.append(known[top] < width)
        try:
            known[top], string[top] = pull[top]()
        except StopIteration:
            known[top] = -1
        node = (size + top) >> 1
        while node:
            other = loser[node]
            a, b = known[top], known[other]
            if a < b:
                loser[node], top = top, other
            elif a == b:
                top, loser[node] = play(top, other)
            node >>= 1
    return order, new


def least_ids(runs: list[tuple[bytes, bytes, np.ndarray]], width: int) -> list[np.ndarray]:
    """For each string of each front-coded run the least document id with which any run holds it."""
    order, new = merge([decode(lcps, tails, width) for lcps, tails, _ in runs], width)
    docs = np.concatenate([d for _, _, d in runs])
    place = np.argsort(np.array(order), kind="stable")         # of each run's strings in the merged order
    merged = np.empty(len(docs), np.int64)
    merged[place] = docs
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(merged, starts)[np.cumsum(new) - 1][place]
    return np.split(least, np.cumsum([len(d) for _, _, d in runs])[:-1])


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[n for n, _ in schema])


_MESSAGE = [("block", pa.int32()), ("kind", pa.string()), ("part", pa.int32()), ("blob", pa.binary())]
_RUN = [("part", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("lcps", pa.binary()), ("tails", pa.binary()), ("docs", pa.binary())]


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 20, carry: Sequence[str] = (), give: str = "bytes") -> DataFrame:
    """Remove every byte of a text covered by a ``width``-byte string that also starts in a document of smaller doc_id.

    Takes (doc_id, text); returns doc_id, the columns to ``carry``, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256. ``give`` "bytes" adds kept (the remaining bytes) and spans (start and end of each removed run); "text" adds them
    with kept as a string, without characters that a cut went through; "digest" adds nothing. Strings are judged on the input and
    never cross documents. Null text counts as empty; texts under ``width`` bytes lose nothing; rows of one doc_id do not remove each
    other's bytes; a null doc_id comes after all others. Repeated rows get one result each.
    """
    n = partitions(docs)                               # ranges of the merges, and of the detections
    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    hashed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                         key.alias("key"), *carry)
    block = F.pmod(F.xxhash64("doc_id", "key"), F.lit(block_count(docs, BLOCK_BYTES))).cast("int").alias("block")
    dealt = hashed.select(block, "doc_id", "key", "text", *carry)
    rank = F.coalesce("doc_id", F.lit(LAST))

    # whole copies: a group is one row, wherever its members are
    groups = saved(hashed.select("key", rank.alias("id")).groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                   .where("last > first").select("key", "first"), "copies")
    reverse = F.unhex(F.concat(*[F.substring(F.lpad(F.hex(rank), 16, "0"), i, 2) for i in range(15, 0, -2)]))     # little-endian
    copies = saved(hashed.select("doc_id", "key").join(groups, "key").where(rank > F.col("first"))
                   .select(block, F.lit("copy").alias("kind"), F.lit(0).alias("part"), F.concat(reverse, "key").alias("blob")), "copies")

    cuts = splitters(docs, n, width)

    def opened(left: pa.Table, right: pa.Table) -> tuple[Block, int]:
        return Block(left, right, width, gram), left.column("block")[0].as_py()

    def emit_grams(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_MESSAGE, [])
        b, me = opened(left, right)
        b.find_anchors()
        keys, _, _, many = b.keys(b.at, gram)
        return _rows(_MESSAGE, to_buckets(me, "gram", keys, many))

    def detect(table: pa.Table) -> pa.Table:
        """Flag keys that any block marked by the lowest bit, or (but for kind want) that two blocks sent. What a block keeps for
        itself passes through."""
        rows = table.to_pylist()
        out = [(r["block"], r["kind"], 0, r["blob"]) for r in rows if r["kind"] in KEPT]
        rows = [r for r in rows if r["kind"] not in KEPT]
        if rows:
            sent = [np.frombuffer(r["blob"], np.uint64) for r in rows]
            flat = np.concatenate(sent)
            keys, order, starts = grouped(flat & ~np.uint64(1))
            index = index_of(order, starts)
            flag = np.zeros(len(keys), bool) if rows[0]["kind"] == "want" else np.diff(starts, append=len(flat)) > 1
            flag[index[(flat & np.uint64(1)) == 1]] = True
            parts = np.split(flag[index], np.cumsum([len(x) for x in sent])[:-1])
            out += [(r["block"], r["kind"], r["part"], np.packbits(p).tobytes()) for r, p in zip(rows, parts)]
        return _rows(_MESSAGE, out)

    def to_buckets(me: int, kind: str, keys: np.ndarray, marked: np.ndarray) -> list[tuple]:
        at = [0, *np.cumsum(bucket_sizes(keys, n))]
        keys = keys | marked.astype(np.uint64)
        return [(me, kind, i, keys[lo:hi].tobytes()) for i, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]

    def runs_of(b: Block, me: int, kind: str, at: np.ndarray) -> list[tuple]:
        """The sorted run of the places, cut by range; and what the block must know to read the answers."""
        strings, least, index, later = b.sorted_run(at)
        edges = [0, *np.searchsorted(strings, cuts), len(strings)]
        out = [(i, me, f"{kind} run", *front_code(strings[lo:hi]), squeezed(least[lo:hi]))
               for i, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
        return [*out, (me % n, me, kind, packed(steps(at), index, later, np.diff(edges)), b"", b"")]

    def emit_first(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_RUN, [])
        b, me = opened(left, right)
        b.find_anchors()
        b.learn_shared(n)
        out = runs_of(b, me, "first", b.first_places())
        keys, _, _, first = b.shared_grams()
        at, own = [0, *np.cumsum(bucket_sizes(keys, n))], b.ids[first]
        out += [(i, me, "least", keys[lo:hi].tobytes(), b"", squeezed(own[lo:hi])) for i, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]
        return _rows(_RUN, [*out, (me % n, me, "anchors", packed(steps(b.at), b.shared), b"", b"")])

    def emit_wanted(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_MESSAGE, [])
        b, me = opened(left, right)
        b.recall_anchors()
        hits = b.hits("first")
        return _rows(_MESSAGE, [*to_buckets(me, "want", *b.open_grams(hits, n)), (me, "hits", me % n, packed(steps(hits)))])

    def emit_strings(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_MESSAGE, [])
        b, me = opened(left, right)
        b.recall_anchors()
        at = b.wanted_places(n)
        keys, _, _, many = b.keys(at, width)
        return _rows(_MESSAGE, [*to_buckets(me, "string", keys, many), (me, "wanted", me % n, packed(steps(at)))])

    def emit_second(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_RUN, [])
        b, me = opened(left, right)
        return _rows(_RUN, runs_of(b, me, "second", b.second_places(from_steps(b.state("wanted")[0]), n)))

    def merge_range(table: pa.Table) -> pa.Table:
        """Which strings of the runs, and which keys, another block has with a smaller id."""
        rows = table.to_pylist()
        runs = [r for r in rows if r["kind"].endswith(" run")]
        grams = [r for r in rows if r["kind"] == "least"]
        out = [(r["block"], r["kind"], 0, r["lcps"]) for r in rows if r["kind"] in KEPT]
        if runs:
            ids = [unsqueezed(r["docs"], len(r["lcps"]), np.int64) for r in runs]
            found = least_ids([(r["lcps"], r["tails"], d) for r, d in zip(runs, ids)], width)
            out += [(r["block"], r["kind"], r["part"], np.packbits(f < d).tobytes()) for r, f, d in zip(runs, found, ids)]
        if grams:
            keys, order, starts = grouped(np.concatenate([np.frombuffer(r["lcps"], np.uint64) for r in grams]))
            sizes = [len(r["lcps"]) // 8 for r in grams]
            own = np.concatenate([unsqueezed(r["docs"], k, np.int64) for r, k in zip(grams, sizes)])
            earlier = np.minimum.reduceat(own[order], starts)[index_of(order, starts)] < own
            out += [(r["block"], "least", r["part"], np.packbits(f).tobytes()) for r, f in zip(grams, np.split(earlier, np.cumsum(sizes)[:-1]))]
        return _rows(_MESSAGE, out)

    shape = docs.select(F.col("doc_id").cast("long"), *carry).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        shape = shape.add(name, kind)
    if give != "digest":
        shape = shape.add("kept", "string" if give == "text" else "binary").add("spans", ArrayType(LongType()))
    result = [(f.name, f.type) for f in to_arrow_schema(shape)]

    def finish(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(result, [])
        b, _ = opened(left, right)
        step = np.zeros(len(b.data) + 1, np.int32)
        for at in (from_steps(b.state("hits")[0]), b.hits("second")):
            np.add.at(step, at, 1)
            np.add.at(step, at + width, -1)
        gone = np.cumsum(step[:-1]) > 0
        out = []

        def row(doc: int, text: bytes, extra: tuple, spans: list[int]) -> None:
            left_over = [text[i:j] for i, j in zip([0, *spans[1::2]], [*spans[::2], len(text)])]
            kept = b"".join(left_over)
            out.append((None if doc == LAST else doc, *extra, len(text), len(text) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest()))
            if give != "digest":
                out[-1] += ("".join(x.decode("utf-8", "ignore") for x in left_over) if give == "text" else kept, spans)

        for doc, text, extra in b.copies:
            row(doc, text, extra, [0, len(text)] if len(text) >= width else [])
        for (doc, text, extra), lo, hi in zip(b.docs, b.starts, b.ends):
            mask = gone[lo:hi]
            row(doc, text, extra, np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0)).tolist() if mask.any() else [])
        return _rows(result, out)

    def to_blocks(messages: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = fn(key, left, right)
            give_back()
            return out
        return dealt.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(run, schema)

    told = lambda known, *kinds: copies.unionByName(known.where(F.col("kind").isin(*kinds)))
    shared = to_blocks(copies, emit_grams, MESSAGE).groupBy("part").applyInArrow(detect, MESSAGE)
    first = saved(to_blocks(copies.unionByName(shared), emit_first, RUN).groupBy("part").applyInArrow(merge_range, MESSAGE), "suffixes")
    wanted = saved(to_blocks(told(first, "anchors", "first", "first run", "least"), emit_wanted, MESSAGE)
                   .groupBy("part").applyInArrow(detect, MESSAGE), "suffixes")
    strings = saved(to_blocks(told(first, "anchors").unionByName(wanted.where("kind = 'want'")), emit_strings, MESSAGE)
                    .groupBy("part").applyInArrow(detect, MESSAGE), "suffixes")
    second = to_blocks(told(strings, "wanted", "string"), emit_second, RUN).groupBy("part").applyInArrow(merge_range, MESSAGE)
    return to_blocks(told(wanted, "hits").unionByName(second), finish, shape)


def splitters(docs: DataFrame, n: int, width: int, oversample: int = 20) -> np.ndarray:
    """Strings that cut the byte order into ``n`` ranges, from about ``oversample`` documents' substrings per range.

    They only balance the ranges; any cuts give the same result. The sample is as long as the list of ranges needs.
    """
    total = docs.count()
    every = max(1, total // (oversample * n))
    h = F.xxhash64("doc_id", "text")
    piece = F.expr(f"substring(cast(text as binary), cast(1 + pmod(h, greatest(octet_length(text) - {width} + 1, 1)) as int), {width})")
    found = (docs.where("text is not null").select("doc_id", "text", h.alias("h")).where(F.pmod(F.col("h"), F.lit(every)) == 0)
             .select(piece.alias("s")).where(F.octet_length("s") == width).distinct())
    sample = np.sort(np.array([r.s for r in found.toLocalIterator()], f"S{width}"))
    if not len(sample):
        return sample
    return np.unique(sample[(np.arange(1, n) * len(sample)) // n])
