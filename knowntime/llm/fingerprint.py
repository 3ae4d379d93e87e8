"""Quartile bucket digests: counts of hashed byte triplets, each bucket told by the quartile it falls in, plus the length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm.common import partitions, saved

BUCKETS = 256
#: Bytes of a sliding window; its byte triplets are counted.
WINDOW = 5
#: Length classes grow by this factor.
STEP = 1.1
#: A difference at or above this is a likeness of 0.
FAR = 600


def triplet_counts(data: bytes) -> np.ndarray:
    """Counts of hashed byte triplets: of each window of five bytes the last byte with two of the others, six ways."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(b)
    total = np.zeros(BUCKETS, np.int64)
    for salt, (i, j) in enumerate(((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))):
        m = n - j
        if m <= 0:
            continue
        x = b[j:] * np.uint32(0x9E3779B1) + b[j - i:n - i] * np.uint32(0x85EBCA77) + b[:m] * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        total += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    """Hex: two digits of length class, then two bits per bucket (how many quartiles its count exceeds).

    Equal bytes give equal digests. Texts under three bytes have no triplet: all buckets are 0, the length tells them apart
    from longer ones only.
    """
    counts = triplet_counts(data)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, None] > quartiles[None, :]).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = (code << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()
    grade = min(255, int(np.log(len(data) + 1) / np.log(STEP)))
    return f"{grade:02x}{packed.hex()}"


def difference(a: str, b: str) -> int:
    """Bounded difference of two digests: 1 per quartile apart (6 for opposite ends), plus the length classes apart."""
    x, y = (np.frombuffer(bytes.fromhex(s[2:]), np.uint8) for s in (a, b))
    score = 0
    for shift in (0, 2, 4, 6):
        d = np.abs(((x >> shift) & 3).astype(np.int16) - ((y >> shift) & 3))
        score += int(np.where(d == 3, 6, d).sum())
    grades = abs(int(a[:2], 16) - int(b[:2], 16))
    return min(FAR, score + (grades if grades <= 1 else 6 * grades))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at the greatest difference told apart."""
    return 1.0 - difference(a, b) / FAR


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by as many first characters of the following one (or all it has)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint (doc_id, text) and compare each text with the next one in falling doc_id and with its edited form.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text counts as
    empty; rows of one doc_id follow each other in text order; the first row follows the last; a single row follows itself.

    One range shuffle sorts the texts; tasks stream their range and hold two texts. A range's last row meets the head of
    the next range in a second step over one row per range.
    """
    n = partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    ordered = rows.repartitionByRange(n, order[0]).sortWithinPartitions(*order)      # ranges are cut by id alone: small samples
    facts = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = f"doc_id long, {facts}, part int, kind string, text string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[x.split()[1]])
                       for x in schema.split(", ")])

    def compare(text: str, fp: str, following: str, next_fp: str) -> tuple:
        other = edited(text, following).encode()
        edited_fp = digest(other)
        return (len(text), hashlib.sha256(other).hexdigest(), fp, edited_fp, likeness(fp, edited_fp), likeness(fp, next_fp))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, held = TaskContext.get().partitionId(), None

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], names=names)

        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fp = digest(text.encode())
                if held is None:
                    out.append((doc, *[None] * 2, fp, *[None] * 3, part, "head", text))
                else:
                    out.append((held[0], *compare(held[1], held[2], text, fp), part, "row", None))
                held = (doc, text, fp)
            if out:
                yield batch(out)
        if held:
            yield batch([(held[0], *[None] * 2, held[2], *[None] * 3, part, "tail", held[1])])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r["doc_id"], *compare(r["text"], r["fingerprint"], r["next_text"], r["next_fp"])) for r in b.to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), list(kinds)[:7])], names=names[:7])

    seen = saved(ordered.mapInArrow(stream, schema), "fingerprints")
    # one head and one tail per range: which range follows is settled on their numbers alone, then texts join by number
    heads = seen.where("kind = 'head'").select("part", "text", "fingerprint")
    tails = seen.where("kind = 'tail'")
    follow = numbered_ring(heads.select("part"))
    joined = (tails.join(follow, "part")
              .join(heads.select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp")), "after")
              .select("doc_id", "text", "fingerprint", "next_text", "next_fp"))
    facts_only = [c for c in names[:7]]
    return seen.where("kind = 'row'").select(*facts_only).unionByName(joined.mapInArrow(close, f"doc_id long, {facts}"))


def numbered_ring(parts: DataFrame) -> DataFrame:
    """For each range number the next one that has rows; the first follows the last. One row per range partition."""
    from pyspark.sql import Window as W
    w = W.orderBy("part")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return parts.select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(whole)).alias("after"))
