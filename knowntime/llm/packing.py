"""Packing by powers of two: each document's ids are cut along its length's binary digits, and pieces of one length form
a bucket. Every piece is a whole sequence, so no sequence crosses documents and none is padded."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowntime.llm.common import give_back, slices

#: Fixed value: plain Latin letters (each has one lower-case letter and no combining form), then a run of ASCII marks
#: (without the apostrophe of contractions and the bracket that opens special tokens).
PLAIN = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\[-`{-~]*)"


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest as letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class WordIds(dict):
    """Ids, as little-endian bytes, of pieces of text between ASCII spaces.

    The vocabulary drops white space, so a text's ids are those of its space-separated pieces in a row. Frequent pieces
    come from this table; a plain word is split from its closing mark, so "Word," and "word." share one lookup.
    """

    def __init__(self, path: str, limit: int):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer, self.limit, self.cores = Tokenizer.from_file(path), limit, {}
        self.model, self.plain, self.letters = self.tokenizer.model, re.compile(PLAIN).fullmatch, byte_letters()

    def core(self, word: str) -> bytes:
        ids = self.cores.get(word)
        if ids is None:
            if len(self.cores) >= self.limit:
                self.cores.clear()
            written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.model.tokenize(written)]
            ids = self.cores[word] = np.array(found, "<u4").tobytes()
        return ids

    def __missing__(self, piece: str) -> bytes:
        m = self.plain(piece)
        if m:
            ids = self.core(m[1].lower()) + (self.core(m[2]) if m[2] else b"")
        else:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def binary_pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of pieces that cover ``n`` ids: full ones of ``most`` (a power of two), then n's lower binary digits
    from the largest down."""
    out = [(s, most) for s in range(0, n - most + 1, most)]
    at, rest = n - n % most, n % most
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack(docs: DataFrame, vocabulary: str, most: int = 2048, end_id: int = 1, cache: int = 300_000) -> DataFrame:
    """Cut the ids of every text (doc_id, text), closed by ``end_id``, into power-of-two sequences of at most ``most`` ids.

    Returns one row per piece: doc_id, start, length, doc_tokens, sequence_id, offset (0: a piece is a whole sequence),
    bucket (log2 of the length) and ids (little-endian 32-bit). A null or empty text is its closing id alone; repeated
    rows are packed once each. One pass, no shuffle; a task holds one batch of texts and the ``cache`` bounded tables.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what this worker's last stage left
        words = WordIds(vocabulary, cache)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 22):
                part = batch.slice(lo, hi - lo)
                who, start, length, total, ids = [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    flat = words.encode(text or "") + end
                    n = len(flat) // 4
                    for s, size in binary_pieces(n, most):
                        who.append(doc), start.append(s), length.append(size), total.append(n)
                        ids.append(flat[4 * s:4 * (s + size)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"])
        del words
        give_back()

    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return (cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
            .withColumn("bucket", bucket_of(F.col("length"))))


def bucket_of(length: Column) -> Column:
    return F.round(F.log2(length)).cast("int")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, for curricula that draw batches of equal length."""
    packed.write.partitionBy("bucket").parquet(path)
