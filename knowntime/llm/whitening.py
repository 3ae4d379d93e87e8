"""Embedding whitening with a covariance from variances alone.

For every dimension and every pair of dimensions the exact sum of squared centred values is aggregated, of the pair that of its sum.
As var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of these variances are all covariances. Values are integers, centred as
n * x - S, and are summed as integers, so nothing is lost before the one division. The matrix (dimensions x dimensions, whatever the
size) is put together on the driver for eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm.common import saved

#: Rows of a batch that are squared at a time.
CHUNK = 4096


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x of the rows whose vector is whole: no null, all components finite."""
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where("embedding is not null").where(usable).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def matrix(x: pa.Array, wide: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers, short ones filled up with zeros."""
    sizes = pa.compute.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if (sizes == wide).all():
        return flat.reshape(len(x), wide)
    out = np.zeros((len(x), wide), np.int64)
    at = np.repeat(np.arange(len(x)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sum of the squares of each column.

    Values are split into two halves of bits whose products and sums of up to CHUNK rows stay below 64 bits.
    """
    bits = int(np.abs(y).max(initial=0)).bit_length()
    if bits <= 25:
        return (y * y).sum(0).tolist()
    if bits > 50:
        return [sum(int(v) * int(v) for v in column) for column in y.T]
    low, half = y & ((1 << 25) - 1), y >> 25
    parts = [(half * half).sum(0).tolist(), (half * low).sum(0).tolist(), (low * low).sum(0).tolist()]
    return [(hh << 50) + (hl << 26) + ll for hh, hl, ll in zip(*parts)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """n^3 times twice the covariance matrix of the vectors x of ``fit``, exact.

    Each task adds up the squares of its rows for all dimensions and pairs; one row for each of them and task is shuffled and summed
    as a decimal.
    """
    wide = len(sums)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (wide - i) for i in range(wide)]
        for batch in batches:
            x = matrix(batch.column(0), wide)
            for lo in range(0, len(x), CHUNK):
                y = n * x[lo:lo + CHUNK] - np.array(sums, np.int64)
                for i in range(wide):
                    pair = y[:, i:] + y[:, i:i + 1]
                    pair[:, 0] = y[:, i]
                    total[i] = [a + b for a, b in zip(total[i], square_sums(pair))]
        rows = [(i, i + d, Decimal(v)) for i, row in enumerate(total) for d, v in enumerate(row)]
        a, b, v = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.decimal128(38, 0))], names=["a", "b", "total"])

    got = fit.select("x").mapInArrow(squares, "a int, b int, total decimal(38,0)").groupBy("a", "b").agg(F.sum("total").alias("total")).collect()
    v = [[0] * wide for _ in range(wide)]
    for r in got:
        v[r["a"]][r["b"]] = int(r["total"])
    return [[2 * v[i][i] if i == j else v[min(i, j)][max(i, j)] - v[i][i] - v[j][j] for j in range(wide)] for i in range(wide)]


def whiten(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Whitened coordinates of every row of (vec_id, embedding) along the components of greatest variance.

    x = floor(scale * component); the fit list is each distinct x once (n of them, S their sums), covariances have divisor n.
    Returns vec_id, component (from 1), n, deviation (exact sum over dimensions of (n * x - S)^2), whitened, explained (share of the
    whole variance) and identity_error (largest entry by which the covariance of whitened over the fit list misses the identity).
    Rows with a null vector or a null or non-finite component go; a null vec_id stays; repeated rows get a result each; short
    vectors count as filled up with zeros; other columns are ignored. A component without variance has whitened null and takes no part in
    identity_error. No rows give no rows. Each value n * x - S and each deviation must fit 64 bits (else an error). The driver
    holds a dimensions x dimensions matrix, so the count of dimensions should stay in the thousands.
    """
    whole = saved(integer_vectors(rows, scale), "vectors")
    fit = saved(whole.select("x").distinct(), "fit")
    head = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("wide"), F.max(F.expr("aggregate(x, 0L, (m, v) -> greatest(m, abs(v)))")).alias("most")).first()
    n, wide = head["n"], head["wide"] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not wide:
        return rows.sparkSession.createDataFrame([], schema)
    if 2 * n * head["most"] * 2 >= 1 << 62:
        raise OverflowError("n * x does not fit 64 bits")
    cells = fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sum("v").alias("s")).collect()
    sums = [0] * wide
    for r in cells:
        sums[r["dim"]] = r["s"]

    double = covariance(fit, n, sums)
    cov = np.array([[v / (2 * n ** 3) for v in row] for row in double])      # one rounding per entry
    e, vectors = np.linalg.eigh(cov)
    top = np.argsort(-e, kind="stable")[:components]
    whole_variance = sum(double[i][i] for i in range(wide)) / (2 * n ** 3)
    real = e[top] > max(whole_variance, 0.0) * wide * np.finfo(float).eps
    axes = vectors[:, top] / np.sqrt(np.where(real, e[top], 1.0))
    explained = [float(v) / whole_variance if whole_variance else None for v in e[top]]
    k = len(top)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            y = n * matrix(batch.column(at), wide) - np.array(sums, np.int64)
            big = int(np.abs(y).max(initial=0)) ** 2 * wide >= 1 << 63
            deviation = [sum(int(v) ** 2 for v in row) for row in y] if big else (y * y).sum(1)
            w = (y / n) @ axes
            columns = [pa.array(w[:, c] if real[c] else [None] * len(w), pa.float64()) for c in range(k)]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(deviation, pa.int64()), *columns],
                                             names=[*(f for f in batch.schema.names if f != "x"), "deviation", *(f"w{c}" for c in range(k))])

    w_schema = ", ".join(f"w{c} double" for c in range(k))
    used = [c for c in range(k) if real[c]]
    pairs = [(a, b) for a in used for b in used if a <= b]
    error = None
    if pairs:
        seen = fit.select("x").mapInArrow(project, f"deviation long, {w_schema}").agg(
            *[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
        error = max(abs(seen[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    out = whole.select("vec_id", "x").mapInArrow(project, f"vec_id long, deviation long, {w_schema}")
    each = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.col(f"w{c}").alias("whitened"), F.lit(explained[c]).cast("double").alias("explained"))
                     for c in range(k)])
    return out.select("vec_id", "deviation", F.explode(each).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
