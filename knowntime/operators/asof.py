"""As-of joins: attach what was known at each probe's time.

All four operators share one shape. Facts and probes are stacked and sorted inside
``(entity, time chunk)``; a window carries the newest fact forward. The chunk splits an
entity that holds a large share of all rows over many tasks, and a small *carry* (the
last rows, or the running totals, of the chunks before) makes the split exact. There is no
range join, so a busy entity never produces fact x probe pairs.

Ties: with ``strict`` a fact at exactly the probe's time is invisible, otherwise visible.

Unknowns: a fact whose time or key is NULL is visible to nobody. A probe whose time or key is NULL sees
nothing; such probes are dealt over many groups, so that they never gather in one task.

The plan is the same at every size: the chunks are fixed stretches of time. Where an entity may burst (very many facts inside one
chunk, or even at one instant), ``burst_cuts`` finds cuts by rank, and the operators take them as ``cuts``: the busy chunks
then fall into pieces of about equal size, with carries between pieces as between chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from knowntime.functions.times import DAY_US, as_micros

CHUNK_DAYS = 366
#: Probes that can see nothing are dealt over so many groups.
COLD_GROUPS = 1024
#: Room for the pieces of a chunk in its number.
PIECES = 1 << 20
#: Sampled facts per piece when cuts are looked for.
SAMPLED = 64
#: Before all times: what a chunk is carried from the ones before.
AT_START = -(1 << 62)


def _chunk(width: int | None) -> Column:
    return F.floor(F.col("_t") / F.lit(width)).cast("bigint") if width else F.lit(0).cast("bigint")


def _dated(facts: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Facts whose time and keys are known."""
    return facts.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in dict.fromkeys([*keys, time])]))


def _width(chunk_days: float | None) -> int | None:
    return int(chunk_days * DAY_US) if chunk_days else None


def burst_cuts(facts: DataFrame, keys: Sequence[str], *, time: str, order: Sequence[str] = (), rows: int = 1_000_000,
               chunk_days: float = CHUNK_DAYS) -> DataFrame:
    """Cuts (struct of time and ``order``) of every chunk of an entity that holds more than ``rows`` facts.

    Facts at one instant are cut by ``order``. Cuts are quantiles of a sample by hash, so pieces hold about ``rows`` facts; any cuts
    give the same result. The table has one row per busy chunk, at most one for every ``rows`` facts: it is broadcast.
    """
    keys, known = list(keys), _dated(facts, keys, time)
    ties = [f"_o{i}" for i in range(len(order))]
    f = (known.select(*keys, as_micros(known, time).alias("_t"), *[F.col(c).alias(t) for c, t in zip(order, ties)])
         .withColumn("_whole", _chunk(_width(chunk_days))))
    busy = f.groupBy(*keys, "_whole").agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    place = F.struct("_t", *ties)
    share = F.lit(float(1 << 30)) * SAMPLED / rows
    sample = f.where(F.pmod(F.xxhash64("_t", *ties), F.lit(1 << 30)) < share) if ties else f.where(F.rand(7) < SAMPLED / rows)
    found = (sample.join(F.broadcast(busy), [*keys, "_whole"])
             .groupBy(*keys, "_whole").agg(F.sort_array(F.collect_list(place)).alias("_s"), F.ceil(F.max("_n") / rows).alias("_k")))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_k") - 1, F.lit(1)).cast("int")),
                      lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_k")).cast("int")))
    return found.select(*keys, "_whole", F.array_distinct(cut).alias("_cuts"))


def _cut(frame: DataFrame, keys: Sequence[str], width: int | None, cuts: DataFrame | None,
         before: Callable[[Column], Column]) -> DataFrame:
    """Add ``_chunk``: the stretch of time, and within it the number of cuts that lie ``before`` the row."""
    if cuts is None or not width:
        return frame.withColumn("_chunk", _chunk(width) * PIECES)
    j = frame.withColumn("_whole", _chunk(width)).join(F.broadcast(cuts), [*keys, "_whole"], "left")
    piece = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", before))).otherwise(0)
    return j.withColumn("_chunk", F.col("_whole") * PIECES + piece).drop("_whole", "_cuts")


def _stack_probes(probes: DataFrame, keys: Sequence[str], probe_time: str, strict: bool,
                  width: int | None, cuts: DataFrame | None = None) -> DataFrame:
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "_t"]])
    cold = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("_probe"), F.lit(COLD_GROUPS))
    # A probe stands in the last piece that can hold a fact it sees.
    before = (lambda c: c["_t"] < F.col("_t")) if strict else (lambda c: c["_t"] <= F.col("_t"))
    placed = _cut(probes.select(*keys, as_micros(probes, probe_time).alias("_t"),
                                F.lit(0 if strict else 1).alias("_kind"),
                                F.struct(*probes.columns).alias("_probe")), keys, width, cuts, before)
    return placed.withColumn("_chunk", F.when(known, F.col("_chunk")).otherwise(cold))


def _probe_chunks(stacked: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stacked.where(F.col("_chunk") >= -(1 << 61)).select(*keys, "_chunk").distinct()


def _carry_last(ends: DataFrame, marks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For every marked chunk, ``value`` of the latest earlier chunk that has one."""
    w = Window.partitionBy(*keys).orderBy("_chunk", "_mark").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    both = marks.select(*keys, "_chunk", F.lit(0).alias("_mark")).unionByName(
        ends.select(*keys, "_chunk", F.lit(1).alias("_mark"), value), allowMissingColumns=True)
    return (both.withColumn("_carry", F.last(value, ignorenulls=True).over(w))
            .where("_mark = 0 AND _carry IS NOT NULL").select(*keys, "_chunk", "_carry"))


def _carry_rows(f: DataFrame, marks: DataFrame, keys: Sequence[str], ties: Sequence[str], measures: Sequence[str],
                window: int) -> DataFrame:
    """For every marked chunk, the last ``window`` facts of all earlier chunks."""
    newest = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_t"), *[F.desc(t) for t in ties])
    tails = f.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= window)
    back = Window.partitionBy(*keys).orderBy("_chunk", "_t", *ties).rowsBetween(-(window - 1), Window.currentRow)
    row = F.struct("_t", *ties, *measures)
    ends = tails.withColumn("_tail", F.collect_list(row).over(back)).where("_rn = 1").select(*keys, "_chunk", "_tail")
    return (_carry_last(ends, marks, keys, "_tail")
            .select(*keys, "_chunk", F.explode("_carry").alias("_r")).select(*keys, "_chunk", "_r.*"))


def _fill_forward(stack: DataFrame, probes: DataFrame, keys: Sequence[str],
                  order: Sequence[str], names: Sequence[str]) -> DataFrame:
    w = (Window.partitionBy(*keys, "_chunk").orderBy("_t", "_kind", *order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (stack.withColumn("_seen", F.last("_value", ignorenulls=True).over(w))
           .where(F.col("_probe").isNotNull()))
    return out.select("_probe.*", *[F.col(f"_seen.{n}").alias(n) for n in names])


def asof_last(facts: DataFrame, probes: DataFrame, keys: Sequence[str], *, fact_time: str,
              probe_time: str, order: Sequence[str], values: Sequence[str], strict: bool = True,
              chunk_days: float | None = CHUNK_DAYS, cuts: DataFrame | None = None) -> DataFrame:
    """Attach ``values`` of the latest visible fact per probe; NULLs where there is none.

    ``order`` breaks ties between facts at the same time (the greatest wins).
    """
    width = _width(chunk_days)
    facts = _dated(facts, keys, fact_time)
    f = (facts.select(*keys, as_micros(facts, fact_time).alias("_t"),
                      F.lit(1 if strict else 0).alias("_kind"),
                      *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      F.struct(*values).alias("_value")))
    ties = [f"_o{i}" for i in range(len(order))]
    f = _cut(f, keys, width, cuts, lambda c: c < F.struct("_t", *ties))
    p = _stack_probes(probes, keys, probe_time, strict, width, cuts)
    stack = f
    if width:
        ends = f.groupBy(*keys, "_chunk").agg(
            F.max_by("_value", F.struct("_t", *ties)).alias("_last"))
        carry = _carry_last(ends, _probe_chunks(p, keys), keys, "_last")
        stack = f.unionByName(carry.select(
            *keys, F.lit(AT_START).alias("_t"), F.lit(-1).alias("_kind"),
            F.col("_carry").alias("_value"), "_chunk"), allowMissingColumns=True)
    stack = stack.unionByName(p, allowMissingColumns=True)
    return _fill_forward(stack, probes, keys, ties, values)


def asof_rolling(facts: DataFrame, probes: DataFrame, keys: Sequence[str], *, fact_time: str,
                 probe_time: str, order: Sequence[str], window: int,
                 aggs: Mapping[str, Column], measures: Sequence[str], strict: bool = True,
                 chunk_days: float | None = CHUNK_DAYS, cuts: DataFrame | None = None) -> DataFrame:
    """Aggregate each entity's last ``window`` visible facts and attach them to its probes.

    ``aggs`` maps an output name to an aggregate over the fact columns in ``measures``.
    """
    width = _width(chunk_days)
    ties = [f"_o{i}" for i in range(len(order))]
    facts = _dated(facts, keys, fact_time)
    f = facts.select(*keys, as_micros(facts, fact_time).alias("_t"),
                     *[F.col(c).alias(t) for c, t in zip(order, ties)], *measures)
    f = _cut(f, keys, width, cuts, lambda c: c < F.struct("_t", *ties))
    p = _stack_probes(probes, keys, probe_time, strict, width, cuts)
    full = f
    if width:
        marks = f.select(*keys, "_chunk").unionByName(_probe_chunks(p, keys)).distinct()
        halo = _carry_rows(f, marks, keys, ties, measures, window)
        full = f.unionByName(halo)
    # One shuffle for everything: facts and probes are stacked and partitioned together, the
    # facts are rolled among themselves (``_fact`` separates them), then filled forward.
    stack = (full.withColumn("_fact", F.lit(1)).withColumn("_kind", F.lit(1 if strict else 0))
             .unionByName(p.withColumn("_fact", F.lit(0)), allowMissingColumns=True)
             .repartition(*keys, "_chunk"))
    recent = (Window.partitionBy(*keys, "_chunk", "_fact").orderBy("_t", *ties)
              .rowsBetween(-(window - 1), Window.currentRow))
    rolled = stack.select(
        *keys, "_chunk", "_t", "_kind", *ties, "_probe",
        F.when(F.col("_fact") == 1, F.struct(*[a.over(recent).alias(n) for n, a in aggs.items()]))
        .alias("_value"))
    return _fill_forward(rolled, probes, keys, ties, list(aggs))


def asof_cumulative(facts: DataFrame, probes: DataFrame, keys: Sequence[str], *, fact_time: str,
                    probe_time: str, sums: Mapping[str, Column] | None = None,
                    maxima: Mapping[str, Column] | None = None, strict: bool = True,
                    chunk_days: float | None = CHUNK_DAYS, cuts: DataFrame | None = None,
                    order: Sequence[str] = ()) -> DataFrame:
    """Attach running totals (0 without facts) and running maxima (NULL) of all visible facts.

    ``order`` matters only with ``cuts``: the columns by which these cut facts of one instant.

    A maximum may be a struct, which makes it "the greatest so far, with its attributes".
    """
    width = _width(chunk_days)
    exprs = {**(sums or {}), **(maxima or {})}
    how = {n: (F.sum if n in (sums or {}) else F.max) for n in exprs}
    facts = _dated(facts, keys, fact_time)
    f = (facts.select(*keys, as_micros(facts, fact_time).alias("_t"),
                      F.lit(1 if strict else 0).alias("_kind"),
                      *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[e.alias(n) for n, e in exprs.items()]))
    ties = [f"_o{i}" for i in range(len(order))]
    f = _cut(f, keys, width, cuts, lambda c: c < F.struct("_t", *ties)).drop(*ties)
    p = _stack_probes(probes, keys, probe_time, strict, width, cuts)
    stack = f
    if width:
        ends = f.groupBy(*keys, "_chunk").agg(*[how[n](n).alias(n) for n in exprs])
        w = (Window.partitionBy(*keys).orderBy("_chunk", "_kind")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        both = _probe_chunks(p, keys).withColumn("_kind", F.lit(0)).unionByName(
            ends.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
        carry = (both.select(*keys, "_chunk", "_kind", *[how[n](n).over(w).alias(n) for n in exprs])
                 .where("_kind = 0")
                 .select(*keys, F.lit(AT_START).alias("_t"),
                         F.lit(-1).alias("_kind"), *exprs, "_chunk"))
        stack = f.unionByName(carry)
    stack = stack.unionByName(p, allowMissingColumns=True)
    w = (Window.partitionBy(*keys, "_chunk").orderBy("_t", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = stack.select("_probe", *[how[n](n).over(w).alias(n) for n in exprs])
    return out.where(F.col("_probe").isNotNull()).select(
        "_probe.*", *[F.coalesce(n, F.lit(0)).alias(n) if n in (sums or {}) else F.col(n)
                      for n in exprs])


def running_positions(facts: DataFrame, keys: Sequence[str], *, time: str, order: Sequence[str],
                      name: str = "position", chunk_days: float | None = CHUNK_DAYS) -> DataFrame:
    """Number each entity's facts 1..n by ``(time, order)`` without one window per entity.

    Rows are numbered inside time chunks; a chunk's offset is a running sum over the small
    per-chunk counts.
    """
    width = _width(chunk_days)
    f = facts.withColumn("_t", as_micros(facts, time)).withColumn("_chunk", _chunk(width))
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("_t", *order))
    if not width:
        return f.withColumn(name, local.cast("bigint")).drop("_t", "_chunk")
    per = f.groupBy(*keys, "_chunk").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = per.select(*keys, "_chunk", (F.sum("_k").over(w) - F.col("_k")).alias("_off"))
    return (f.withColumn("_row", local).join(before, [*keys, "_chunk"])
            .withColumn(name, (F.col("_row") + F.col("_off")).cast("bigint"))
            .drop("_t", "_chunk", "_row", "_off"))


def asof_nearest(facts: DataFrame, probes: DataFrame, keys: Sequence[str], *, fact_time: str,
                 probe_time: str, order: Sequence[str], value: str, tolerance_us: int,
                 chunk_days: float | None = CHUNK_DAYS) -> DataFrame:
    """Attach the fact nearest in time within a tolerance (ties: the earlier fact).

    One backward and one forward as-of; each looks at one row, so no pairs are built.
    Adds ``value`` and ``distance_us`` (NULL beyond the tolerance).
    """
    f = facts.select(*keys, *order, F.col(value).alias("_v"),
                     as_micros(facts, fact_time).alias("_ft"))
    f = f.withColumn("_neg", -F.col("_ft"))
    q = probes.withColumn("_pt", as_micros(probes, probe_time)).withColumn("_npt", -F.col("_pt"))
    back = asof_last(f.withColumn("_bv", F.struct("_ft", "_v")), q, keys, fact_time="_ft",
                     probe_time="_pt", order=order, values=["_bv"], strict=False,
                     chunk_days=chunk_days)
    both = asof_last(f.withColumn("_fv", F.struct("_ft", "_v")), back, keys, fact_time="_neg",
                     probe_time="_npt", order=order, values=["_fv"], strict=False,
                     chunk_days=chunk_days)
    gap_back = F.col("_pt") - F.col("_bv._ft")
    gap_next = F.col("_fv._ft") - F.col("_pt")
    use_back = gap_back.isNotNull() & (gap_next.isNull() | (gap_back <= gap_next))
    gap = F.when(use_back, gap_back).otherwise(gap_next)
    near = gap <= F.lit(tolerance_us)
    return both.select(
        *probes.columns,
        F.when(near, F.when(use_back, F.col("_bv._v")).otherwise(F.col("_fv._v"))).alias(value),
        F.when(near, gap).alias("distance_us"))


def window_join(facts: DataFrame, probes: DataFrame, keys: Sequence[str], *, fact_time: str,
                low_us: Column, high_us: Column, span_us: int) -> DataFrame:
    """Pair probes with the facts inside a bounded interval ``[low, high]`` (micros).

    The bound makes it an equi-join: time is cut into ``span_us`` buckets and each probe
    looks up the one or two buckets its interval touches. Bucketing also spreads a busy key
    over time. ``high - low`` must not exceed ``span_us``. Fact columns keep their names.
    """
    f = (facts.withColumn("_ft", as_micros(facts, fact_time))
         .withColumn("_b", F.floor(F.col("_ft") / F.lit(span_us))))
    p = (probes.withColumn("_lo", low_us).withColumn("_hi", high_us)
         .withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / F.lit(span_us)),
                                                F.floor(F.col("_hi") / F.lit(span_us))))))
    joined = p.join(f, [*keys, "_b"]).where("_ft BETWEEN _lo AND _hi")
    return joined.drop("_b", "_ft", "_lo", "_hi")
