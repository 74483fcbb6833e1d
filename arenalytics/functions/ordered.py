"""Order-dependent calculations that stay distributed when one key is hot.

A plain ``Window.partitionBy(server)`` sends the whole history of a server to one task. These helpers
cut each key into time chunks, run the window inside ``(key, chunk)``, and carry the last state of a
chunk into the next through a summary with one row per chunk. Inputs are collapsed to one row per
``(key, ts)`` first, so a chunk never holds more rows than it has milliseconds.

Where only totals over the steps of a key are asked for, :func:`step_totals` needs no carry on the rows: a chunk becomes one
summary (first state, last state, totals of its inner steps), summaries are put in order, and the steps between them are
added. Rows are shuffled once, whatever the number of measures. :func:`interval_sums` cuts intervals at chunk edges
instead, so that a piece is settled where its chunk is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.clock import HOUR, bucket

CHUNK = "_chunk"


def _chunked(df: DataFrame, ts: str, width: int) -> DataFrame:
    return df.withColumn(CHUNK, bucket(ts, width))


def _step(df, keys, ts, cols, width, into, ties, ahead: bool) -> DataFrame:
    """Neighbouring row of each row: by a window inside the chunk, and across chunks from the chunk's edge rows.

    The edge row of a chunk is found in the same window pass over the same shuffle. Spark reuses that shuffle where it can; without
    adaptive reuse the input is read twice.
    """
    rows = _chunked(df, ts, width)
    state = F.struct(ts, *ties, *cols)
    order = [F.col(c).desc() if ahead else F.col(c).asc() for c in (ts, *ties)]
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    chunk = F.col(CHUNK).desc() if ahead else F.col(CHUNK).asc()
    across = Window.partitionBy(*keys).orderBy(chunk)
    walked = rows.withColumn("_inner", F.lag(state).over(inside)).withColumn("_more", F.lead(F.lit(True), 1, False).over(inside))
    carry = walked.where(~F.col("_more")).select(*keys, CHUNK, F.lag(state).over(across).alias("_carry"))
    return _with_carry(walked.drop("_more"), carry, keys, into)


def with_previous(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str] = (), width: int = HOUR, into: str = "prev", ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``prev`` = struct(ts, ties, cols) of the preceding row of the key, null on the first.

    ``ties`` orders rows of one instant; without it ``df`` holds one row per (keys, ts).
    """
    return _step(df, keys, ts, cols, width, into, ties, ahead=False)


def with_next(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str] = (), width: int = HOUR, into: str = "next", ties: Sequence[str] = ()
) -> DataFrame:
    """Mirror image of :func:`with_previous`."""
    return _step(df, keys, ts, cols, width, into, ties, ahead=True)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str], into: str) -> DataFrame:
    # Rows without a key are a key of their own.
    named = carry.select(*[F.col(k).alias(f"_of_{k}") for k in (*keys, CHUNK)], "_carry")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, CHUNK)])
    joined = rows.join(named, same).withColumn(into, F.coalesce("_inner", "_carry"))
    return joined.drop("_inner", "_carry", CHUNK, *[f"_of_{k}" for k in (*keys, CHUNK)])


def gaps(df: DataFrame, keys: Sequence[str], ts: str, width: int = HOUR) -> DataFrame:
    """One row ``(keys, prev_ts, ts, gap)`` per pair of neighbouring distinct instants.

    Gaps within a chunk and gaps between chunks are produced apart and united, so nothing is joined back.
    """
    instants = _chunked(df.select(*keys, ts).distinct(), ts, width)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(ts)
    inner = instants.select(*keys, F.lag(ts).over(inside).alias("prev_ts"), F.col(ts).alias("ts"))
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    edges = _chunked(df.select(*keys, ts), ts, width).groupBy(*keys, CHUNK).agg(F.min(ts).alias("ts"), F.max(ts).alias("_last"))
    between = edges.select(*keys, F.lag("_last").over(across).alias("prev_ts"), "ts")
    return (
        inner.unionByName(between).where(F.col("prev_ts").isNotNull()).withColumn("gap", F.col("ts") - F.col("prev_ts"))
    )


Measure = Callable[[Column, Column], Column]
"""A value of a step, made from the structs (ts, state) of two neighbouring instants; the first is null at a key's start."""


def step_totals(
    df: DataFrame, keys: Sequence[str], ts: str, sums: Mapping[str, Measure], maxima: Mapping[str, Measure] | None = None,
    state: Mapping[str, Column] | None = None, width: int = HOUR, among: Mapping[str, tuple[Callable[[Column], Column], Measure]] | None = None,
) -> DataFrame:
    """Per key: sums and maxima over all steps from one distinct instant to the next, ``steps`` (their number), ``last`` and ``final``.

    ``state`` reduces the rows of one instant to the columns that measures read, with ``ts``, from their two structs. A key's
    first instant is a step from nothing, which measures see as null; it isn't counted in ``steps``. Null measures add
    nothing. ``among`` sums over the steps between the instants that meet a condition on their struct, those between
    them left out. ``final`` is the struct of the last instant. Without keys there is one row; without rows it holds zeros and nulls.
    """
    state, maxima, among = dict(state or {}), dict(maxima or {}), dict(among or {})
    rows = _chunked(df, ts, width)
    columns = sorted({ts, *keys, CHUNK} | set(df.columns)) if state else [*keys, CHUNK, ts]
    dealt = rows.select(*columns).repartition(*keys, CHUNK)
    instants = dealt.groupBy(*keys, CHUNK, ts).agg(*[c.alias(n) for n, c in state.items()]) if state else dealt.distinct()
    inside = Window.partitionBy(*keys, CHUNK).orderBy(ts)
    here = F.struct(ts, *state)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    walked = instants.select(*keys, CHUNK, ts, here.alias("_here"), F.lag(here).over(inside).alias("_prev"))
    others = {n: F.last(F.when(c(F.col("_here")), F.col("_here")), ignorenulls=True).over(earlier) for n, (c, _) in among.items()}
    walked = walked.select("*", *[c.alias(f"_prev_{n}") for n, c in others.items()])
    prev, cur = F.col("_prev"), F.col("_here")
    inner = {n: F.sum(F.when(prev.isNotNull(), m(prev, cur))) for n, m in sums.items()}
    inner |= {n: F.max(F.when(prev.isNotNull(), m(prev, cur))) for n, m in maxima.items()}
    marks = []
    for n, (c, m) in among.items():
        own = F.col(f"_prev_{n}")
        inner[n] = F.sum(F.when(c(cur) & own.isNotNull(), m(own, cur)))
        marks += [F.min(F.when(c(cur), cur)).alias(f"_first_{n}"), F.max(F.when(c(cur), cur)).alias(f"_last_{n}")]
    summaries = walked.groupBy(*keys, CHUNK).agg(
        F.min("_here").alias("_first"), F.max("_here").alias("_last"), (F.count("*") - 1).alias("_inner_steps"), *[c.alias(n) for n, c in inner.items()], *marks
    )
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    upto = chunks.rowsBetween(Window.unboundedPreceding, -1)
    joined = summaries.select("*", F.lag("_last").over(chunks).alias("_before"), *[F.last(f"_last_{n}", ignorenulls=True).over(upto).alias(f"_before_{n}") for n in among])
    before, first = F.col("_before"), F.col("_first")
    totals = [F.sum(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(m(before, first), F.lit(0))).alias(n) for n, m in sums.items()]
    totals += [F.max(F.greatest(F.col(n), m(before, first))).alias(n) for n, m in maxima.items()]
    totals += [F.sum(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(m(F.col(f"_before_{n}"), F.col(f"_first_{n}")), F.lit(0))).alias(n) for n, (_, m) in among.items()]
    steps = F.sum(F.col("_inner_steps") + F.when(before.isNotNull(), 1).otherwise(0))
    return joined.groupBy(*keys).agg(*totals, F.coalesce(steps, F.lit(0)).alias("steps"), F.max("_last")[ts].alias("last"), F.max("_last").alias("final"))


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, totals: dict[str, str | Column], width: int, reverse: bool = False
) -> DataFrame:
    """Cumulative sums along ``order``; ``totals`` maps the new column to the summed expression.

    ``df`` may hold several rows per (keys, order): they are summed first.
    """
    per_point = _chunked(
        df.groupBy(*keys, order).agg(*[F.sum(e).alias(n) for n, e in totals.items()]), order, width
    )
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, CHUNK).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(direction(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_point.groupBy(*keys, CHUNK)
        .agg(*[F.sum(n).alias(f"_t_{n}") for n in totals])
        .select(*keys, CHUNK, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals])
    )
    return per_point.join(offsets, [*keys, CHUNK]).select(
        *keys, order, *[(F.sum(n).over(inside) + F.col(f"_o_{n}")).alias(n) for n in totals]
    )


def last_known(
    states: DataFrame, instants: DataFrame, keys: Sequence[str], ts: str, value: str, width: int = HOUR
) -> DataFrame:
    """As-of lookup: for every distinct ``(keys, ts)`` of ``instants`` the value of the newest state with
    ``state.ts <= ts``, plus its time ``state_ts``; both null before the first state.

    ``states`` holds one row per (keys, ts).
    """
    known = states.select(*keys, ts, F.lit(0).alias("_ask"), F.col(ts).alias("_t"), F.col(value).alias("_v"))
    asked = instants.select(*keys, ts).distinct().withColumn("_ask", F.lit(1))
    rows = _chunked(known.unionByName(asked, allowMissingColumns=True), ts, width)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(ts, "_ask").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(F.col("_t").isNotNull(), F.struct("_t", "_v"))
    carry = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.max("_t").alias("_t"), F.max_by("_v", "_t").alias("_v"))
        .select(*keys, CHUNK, F.last(found, ignorenulls=True).over(before).alias("_carry"))
    )
    return (
        rows.withColumn("_inner", F.last(found, ignorenulls=True).over(inside))
        .where(F.col("_ask") == 1)
        .join(carry, [*keys, CHUNK])
        .withColumn("_found", F.coalesce("_inner", "_carry"))
        .select(*keys, ts, F.col("_found._t").alias("state_ts"), F.col("_found._v").alias(value))
    )


def interval_sums(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, totals: dict[str, str | Column],
    interval_id: str, start: str, end: str, width: int = HOUR,
) -> DataFrame:
    """Sums of the points with ``start <= ts < end`` for every interval of the same keys.

    One sweep: intervals are cut at chunk edges, points and the signed ends of the pieces are one stream, and a piece is
    the running total at its end less that at its start. Work is linear in points and pieces however many intervals overlap:
    no point is paired with an interval, and a chunk needs nothing from another.
    """
    cut = intervals.select(interval_id, *keys, F.col(start).alias("_from"), F.greatest(F.col(end) - 1, F.col(start)).alias("_last"), F.col(end).alias("_to"))
    chunks = F.sequence(bucket("_from", width), bucket("_last", width), F.lit(width).cast("bigint"))
    pieces = cut.select("*", F.explode(chunks).alias(CHUNK))
    low = F.greatest(F.col("_from"), F.col(CHUNK))
    high = F.greatest(F.least(F.col("_to"), F.col(CHUNK) + width), low)
    ends = F.explode(F.array(F.struct(high.alias("at"), F.lit(1).alias("sign")), F.struct(low.alias("at"), F.lit(-1).alias("sign"))))
    ends = pieces.select(interval_id, *keys, CHUNK, ends.alias("_e")).select(interval_id, *keys, CHUNK, F.col("_e.at").alias("_at"), F.col("_e.sign").alias("_sign"))
    measured = _chunked(points, ts, width).select(*keys, CHUNK, F.col(ts).alias("_at"), *[F.col(e).alias(n) if isinstance(e, str) else e.alias(n) for n, e in totals.items()])
    upto = Window.partitionBy(*keys, CHUNK).orderBy("_at", F.col("_sign").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = measured.unionByName(ends, allowMissingColumns=True).select("*", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"_upto_{n}") for n in totals])
    return (
        swept.where(F.col("_sign").isNotNull())
        .groupBy(interval_id)
        .agg(*[F.sum(F.col("_sign") * F.col(f"_upto_{n}")).alias(n) for n in totals])
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, width: int = HOUR, ties: Sequence[str] = (), into: str = "current"
) -> DataFrame:
    """Add ``into``: the last non-null ``value`` of the key at or before each row."""
    rows = _chunked(df, ts, width)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(ts, *ties)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    walked = rows.withColumn("_inner", F.last(value, ignorenulls=True).over(upto)).withColumn("_more", F.lead(F.lit(True), 1, False).over(inside))
    carry = walked.where(~F.col("_more")).select(*keys, CHUNK, F.last("_inner", ignorenulls=True).over(before).alias("_carry"))
    return _with_carry(walked.drop("_more"), carry, keys, into)
