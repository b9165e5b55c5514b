"""Bars with a fixed threshold as window expressions.

With running metric ``S_i`` and threshold ``T``, ``F_i = floor(S_i / T)`` bars
could have closed after tick i; at most one closes per tick, so the number that
has is ``k_i = i + min(0, min_{j<=i}(F_j - j))``. A tick lies in bar ``k_{i-1}``.
Time bars have the same shape with ``F_i = max(0, floor((ts_i - b) / I) + 1)``
for the first boundary b. Catalyst runs this as one sort by key and order.

For a stream too long for one task, ``chunked`` composes chunks instead: ticks
of a chunk map ``k`` to ``min(k + a, b)``, and such maps are closed under
composition, so a first pass gives each chunk's map, a scan over chunks gives
each chunk's start, and a second pass runs within chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barspark.model import BarSpec, Static


def fits(spec: BarSpec, ordered: bool = True) -> bool:
    """Whether this spec's bars have the closed form.

    That of time bars holds only where timestamps do not fall (``ordered``).
    """
    if spec.family == "time":
        return ordered
    return spec.family in ("standard", "run") and isinstance(spec.threshold, Static)


def chunks_fit(spec: BarSpec) -> bool:
    return fits(spec, False) and spec.threshold.threshold > 0


def metric(spec: BarSpec) -> Column:
    return {"tick": F.lit(1.0), "volume": F.col("volume"), "dollar": F.col("dollar")}[spec.metric]


def assign(ticks: DataFrame, spec: BarSpec, window) -> DataFrame:
    """``ticks`` (with ``__seq``) and each tick's ``bar_id`` and ``__closed`` (bars closed after it)."""
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    if spec.family == "time":
        first = F.first("timestamp").over(upto)
        step = F.lit(spec.interval_ms)
        start = first + step if spec.anchor == "first_tick" else first - F.pmod(first, step) + step
        could = F.greatest(F.lit(0), F.floor((F.col("timestamp") - start) / step) + 1)
    elif spec.threshold.threshold == 0:
        could = F.col("__seq")
    elif spec.metric == "tick" and spec.family == "standard":
        could = F.floor(F.col("__seq") / F.lit(float(spec.threshold.threshold)))
    else:
        could = F.floor(F.sum("__metric").over(upto) / F.lit(float(spec.threshold.threshold)))
    out = ticks.withColumn("__metric", metric(spec)).withColumn("__slack", could.cast("long") - F.col("__seq"))
    least = lambda frame: F.least(F.lit(0), F.min("__slack").over(frame))
    # both frames in one window operator; a tick's bar is what closed before it
    out = out.withColumns({"__closed": F.col("__seq") + least(upto), "bar_id": F.col("__seq") - 1 + least(window.rowsBetween(W.unboundedPreceding, -1))})
    return out.drop("__metric", "__slack")


def chunked(ticks: DataFrame, spec: BarSpec, order: Sequence[str], chunks: int, mark: str | None = None) -> DataFrame:
    """Like ``assign`` for one unkeyed stream, in range-partitioned chunks.

    ``ticks`` needs the order columns; metrics should sum exactly (integers),
    since sums are taken chunk by chunk. Three passes (with ``mark``, the
    watermark that must rise, four), each a scan over chunks between windows
    within them; no window sees all rows. The chunks are written, so that a lost
    executor's tasks run on the same ones.
    """
    from barspark.operators.bars import written

    t = F.lit(float(spec.threshold.threshold))
    own = ticks.withColumn("__metric", metric(spec)).repartitionByRange(chunks, *order).withColumn("__chunk", F.spark_partition_id())
    own = written(own.withColumn("__place", F.struct(*order)))
    w = W.partitionBy("__chunk").orderBy("__place")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), W.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)

    def carried(rows: DataFrame, sums: dict) -> DataFrame:
        """What the chunks before sum to, at every row of a chunk; a row per chunk is broadcast."""
        each = rows.groupBy("__chunk").agg(*(one.alias(c) for c, (one, _, _) in sums.items()))
        starts = each.select("__chunk", *(F.coalesce(over(F.col(c)).over(before), none).alias(c) for c, (_, over, none) in sums.items()))
        return rows.join(F.broadcast(starts), "__chunk")

    if mark:
        own = carried(own, {"__top": (F.max(mark), F.max, F.lit(None))})
        seen = F.greatest("__top", F.max(mark).over(w.rowsBetween(W.unboundedPreceding, -1)))
        own = own.withColumn("__seen", seen).where(F.col("__seen").isNull() | (F.col(mark) > F.col("__seen"))).drop("__seen", "__top")
    own = own.withColumns({"__i": F.row_number().over(w).cast("long"), "__sum": F.sum("__metric").over(upto)})
    own = carried(own, {"__n0": (F.max("__i"), F.sum, F.lit(0)), "__s0": (F.sum("__metric"), F.sum, F.lit(0.0))})
    own = own.withColumn("__seq", F.col("__n0") + F.col("__i"))
    own = own.withColumn("__slack", F.floor((F.col("__s0") + F.col("__sum")) / t).cast("long") - F.col("__seq"))
    own = carried(own, {"__m0": (F.min("__slack"), F.min, F.lit(0))})
    least = lambda frame: F.least(F.lit(0), F.col("__m0"), F.min("__slack").over(frame))
    own = own.withColumns({"__closed": F.col("__seq") + least(upto), "bar_id": F.col("__seq") - 1 + least(w.rowsBetween(W.unboundedPreceding, -1))})
    return own.drop("__chunk", "__place", "__i", "__sum", "__n0", "__s0", "__m0", "__slack", "__metric")
