"""Bars of streaming ticks, with the same rule and state as batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from barspark.functions.calendars import Exchange
from barspark.functions.fold import BarBuilder
from barspark.model import BAR_COLUMNS, BarSpec

FLUSH = 8192
FED = ("timestamp", "price", "volume", "side", "watermark", "__out")


def _feed(builder: BarBuilder, rows: dict[str, list]) -> Iterator[dict]:
    """The bars that these ticks, lists by column, complete."""
    ts = rows["timestamp"]
    side, mark, shut = rows.get("side", [None] * len(ts)), rows.get("watermark", ts), rows.get("__out", [False] * len(ts))
    for t, p, v, s, w, o in zip(ts, rows["price"], rows["volume"], side, mark, shut, strict=True):
        yield from builder.update(int(t), float(p), float(v), None if s is None or s != s else float(s), int(w), bool(o))


def _with_sessions(ticks: DataFrame, calendar) -> DataFrame:
    """The ticks with the flag ``__out`` where the calendar has sessions."""
    if calendar is None or not calendar.has_sessions:
        return ticks
    if isinstance(calendar, Exchange):
        return calendar.mark(ticks, "timestamp", "__out")
    return ticks.withColumn("__out", calendar.is_boundary(F.col("timestamp")))


def _order(ticks: DataFrame, order: Sequence[str] | None, strict_ordering: bool) -> list[str]:
    """The columns that rows of one call are sorted by."""
    if strict_ordering and (not order or order[0] == "timestamp"):
        raise ValueError("strict ordering needs an order that is not the timestamp's own")
    return list(order or [c for c in ("timestamp", "watermark") if c in ticks.columns])


def _bar_schema(key: Sequence[str], ticks: DataFrame, *more: str) -> StructType:
    first = [ticks.schema[k] for k in key] + [StructField(n, StringType()) for n in more]
    kinds = {"bar_type": StringType} | dict.fromkeys(("bar_id", "num_ticks", "open_ts", "close_ts"), LongType)
    return StructType([*first, *(StructField(c, kinds.get(c, DoubleType)()) for c in BAR_COLUMNS)])


def stream_bars(
    ticks: DataFrame, spec: BarSpec, *, key: Sequence[str], order: Sequence[str] | None = None, watermark_key: str | None = "timestamp",
    strict_ordering: bool = False, parity_drop: bool = False, calendar=None,
) -> DataFrame:
    """Completed bars of a streaming table ``key..., timestamp, price, volume[, side, watermark]``.

    The state of a key (the open bar and the rule's numbers, as JSON) lives in
    the state store, so a restart from the checkpoint goes on where it was; rows
    of a micro-batch are put in ``order`` (default: timestamp, watermark) before
    they are fed, and rows at or below the last watermark are dropped. A value
    that is not allowed fails the query. ``strict_ordering`` fails at an accepted
    row whose timestamp is below the one before, and needs an ``order`` of
    arrival; a ``calendar`` with sessions closes bars where they begin and end.
    """
    ticks, sort = _with_sessions(ticks, calendar), _order(ticks, order, strict_ordering)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            builder = BarBuilder.from_state(spec, state.get[0], watermark_key=watermark_key)
        else:
            builder = BarBuilder(spec, watermark_key=watermark_key, strict_ordering=strict_ordering, parity_drop=parity_drop)
        rows = pd.concat(list(frames)).sort_values(sort, kind="stable")
        bars = list(_feed(builder, {c: rows[c].tolist() for c in FED if c in rows}))
        state.update((builder.get_state(),))
        if bars:
            own = dict(zip(key, keys, strict=True))
            yield pd.DataFrame([own | b for b in bars], columns=[*key, *BAR_COLUMNS])

    return ticks.groupBy(*key).applyInPandasWithState(run, _bar_schema(key, ticks), "state string", "append", GroupStateTimeout.NoTimeout)


def on_bars(bars: DataFrame, on_bar: Callable[[dict], None], checkpoint: str) -> DataStreamWriter:
    """A sink that calls ``on_bar`` on the driver with each completed bar of a stream, batch by batch in key and bar order."""
    key = [c for c in bars.columns if c not in BAR_COLUMNS]

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy(*key, "bar_id").toLocalIterator():
            on_bar(row.asDict())

    return bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def resumable_bars(
    ticks: DataFrame, spec: BarSpec, states: DataFrame | None = None, *, key: str, order: Sequence[str] | None = None, watermark_key: str | None = "timestamp",
    strict_ordering: bool = False, parity_drop: bool = False, calendar=None,
) -> DataFrame:
    """Batch with state in and out: rows ``key, state, bar columns``.

    Each key gives its completed bars (``state`` null) and one row with the
    state to resume from; ``states`` holds ``key, state`` of an earlier run, one row a key. The options are those of ``stream_bars``.
    One exchange by key and one external sort, then one pass over Arrow batches: it holds a batch, some
    thousand bars and one key's open bar, however long a key is and however many there are.
    """
    ticks, sort = _with_sessions(ticks, calendar), _order(ticks, order, strict_ordering)
    if states is None:
        states = ticks.sparkSession.createDataFrame([], StructType([ticks.schema[key], StructField("state", StringType())]))
    schema = _bar_schema([key], ticks, "state")
    arrow = to_arrow_schema(schema)

    def begun(state: str | None) -> BarBuilder:
        if state is not None:
            return BarBuilder.from_state(spec, state, watermark_key=watermark_key)
        return BarBuilder(spec, watermark_key=watermark_key, strict_ordering=strict_ordering, parity_drop=parity_drop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        builder, own = None, None
        for batch in batches:
            keys = batch.column(key)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            saved = batch.column("state")
            rows = {c: batch.column(c).to_pylist() for c in FED if c in batch.schema.names}
            for a, b in zip(edges, edges[1:], strict=False):
                if builder is None or not keys.slice(a, 1).equals(own):
                    if builder is not None:
                        out.append({key: own[0].as_py(), "state": builder.get_state()})
                    own, builder = keys.slice(a, 1), begun(saved[a].as_py())
                first, value = a + saved[a].is_valid, own[0].as_py()
                for bar in _feed(builder, {c: x[first:b] for c, x in rows.items()}):
                    out.append({key: value} | bar)
                    if len(out) >= FLUSH:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
        if builder is not None:
            out.append({key: own[0].as_py(), "state": builder.get_state()})
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    used = [c for c in dict.fromkeys((*FED, *sort)) if c in ticks.columns and c != key]
    saved = states.where("state is not null").select(F.col(key).cast(ticks.schema[key].dataType).alias(key), "state")
    both = ticks.select(key, *used, F.lit(None).cast("string").alias("state")).unionByName(saved, allowMissingColumns=True)
    place = [key, F.col("state").isNull(), *(F.col(c).asc_nulls_last() for c in sort if c != key)]  # a key's state, then its ticks
    return both.repartition(F.col(key)).sortWithinPartitions(*place).mapInArrow(run, schema)
