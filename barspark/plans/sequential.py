"""Bars by the sequential rule, over partitions sorted by key and order.

One exchange by key and one external sort; then each partition is a single pass
over Arrow batches that hands each key's run of rows to its ``Fold`` and sums
the bars with numpy. What is held at a time is one batch and the open bar of one
key, however long a key is. Signs, resumption, ordering and the watermark are
part of the same pass, so it needs no window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from barspark.functions.fold import make_fold
from barspark.model import BarSpec, TickDataError

_LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Pass:
    """What a pass over ordered ticks does before the rule."""

    spec: BarSpec
    keys: tuple[str, ...]
    derive: str | None  # the price whose changes give the sign; None: the column side does
    mark: str | None  # the watermark; None: every row counts
    above: int | None
    strict: bool
    minutes: bool


class _Key:
    """One key's way through the rule."""

    def __init__(self, way: Pass):
        self.way, self.fold = way, make_fold(way.spec)
        self.price = self.sign = np.nan
        self.top, self.last_ts = _LOWEST if way.above is None else way.above, _LOWEST
        self.open: dict | None = None

    def accepted(self, c: dict[str, np.ndarray]) -> np.ndarray:
        """Places of the rows that count, after signs and checks."""
        way, n = self.way, len(c["timestamp"])
        if way.derive:
            price = c[way.derive]
            change = np.sign(np.diff(price, prepend=self.price))
            known = np.where((change != 0) & ~np.isnan(change), np.arange(n), -1)
            at = np.maximum.accumulate(known)
            c["side"] = np.where(at >= 0, change[at], self.sign)
            self.price, self.sign = price[-1], c["side"][-1]
        keep = np.arange(n)
        if way.mark:
            mark = c[way.mark]
            if way.above is not None:
                keep = np.flatnonzero(mark > way.above)
            if way.strict:
                self._check_order(c["timestamp"][keep])
            own = mark[keep]
            before = np.maximum.accumulate(np.concatenate([[self.top], own]))
            keep, self.top = keep[own > before[:-1]], int(before[-1])
        elif way.strict:
            self._check_order(c["timestamp"])
        return keep

    def _check_order(self, ts: np.ndarray) -> None:
        late = np.flatnonzero(np.diff(ts, prepend=self.last_ts) < 0) if self.last_ts != _LOWEST else np.flatnonzero(np.diff(ts) < 0) + 1
        if len(late):
            raise TickDataError(f"timestamps out of order: {ts[late[0]]} after {ts[late[0] - 1] if late[0] else self.last_ts}")
        if len(ts):
            self.last_ts = int(ts[-1])

    def feed(self, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float]]]:
        """Places of the rows that count, their bars, and the closes by ticks."""
        keep = self.accepted(c)
        price, volume = c["close" if self.way.minutes else "price"][keep], c["volume"][keep]
        metric = {"tick": lambda: np.ones(len(keep)), "volume": lambda: volume, "dollar": lambda: price * volume}[self.way.spec.metric]()
        sides = [None if s != s else s for s in c["side"][keep].tolist()] if "side" in c else [None] * len(keep)
        out = c["out"][keep].tolist() if "out" in c else None
        bars, closes = self.fold.steps(c["timestamp"][keep].tolist(), metric.tolist(), sides, out, price.tolist(), volume.tolist())
        return keep, np.array(bars, np.int64), closes

    def summed(self, c: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        """The bars that these rows complete, by column."""
        keep, bars, closes = self.feed(c)
        if not len(bars):
            return None
        starts = np.flatnonzero(np.diff(bars, prepend=bars[0] - 1))
        ends = np.append(starts[1:], len(bars))
        names = ("open", "high", "low", "close") if self.way.minutes else ("price",) * 4
        first, high, low, last = (c[x][keep] for x in names)
        ts, volume = c["timestamp"][keep], c["volume"][keep]
        o = self.open
        goes_on = o is not None and o["bar_id"] == bars[0]
        at = bars - bars[0]
        # sums are taken tick by tick, so that they do not depend on where batches end
        sums = lambda x, c: np.bincount(np.append(0, at), np.append(o[c] if goes_on else 0.0, x))
        made = {
            "bar_id": bars[starts], "open": first[starts], "high": np.maximum.reduceat(high, starts), "low": np.minimum.reduceat(low, starts),
            "close": last[ends - 1], "volume": sums(volume, "volume"), "dollar_value": sums(last * volume, "dollar_value"),
            "num_ticks": ends - starts, "open_ts": ts[starts], "close_ts": ts[ends - 1], "threshold_after": np.full(len(starts), np.nan),
        }
        for i, limit in closes:
            made["threshold_after"][bars[i] - bars[0]] = limit
        if goes_on:
            made["open"][0], made["open_ts"][0] = o["open"], o["open_ts"]
            made["high"][0], made["low"][0] = max(o["high"], made["high"][0]), min(o["low"], made["low"][0])
            made["num_ticks"][0] += o["num_ticks"]
        elif o is not None:  # a session's edge closed it
            made = {x: np.concatenate([[o[x]], v]) for x, v in made.items()}
        self.open = None
        if made["bar_id"][-1] == self.fold.bar:
            self.open = {x: v[-1] for x, v in made.items()}
            made = {x: v[:-1] for x, v in made.items()}
        return made


def _numpy(name: str, column: pa.Array) -> np.ndarray:
    if name in ("timestamp", "mark"):
        column = pc.fill_null(column, _LOWEST)
    elif name == "out":
        column = pc.fill_null(column, False)
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(float) if name == "side" else out


def _walk(way: Pass, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Key, list[pa.Array], dict[str, np.ndarray] | None]]:
    """Each run of a key's rows: its way, the key's values, the rows by column; None once the key ends."""
    own, values = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: _numpy(c, batch.column(c)) for c in batch.schema.names if c not in way.keys}
        edge = np.zeros(batch.num_rows, bool)
        edge[0] = True
        for k in way.keys:
            codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            edge[1:] |= codes[1:] != codes[:-1]
        runs = [*np.flatnonzero(edge).tolist(), batch.num_rows]
        for a, b in zip(runs, runs[1:], strict=False):
            here = [batch.column(k).slice(a, 1) for k in way.keys]
            if own is None or not all(x.equals(y) for x, y in zip(here, values, strict=True)):
                if own is not None:
                    yield own, values, None
                own, values = _Key(way), here
            yield own, values, {c: x[a:b] for c, x in cols.items()}
    if own is not None:
        yield own, values, None


_BAR = (
    ("bar_id", LongType), ("open", DoubleType), ("high", DoubleType), ("low", DoubleType), ("close", DoubleType), ("volume", DoubleType),
    ("dollar_value", DoubleType), ("num_ticks", LongType), ("open_ts", LongType), ("close_ts", LongType), ("threshold_after", DoubleType),
)
_ARROW = {LongType: pa.int64(), DoubleType: pa.float64()}
FLUSH = 8192


def _gathered(values: list[list[pa.Array]], sizes: list[int]) -> list[pa.Array]:
    """Key columns: each run's values as often as it has rows."""
    at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    return [pa.concat_arrays(list(column)).take(at) for column in zip(*values, strict=True)]


def bars(rows: DataFrame, way: Pass) -> DataFrame:
    """Keys, the sums of each bar, ``threshold_after`` (closes by ticks) and ``is_partial`` of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        values: list[list[pa.Array]] = []
        sizes: list[int] = []
        partial: list[bool] = []
        n = 0

        def flush() -> pa.RecordBatch:
            cols = [*_gathered(values, sizes)]
            cols += [pa.array(np.concatenate([h[c] for h in held]), _ARROW[k], from_pandas=True) for c, k in _BAR]
            cols.append(pa.array(np.repeat(partial, sizes)))
            for x in (held, values, sizes, partial):
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*way.keys, *(c for c, _ in _BAR), "is_partial"])

        for own, key, cols in _walk(way, batches):
            made = own.summed(cols) if cols is not None else {c: [v] for c, v in own.open.items()} if own.open else None
            if made is None or not len(made["bar_id"]):
                continue
            held.append(made)
            values.append(key)
            sizes.append(len(made["bar_id"]))
            partial.append(cols is None)
            n += sizes[-1]
            if n >= FLUSH:
                yield flush()
                n = 0
        if held:
            yield flush()

    keys = [rows.schema[k] for k in way.keys]
    return rows.mapInArrow(run, StructType([*keys, *(StructField(c, k()) for c, k in _BAR), StructField("is_partial", BooleanType())]))


def assigned(rows: DataFrame, way: Pass) -> DataFrame:
    """Keys, ``__seq``, the tick's columns, ``bar_id``, ``__closed`` and ``__limit`` of sorted rows that count."""
    names = [c for c in rows.columns if c not in (*way.keys, "out", "mark")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq: dict[int, int] = {}
        for own, key, cols in _walk(way, batches):
            if cols is None:
                seq.clear()
                continue
            keep, ids, closes = own.feed(cols)
            first = seq.get(id(own), 0)
            seq[id(own)] = first + len(keep)
            limit = np.full(len(keep), np.nan)
            ended = ids.copy()
            for i, new in closes:
                limit[i], ended[i] = new, ids[i] + 1
            out = [*_gathered([key], [len(keep)]), pa.array(np.arange(first + 1, first + len(keep) + 1))]
            out += [pa.array(cols[c][keep], from_pandas=True) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ids), pa.array(ended), pa.array(limit, from_pandas=True)], names=[*way.keys, "__seq", *names, "bar_id", "__closed", "__limit"])

    more = [StructField("bar_id", LongType()), StructField("__closed", LongType()), StructField("__limit", DoubleType())]
    kinds = [StructField("side", DoubleType()) if c == "side" else rows.schema[c] for c in names]
    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in way.keys), StructField("__seq", LongType()), *kinds, *more]))
