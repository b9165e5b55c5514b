"""The sequential rule of all bar families.

Batch (keys in sorted partitions) and streaming (state kept between calls) run
this same class, so they assign the same bars. It only decides where bars end.
``step`` takes one tick; ``steps`` takes many with the same result, by tighter
loops for the families that need no clock and no session.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

from barspark.model import BarSpec, Ewma, SchemaError, StateError, TickDataError

VERSION = 2


class Fold:
    """Where the bars of one ordered stream end."""

    def __init__(self, spec: BarSpec):
        self.spec = spec
        self.bar = 0  # bars closed so far, by whatever
        self.filled = False  # the open bar has a tick
        self.in_session = True
        self.total = 0.0  # what counts towards the threshold: metrics, or for imbalance signed ones, with what was carried
        self.own = 0.0  # metric of the open bar's own ticks
        # run bars: the total by direction; a tick without side goes the last known way, or waits for the first
        self.buys = self.sells = self.waiting = 0.0
        self.direction: float | None = None
        self.boundary: int | None = None
        moving = spec.threshold if isinstance(spec.threshold, Ewma) else None
        self.expected_t = moving.initial_t if moving else 0.0
        self.expected_p = moving.initial_proportion if moving else 0.0

    @property
    def threshold(self) -> float:
        limit = self.spec.threshold
        if not isinstance(limit, Ewma):
            return limit.threshold
        p = self.expected_p
        level = self.expected_t * (abs(p) if self.spec.family == "imbalance" else max(p, 1.0 - p))
        return max(level, limit.min_threshold)

    def _add(self, ts: int, metric: float, side: float | None) -> None:
        family = self.spec.family
        self.filled = True
        self.own += metric
        if family == "imbalance":
            self.total += (side or 0.0) * metric
        elif family == "time":
            if self.boundary is None:
                step = self.spec.interval_ms
                self.boundary = ts + step if self.spec.anchor == "first_tick" else ts - ts % step + step
        else:
            self.total += metric
            if family == "run":
                self._towards(metric, side)

    def _towards(self, metric: float, side: float | None) -> None:
        if side is not None:
            if self.direction is None:
                metric, self.waiting = metric + self.waiting, 0.0
            self.direction = side
        if self.direction is None:
            self.waiting += metric
        elif self.direction > 0:
            self.buys += metric
        else:
            self.sells += metric

    def _full(self, ts: int, limit: float) -> bool:
        family = self.spec.family
        if family == "time":
            return ts >= self.boundary
        return (abs(self.total) if family == "imbalance" else self.total) >= limit

    def stats(self) -> tuple[float, float]:
        """Size and proportion of the open bar, as the moving threshold sees them."""
        if self.spec.family == "imbalance":
            return self.own, self.total / self.own if self.own else 0.0
        if self.spec.family == "run":
            sided = self.buys + self.sells
            return self.total, self.buys / sided if sided > 0 else 0.5
        return 0.0, 0.0

    def _close(self, limit: float, forced: bool) -> None:
        family = self.spec.family
        if family == "time":
            self.boundary += self.spec.interval_ms
        elif family == "imbalance":
            self.total = math.copysign(max(0.0, abs(self.total) - limit), self.total)
        else:
            self.total -= limit
            if family == "run" or self.spec.metric == "tick" or forced and self.spec.session_carry == "reset":
                self.total = max(0.0, self.total)
            if family == "run":  # what is carried goes the last known way
                self.buys = self.sells = self.waiting = 0.0
                last, self.direction = self.direction, None
                self._towards(self.total, last)
        self.own, self.filled = 0.0, False
        self.bar += 1

    def _learn(self, t: float, p: float) -> None:
        if isinstance(self.spec.threshold, Ewma):
            a = self.spec.threshold.alpha
            self.expected_t = a * t + (1.0 - a) * self.expected_t
            self.expected_p = a * p + (1.0 - a) * self.expected_p

    def step(self, ts: int, metric: float, side: float | None, out_of_session: bool = False, price: float = 0.0, volume: float = 0.0) -> tuple[int, float | None]:
        """The tick's bar, and the threshold from here on if this tick closed it.

        A change between session and after-hours first closes an open bar, which
        leaves the moving averages as they are.
        """
        if self.filled and out_of_session == self.in_session:
            self._close(self.threshold, True)
        self.in_session = not out_of_session
        self._add(ts, metric, side)
        mine, limit = self.bar, self.threshold
        if not self._full(ts, limit):
            return mine, None
        stats = self.stats()
        self._close(limit, False)
        self._learn(*stats)
        return mine, self.threshold

    def steps(self, ts: Sequence[int], metrics: Sequence[float], sides: Sequence[float | None], out: Sequence[bool] | None, prices: Sequence[float], volumes: Sequence[float]) -> tuple[list[int], list[tuple[int, float]]]:
        """The bar of each tick, and the place and new threshold of each close by ticks."""
        if out is None and self.in_session and type(self) is Fold:
            family = self.spec.family
            if family == "time":
                return self._times(ts)
            if family == "standard":
                return self._sums(metrics)
            return (self._imbalance if family == "imbalance" else self._runs)(metrics, sides)
        bars, closes = [], []
        for i, (t, m, s, o, p, v) in enumerate(zip(ts, metrics, sides, out or [False] * len(ts), prices, volumes, strict=True)):
            bar, limit = self.step(t, m, s, o, p, v)
            bars.append(bar)
            if limit is not None:
                closes.append((i, limit))
        return bars, closes

    def _ended(self, bars: list[int], closes: list[tuple[int, float]]) -> tuple[list[int], list[tuple[int, float]]]:
        if bars:
            self.filled = not closes or closes[-1][0] < len(bars) - 1
        return bars, closes

    def _sums(self, metrics: Sequence[float]) -> tuple[list[int], list[tuple[int, float]]]:
        bars, closes, bar, total, limit = [], [], self.bar, self.total, self.threshold
        least = 0.0 if self.spec.metric == "tick" else -math.inf
        for i, m in enumerate(metrics):
            total += m
            bars.append(bar)
            if total >= limit:
                total = max(least, total - limit)
                bar += 1
                closes.append((i, limit))
        self.own = math.fsum(metrics[closes[-1][0] + 1 :]) if closes else self.own + math.fsum(metrics)
        self.bar, self.total = bar, total
        return self._ended(bars, closes)

    def _times(self, ts: Sequence[int]) -> tuple[list[int], list[tuple[int, float]]]:
        bars, closes, bar, limit = [], [], self.bar, self.threshold
        if len(ts) and self.boundary is None:
            self._add(ts[0], 0.0, None)
        edge, step = self.boundary, self.spec.interval_ms
        for i, t in enumerate(ts):
            bars.append(bar)
            if t >= edge:
                edge += step
                bar += 1
                closes.append((i, limit))
        self.bar, self.boundary = bar, edge
        return self._ended(bars, closes)

    def _imbalance(self, metrics: Sequence[float], sides: Sequence[float | None]) -> tuple[list[int], list[tuple[int, float]]]:
        bars, closes, bar, total, own, limit = [], [], self.bar, self.total, self.own, self.threshold
        for i, (m, s) in enumerate(zip(metrics, sides, strict=True)):
            own += m
            if s:
                total += s * m
            bars.append(bar)
            if total >= limit or -total >= limit:
                self.total, self.own = total, own
                t, p = self.stats()
                self._close(limit, False)
                self._learn(t, p)
                bar, total, own, limit = self.bar, self.total, self.own, self.threshold
                closes.append((i, limit))
        self.total, self.own = total, own
        return self._ended(bars, closes)

    def _runs(self, metrics: Sequence[float], sides: Sequence[float | None]) -> tuple[list[int], list[tuple[int, float]]]:
        bars, closes, bar, total, own, limit, towards = [], [], self.bar, self.total, self.own, self.threshold, self._towards
        for i, (m, s) in enumerate(zip(metrics, sides, strict=True)):
            total += m
            own += m
            towards(m, s)
            bars.append(bar)
            if total >= limit:
                self.total, self.own = total, own
                t, p = self.stats()
                self._close(limit, False)
                self._learn(t, p)
                bar, total, own, limit = self.bar, self.total, self.own, self.threshold
                closes.append((i, limit))
        self.total, self.own = total, own
        return self._ended(bars, closes)

    def dump(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "spec"}

    def restore(self, state: dict) -> None:
        if unknown := state.keys() ^ self.dump().keys():
            raise StateError(f"state does not fit this version: {sorted(unknown)}")
        self.__dict__.update(state)


class CustomFold(Fold):
    """The same rule with the user's accumulator, and threshold if it is one."""

    def __init__(self, spec: BarSpec):
        super().__init__(spec)
        self.accumulator = spec.accumulator()
        self.moving = spec.threshold() if callable(spec.threshold) else None
        self.now = (0.0, 0.0)

    @property
    def threshold(self) -> float:
        return self.moving.current() if self.moving else Fold.threshold.fget(self)

    def step(self, ts: int, metric: float, side: float | None, out_of_session: bool = False, price: float = 0.0, volume: float = 0.0) -> tuple[int, float | None]:
        self.now = (price, volume)
        return super().step(ts, metric, side, out_of_session)

    def _add(self, ts: int, metric: float, side: float | None) -> None:
        self.filled = True
        self.accumulator.add(ts, *self.now, side)

    def _full(self, ts: int, limit: float) -> bool:
        return self.accumulator.full(limit)

    def stats(self) -> tuple[float, float]:
        return self.accumulator.stats()

    def _close(self, limit: float, forced: bool) -> None:
        self.accumulator.close(limit, forced)
        self.filled, self.bar = False, self.bar + 1

    def _learn(self, t: float, p: float) -> None:
        if self.moving:
            self.moving.closed(t, p)
        else:
            super()._learn(t, p)

    def dump(self) -> dict:
        own = {k: v for k, v in super().dump().items() if k not in ("accumulator", "moving")}
        return own | {"accumulator": dict(vars(self.accumulator)), "moving": dict(vars(self.moving)) if self.moving else None}

    def restore(self, state: dict) -> None:
        if unknown := state.keys() ^ self.dump().keys():
            raise StateError(f"state does not fit this version: {sorted(unknown)}")
        vars(self.accumulator).update(state["accumulator"])
        if self.moving:
            vars(self.moving).update(state["moving"])
        self.__dict__.update({k: v for k, v in state.items() if k not in ("accumulator", "moving")})


def make_fold(spec: BarSpec) -> Fold:
    return CustomFold(spec) if spec.accumulator else Fold(spec)


def checked(name: str, value: float) -> float:
    """A price or volume: finite and 0 or more."""
    if not (math.isfinite(value) and value >= 0):
        raise TickDataError(f"{name} must be finite and 0 or more, got {value}")
    return value


def checked_side(value: float | None) -> float | None:
    """1, -1, or unknown (None or NaN)."""
    if value is None or value != value:
        return None
    if value not in (1, -1):
        raise TickDataError(f"side must be 1, -1 or unknown, got {value}")
    return float(value)


def normalize_tick(row: Mapping, mapping: Mapping[str, str]) -> dict:
    """One tick of a stream by field, cast and checked; a row without a mapped column is refused."""
    if absent := [c for c in mapping.values() if c not in row]:
        raise SchemaError(f"no columns {sorted(absent)}; the tick has {sorted(row)}")
    side = row[mapping["side"]] if "side" in mapping else None
    return {
        "ts": int(row[mapping["timestamp"]]),
        "price": checked("price", float(row[mapping["price"]])),
        "volume": checked("volume", float(row[mapping["volume"]])),
        "side": checked_side(None if side is None else float(side)),
    }


class BarBuilder:
    """Bars of one ordered tick stream with a state that can be saved and resumed.

    ``update`` drops ticks whose watermark is not above the last accepted one,
    refuses values that are not allowed, and returns the bars that the tick
    completed (two when a session ends at a tick that also fills its own bar).
    Signs are derived where no side is given.

    ``on_bar`` is called with every closed bar, also those that warm-up or
    ``min_run_length`` hold back, and ``on_threshold_update`` with each new
    threshold. ``parity_drop`` returns at most one bar a call: the second waits
    for the next call, whose own tick is lost.
    """

    def __init__(
        self, spec: BarSpec, stream_id: str = "default", watermark_key: str | None = "timestamp", strict_ordering: bool = False, parity_drop: bool = False,
        on_bar: Callable[[dict], None] | None = None, on_threshold_update: Callable[[float], None] | None = None,
    ):
        self.spec, self.stream_id, self.watermark_key, self.strict_ordering, self.parity_drop = spec, stream_id, watermark_key, strict_ordering, parity_drop
        self.on_bar, self.on_threshold_update = on_bar, on_threshold_update
        self.fold = make_fold(spec)
        self.last_watermark: int | None = None
        self.last_ts: int | None = None
        self.last_price: float | None = None
        self.last_sign: float | None = None
        self.open: dict | None = None
        self.pending: list[dict] = []
        self.returned = 0

    def update(self, ts: int, price: float, volume: float, side: float | None = None, watermark: int | None = None, out_of_session: bool = False) -> list[dict]:
        checked("price", price), checked("volume", volume)
        side = checked_side(side)
        mark = ts if watermark is None else watermark
        if self.watermark_key is not None and self.last_watermark is not None and mark <= self.last_watermark:
            return []
        if self.strict_ordering and self.last_ts is not None and ts < self.last_ts:
            raise TickDataError(f"timestamp {ts} after {self.last_ts}")
        if self.pending:
            return [self.pending.pop(0)]
        if self.last_price is not None and price != self.last_price:
            self.last_sign = 1.0 if price > self.last_price else -1.0
        self.last_watermark, self.last_ts, self.last_price = mark, ts, price
        metric = {"tick": 1.0, "volume": volume, "dollar": price * volume}[self.spec.metric]
        before, old = self.fold.bar, self.fold.threshold
        mine, new = self.fold.step(ts, metric, self.last_sign if side is None else side, out_of_session, price, volume)
        out = []
        if mine > before and self.open:
            out.append(self._done())
        self._grow(mine, ts, price, volume)
        if self.fold.bar > mine:
            out.append(self._done())
        if self.on_threshold_update and new is not None and new != old:
            self.on_threshold_update(new)
        keep = [b for b in out if b["bar_id"] >= self.spec.warmup_bars and (self.spec.family != "run" or b["num_ticks"] >= self.spec.min_run_length)]
        self.returned += len(keep)
        if self.parity_drop:
            keep, self.pending = keep[:1], keep[1:]
        return keep

    def update_row(self, row: Mapping, mapping: Mapping[str, str], out_of_session: bool = False) -> list[dict]:
        """``update`` with a row by column names; the watermark is the column named ``watermark_key``."""
        mark = self.watermark_key
        if mark not in (None, "timestamp") and mark not in row:
            raise SchemaError(f"no watermark column {mark!r}")
        watermark = None if mark in (None, "timestamp") else int(row[mark])
        return self.update(**normalize_tick(row, mapping), watermark=watermark, out_of_session=out_of_session)

    def _grow(self, bar: int, ts: int, price: float, volume: float) -> None:
        if self.open is None:
            self.open = dict(bar_id=bar, open=price, high=price, low=price, close=price, volume=0.0, dollar_value=0.0, num_ticks=0, open_ts=ts, close_ts=ts)
        b = self.open
        b["high"], b["low"], b["close"], b["close_ts"] = max(b["high"], price), min(b["low"], price), price, ts
        b["volume"] += volume
        b["dollar_value"] += price * volume
        b["num_ticks"] += 1

    def partial(self) -> dict | None:
        """The open bar, or None."""
        return self._finished(self.open) if self.open else None

    def _finished(self, b: dict) -> dict:
        return b | {"vwap": b["dollar_value"] / b["volume"] if b["volume"] else 0.0, "bar_type": self.spec.bar_type}

    def _done(self) -> dict:
        b, self.open = self._finished(self.open), None
        if self.on_bar:
            self.on_bar(b)
        return b

    def get_state(self) -> str:
        """All that a resumed run needs, options included; callbacks are passed anew."""
        own = {k: v for k, v in self.__dict__.items() if k not in ("spec", "fold", "on_bar", "on_threshold_update")}
        return json.dumps({"version": VERSION, "bar_type": self.spec.bar_type, "fold": self.fold.dump(), **own})

    @classmethod
    def from_state(cls, spec: BarSpec, text: str, stream_id: str = "default", watermark_key: str | None = "timestamp", **callbacks) -> BarBuilder:
        state = json.loads(text)
        for name, want in (("version", VERSION), ("bar_type", spec.bar_type), ("stream_id", stream_id), ("watermark_key", watermark_key)):
            if state.get(name) != want:
                raise StateError(f"{name} of the state is {state.get(name)!r}; expected {want!r}")
        out = cls(spec, stream_id, watermark_key, **callbacks)
        out.fold.restore(state["fold"])
        out.__dict__.update({k: v for k, v in state.items() if k in out.__dict__ and k not in ("fold", "spec")})
        return out
