"""Ordering, validation, extension points, sources and the physical forms of the bar engine."""

import math
import random
import sys
import types

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barspark import registry
from barspark.extend import Accumulator, Threshold
from barspark.functions.calendars import Continuous, Exchange, Session, Weekdays
from barspark.functions.chi2 import chi2_sf
from barspark.functions.fold import BarBuilder, Fold, normalize_tick
from barspark.model import BAR_COLUMNS, BarSpec, Ewma, SchemaError, Static, ThresholdError, TickDataError
from barspark.operators import bars as B
from barspark.operators import calibrate, quality
from barspark.operators import ticks as T
from barspark.plans import closed_form
from barspark.sources import polars_frames
from barspark.sources.ticks import from_frame, read_csv, sample, synthetic

DDL = "seq long, timestamp long, price double, volume double, side double, sym string"


def table(spark, rows):
    """Rows ``timestamp, price, volume, side, sym`` in the order of ``seq``."""
    return spark.createDataFrame([(i, t, float(p), float(v), s, k) for i, (t, p, v, s, k) in enumerate(rows)], DDL)


def bars_of(df, *by):
    return [r.asDict() for r in df.orderBy(*by, "bar_id").collect()]


def noise(n, seed, keys=("a",), step=1000):
    rnd = random.Random(seed)
    return [(i * step, rnd.randint(1, 20), rnd.choice((0, 1, 2, 9, 30)), rnd.choice((1.0, -1.0, None)), rnd.choice(keys)) for i in range(n)]


def slow_time_bars(ts, step, first_tick=False):
    """Ticks of each bar by the rule itself."""
    edge, out, n = None, [], 0
    for t in ts:
        if edge is None:
            edge = t + step if first_tick else t - t % step + step
        n += 1
        if t >= edge:
            out.append(n)
            n, edge = 0, edge + step
    return out


def test_time_bars_of_falling_timestamps(spark):
    stamps = [100, 160, 30, 170, 260, 300]
    df = table(spark, [(t, 1, 1, None, "a") for t in stamps])
    got = bars_of(B.compute_time_bars(df, 50, order=["seq"], watermark=None))
    assert [b["num_ticks"] for b in got] == slow_time_bars(stamps, 50) == [2, 3, 1]
    rnd = random.Random(4)
    stamps = [rnd.randint(0, 5000) for _ in range(400)]
    df = table(spark, [(t, 1, 1, None, "a") for t in stamps])
    for anchor in ("clock", "first_tick"):
        got = bars_of(B.compute_time_bars(df, 300, anchor=anchor, order=["seq"], watermark=None))
        assert [b["num_ticks"] for b in got] == slow_time_bars(stamps, 300, anchor == "first_tick")


def test_time_gap_moves_one_interval_only(spark):
    df = table(spark, [(t, 1, 1, None, "a") for t in (36_000_000, 36_300_000, 36_300_001, 36_300_002, 36_300_003, 36_300_004, 36_300_005)])
    assert [b["num_ticks"] for b in bars_of(B.compute_time_bars(df, 60_000))] == [2, 1, 1, 1, 1]


def test_strict_ordering(spark):
    df = table(spark, [(t, 1, 1, None, "a") for t in (3000, 2000, 4000)])
    for options in ({"watermark": None}, {}):  # also the default watermark, which would drop the late row
        with pytest.raises(Exception, match="out of order"):
            B.compute_tick_bars(df, 2, order=["seq"], strict_ordering=True, **options).collect()
        with pytest.raises(Exception, match="out of order"):
            B.compute_imbalance_tick_bars(df, order=["seq"], strict_ordering=True, **options).collect()
    assert [b["num_ticks"] for b in bars_of(B.compute_tick_bars(df, 2, order=["seq"]))] == [2]
    assert [b["num_ticks"] for b in bars_of(B.compute_tick_bars(df, 2, order=["seq"], watermark=None))] == [2]
    assert len(bars_of(B.compute_tick_bars(df.where("seq <> 1"), 2, order=["seq"], strict_ordering=True))) == 1
    for order in (None, ["timestamp"]):  # a table sorted by time cannot show disorder
        with pytest.raises(ValueError, match="strict ordering"):
            B.compute_tick_bars(df, 2, order=order, strict_ordering=True)
    assert B.compute_tick_bars(df, 2, order=["seq"], strict_ordering=True, after_watermark=3500).count() == 0
    assert [r["seq"] for r in T.out_of_order(df, T.sequence_window([], ["seq"])).collect()] == [1]


def test_strict_ordering_of_streams(spark, tmp_path):
    from barspark.streaming.bars import resumable_bars, stream_bars

    df = table(spark, [(t, 1, 1, None, "a") for t in (3000, 2000, 4000)])
    spec = BarSpec("standard", "tick", Static(2))
    with pytest.raises(Exception, match="timestamp 2000 after 3000"):
        resumable_bars(df, spec, key="sym", order=["seq"], strict_ordering=True, watermark_key=None).collect()
    with pytest.raises(ValueError):
        resumable_bars(df, spec, key="sym", strict_ordering=True, watermark_key=None)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    bars = stream_bars(source, spec, key=["sym"], order=["seq"], strict_ordering=True, watermark_key=None)
    q = bars.writeStream.format("memory").queryName("strict").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="timestamp 2000 after 3000"):
        q.awaitTermination(120)


def test_streamed_values_are_checked():
    for price, volume, side in ((math.nan, 1, None), (math.inf, 1, None), (-1, 1, None), (1, -0.5, None), (1, math.nan, None), (1, 1, 0.5), (1, 1, 2)):
        builder = BarBuilder(BarSpec("standard", "tick", Static(1)))
        with pytest.raises(TickDataError):
            builder.update(0, price, volume, side)
        assert builder.partial() is None and len(builder.update(0, 0.0, 0.0, math.nan)) == 1
    mapping = {"timestamp": "t", "price": "p", "volume": "v", "side": "s"}
    assert normalize_tick({"t": 5.0, "p": 1, "v": 2, "s": None, "more": 0}, mapping) == {"ts": 5, "price": 1.0, "volume": 2.0, "side": None}
    for row in ({"t": 1, "p": 1, "v": 1, "s": 1.7}, {"t": 1, "p": -1, "v": 1, "s": 1}):
        with pytest.raises(TickDataError):
            normalize_tick(row, mapping)
    with pytest.raises(SchemaError):
        normalize_tick({"t": 1, "p": 1, "v": 1}, mapping)
    builder = BarBuilder(BarSpec("standard", "tick", Static(1)), watermark_key="seq")
    row = {"t": 1, "p": 1, "v": 1, "s": 1}
    with pytest.raises(SchemaError):
        builder.update_row(row, mapping)
    assert len(builder.update_row(row | {"seq": 4}, mapping)) == 1 and builder.update_row(row | {"seq": 4}, mapping) == []


def test_first_row_that_is_not_allowed(spark):
    rows = noise(40, 1, ("a", "b"))
    rows[25] = (25_000, -1, 1, None, "b")
    rows[31] = (31_000, 1, 1, 0.5, "a")
    df = table(spark, rows)
    mapping = T.SchemaMapping({c: c for c in ("timestamp", "price", "volume", "side")})
    got = T.first_invalid(df, mapping, order=["seq"])
    assert (got["row"], got["price"]) == (25, -1.0)
    got = T.first_invalid(df, mapping, key=["sym"], order=["seq"])
    assert (got["row"], got["sym"], got["side"]) == (sum(r[4] == "a" for r in rows[:31]), "a", 0.5)
    assert T.first_invalid(df.where("seq < 25"), mapping, order=["seq"]) is None
    with pytest.raises(TickDataError, match="'row': 25"):
        B.compute_tick_bars(df, 3, order=["seq"], validate="eager")
    with pytest.raises(Exception, match="TickDataError in timestamp"):
        B.compute_tick_bars(spark.createDataFrame([(None, 1.0, 1.0)], "timestamp long, price double, volume double"), 1).collect()


def test_minutes_must_be_consistent(spark):
    df = spark.createDataFrame([(0, 2.0, 3.0, 2.5, 2.0, 1.0)], "timestamp long, open double, high double, low double, close double, volume double")
    with pytest.raises(Exception, match="TickDataError in low"):
        B.compute_volume_bars_from_minutes(df, 1.0).collect()
    with pytest.raises(SchemaError):
        B.compute_volume_bars_from_minutes(df.drop("open"), 1.0)


SIDED = st.lists(st.tuples(st.integers(0, 9), st.sampled_from([1.0, -1.0, None])), max_size=80)


@settings(max_examples=150, deadline=None)
@given(SIDED, st.integers(0, 80), st.sampled_from(["imbalance", "run", "standard", "tick", "time"]), st.booleans())
def test_steps_equal_single_steps(data, cut, family, moving):
    moving = moving and family in ("imbalance", "run")
    metric = "tick" if family == "tick" else "volume"
    spec = BarSpec({"tick": "standard"}.get(family, family), metric, Ewma(5, None, 6.0, 0.5) if moving else Static(7.0), interval_ms=3)
    one, many = Fold(spec), Fold(spec)
    want = [one.step(i, float(m), s) for i, (m, s) in enumerate(data)]
    bars, closes = [], []
    for part in (data[:cut], data[cut:]):
        b, c = many.steps(range(len(bars), len(bars) + len(part)), [float(m) for m, _ in part], [s for _, s in part], None, [1.0] * len(part), [1.0] * len(part))
        closes += [(i + len(bars), x) for i, x in c]
        bars += b
    assert bars == [b for b, _ in want] and closes == [(i, x) for i, (_, x) in enumerate(want) if x is not None]
    mine, its = one.dump(), many.dump()
    if family == "time":  # which counts no metric
        mine.pop("own"), its.pop("own")
    assert mine == its


def slow_run_bars(data, limit):
    """(ticks, total, share of buys) of run bars by runs: what a run gathers goes the way of its side."""
    out, runs, way, carried, n = [], [], None, 0.0, 0
    for m, s in data:
        way = way if s is None else s
        if s is not None:
            runs = [(x, s if d is None else d) for x, d in runs]
        runs.append((m, way))
        n += 1
        total = sum(x for x, _ in runs)
        if total >= limit:
            buys, sells = (sum(x for x, d in runs if d == k) for k in (1.0, -1.0))
            out.append((n, total, buys / (buys + sells) if buys + sells else 0.5))
            carried, n = total - limit, 0
            runs = [(carried, way)]
    return out


@settings(max_examples=100, deadline=None)
@given(SIDED, st.integers(1, 30))
def test_run_statistics_by_runs(data, limit):
    fold, got, n = Fold(BarSpec("run", "volume", Static(float(limit)))), [], 0
    for m, s in data:
        fold._add(0, float(m), s)
        n += 1
        if fold._full(0, float(limit)):
            got.append((n, *fold.stats()))
            fold._close(float(limit), False)
            n = 0
    assert got == slow_run_bars([(float(m), s) for m, s in data], float(limit))


SPECS = [
    BarSpec("imbalance", "volume", Static(11.0)), BarSpec("imbalance", "dollar", Ewma(20, None, 60.0, 0.5)), BarSpec("run", "tick", Ewma(20, None, 4.0, 0.5), warmup_bars=2, min_run_length=2),
    BarSpec("standard", "volume", Static(25.0)), BarSpec("time", interval_ms=2500),
]


@pytest.mark.parametrize("calendar", [None, Session(0, 1, 0, 3)], ids=["always", "sessions"])
@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.bar_type)
def test_small_batches_and_keys_equal_updates(spark, spec, calendar):
    rows = noise(400, 7, ("a", "b", None))
    sided = {c: c for c in ("timestamp", "price", "volume", "side")}
    shut = lambda t: calendar is not None and not 60_000 <= t % 86_400_000 < 180_000
    want = {}
    for k in ("a", "b", None):
        builder = BarBuilder(spec)
        own = [r for r in rows if r[4] == k]
        last = None
        for t, p, v, s, _ in own:  # a given side that is unknown stays unknown
            metric = {"tick": 1.0, "volume": float(v), "dollar": float(p * v)}[spec.metric]
            before = builder.fold.bar
            mine, _ = builder.fold.step(t, metric, s, shut(t))
            if mine > before and builder.open:
                want.setdefault(k, []).append(builder._done())
            builder._grow(mine, t, float(p), float(v))
            if builder.fold.bar > mine:
                want.setdefault(k, []).append(builder._done())
        last = builder.partial()
        want.setdefault(k, []).append(last) if last else None
        want[k] = [(b, b is last) for b in want[k] if b["bar_id"] >= spec.warmup_bars and (spec.family != "run" or b["num_ticks"] >= spec.min_run_length)]
    df = table(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = B.build_bars(df, spec, sided, key=["sym"], calendar=calendar, include_partial=True, exact_parity=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, bars in want.items():
        mine = sorted((r.asDict() for r in got if r["sym"] == k), key=lambda r: r["bar_id"])
        assert [({c: r[c] for c in BAR_COLUMNS}, r["is_partial"]) for r in mine] == [({c: b[c] for c in BAR_COLUMNS}, p) for b, p in bars]


def test_batch_by_windows_equals_sequential_pass(spark):
    df = table(spark, noise(500, 3, ("a", "b")))
    for spec in (BarSpec("standard", "dollar", Static(90.0)), BarSpec("run", "volume", Static(20.0)), BarSpec("time", interval_ms=3000)):
        options = {"key": ["sym"], "order": ["timestamp", "seq"], "include_partial": True}
        assert bars_of(B.build_bars(df, spec, **options), "sym") == bars_of(B.build_bars(df, spec, exact_parity=True, **options), "sym")


def test_derived_signs_before_the_watermark(spark):
    """Signs come from all rows, also those that the watermark drops, and resumption keeps what is above."""
    rows = [(t, p, 1, None, "a") for t, p in ((1, 5), (2, 6), (2, 4), (3, 4), (4, 4), (5, 7))]
    df = table(spark, rows)
    spec = BarSpec("imbalance", "tick", Static(100.0))
    got = B.assign_bars(df, spec, order=["timestamp", "seq"]).orderBy("__seq").collect()
    assert [r["timestamp"] for r in got] == [1, 2, 3, 4, 5]
    dump = B.build_bars(df, spec, order=["timestamp", "seq"], include_partial=True).first()
    assert dump["num_ticks"] == 5 and dump["is_partial"]
    closes = B.build_bars(df, BarSpec("imbalance", "tick", Static(1.0)), order=["timestamp", "seq"], after_watermark=2).count()
    assert closes == 3  # the ticks at 3, 4 and 5 have signs -1, -1, 1: each fills a bar


def test_chunks_are_chosen_by_size(spark, monkeypatch):
    rows = noise(600, 9)
    rows = rows + [(t, p, v, s, "late") for t, p, v, s, _ in rows[100:200]]
    df = table(spark, rows)
    spec, options = BarSpec("standard", "volume", Static(31.0)), {"order": ["timestamp", "seq"]}
    want = bars_of(B.build_bars(df, spec, chunks=0, **options))
    assert want == bars_of(B.build_bars(df, spec, chunks=7, **options)) and len(want) > 50
    assert bars_of(B.build_bars(df, spec, chunks=7, watermark="seq", **options)) == bars_of(B.build_bars(df, spec, chunks=0, watermark="seq", **options))
    monkeypatch.setattr(B, "CHUNK_BYTES", 1)
    called = []
    real = closed_form.chunked
    monkeypatch.setattr(closed_form, "chunked", lambda *a: called.append(a[3]) or real(*a))
    stored = df.where("seq >= 0")
    monkeypatch.setattr(B, "_estimated_bytes", lambda _: 2)
    assert bars_of(B.build_bars(stored, spec, **options)) == want and called == [4]


def test_callbacks():
    seen, levels = [], []
    spec = BarSpec("run", "tick", Ewma(5, None, 3.0, 0.5), warmup_bars=2)
    builder = BarBuilder(spec, on_bar=seen.append, on_threshold_update=levels.append)
    returned = [b for i in range(40) for b in builder.update(i, 1.0 + i % 3, 1.0)]
    assert [b["bar_id"] for b in seen] == list(range(len(seen))) and returned == seen[2:]
    assert 0 < len(levels) <= len(seen) and levels[-1] == builder.fold.threshold
    resumed = BarBuilder.from_state(spec, builder.get_state(), on_bar=seen.append)
    n = len(seen)
    assert [b for i in range(40, 60) for b in resumed.update(i, 1.0, 1.0)] == seen[n:] != []


def test_parity_drop_returns_one_bar_a_call():
    spec = BarSpec("standard", "tick", Static(2.0), session_carry="keep")
    feed = [(0, False), (1, False), (2, False), (3, True), (4, True), (5, True)]
    whole, parity = BarBuilder(spec), BarBuilder(spec, parity_drop=True)
    every = [whole.update(t, 1.0, 1.0, out_of_session=o) for t, o in feed]
    one = [parity.update(t, 1.0, 1.0, out_of_session=o) for t, o in feed]
    assert [len(x) for x in every] == [0, 1, 0, 1, 1, 0] and [len(x) for x in one] == [len(x) for x in every]
    spec = BarSpec("standard", "volume", Static(5.0))
    feed = [(0, 1.0, False), (1, 20.0, True), (2, 1.0, True), (3, 1.0, True)]
    whole, parity = BarBuilder(spec), BarBuilder(spec, parity_drop=True)
    every = [whole.update(t, 1.0, v, out_of_session=o) for t, v, o in feed]
    one = [parity.update(t, 1.0, v, out_of_session=o) for t, v, o in feed]
    assert [len(x) for x in every] == [0, 2, 1, 1]
    assert [len(x) for x in one] == [0, 1, 1, 1] and one[2][0] == every[1][1]  # its own tick is lost
    again = BarBuilder.from_state(spec, BarBuilder(spec, parity_drop=True).get_state())
    assert again.parity_drop


def own_types():
    """An accumulator and a threshold; local classes reach workers by value."""

    class TwoRises(Accumulator):
        """Closes at the second rise of the price, or at ``threshold`` ticks."""

        def __init__(self):
            self.last, self.rises, self.n = None, 0, 0

        def add(self, ts, price, volume, side):
            self.rises += self.last is not None and price > self.last
            self.last, self.n = price, self.n + 1

        def full(self, threshold):
            return self.rises >= 2 or self.n >= threshold

        def close(self, threshold, forced):
            self.rises = self.n = 0

        def stats(self):
            return float(self.n), 1.0

    class Shrinking(Threshold):
        def __init__(self):
            self.level = 6.0

        def current(self):
            return self.level

        def closed(self, size, proportion):
            self.level = max(2.0, self.level - proportion)

    return TwoRises, Shrinking


def slow_custom(prices):
    out, last, rises, n, level = [], None, 0, 0, 6.0
    for p in prices:
        rises += last is not None and p > last
        last, n = p, n + 1
        if rises >= 2 or n >= level:
            out.append(n)
            rises, n, level = 0, 0, max(2.0, level - 1)
    return out


def test_own_accumulator_and_threshold(spark):
    two_rises, shrinking = own_types()
    spec = BarSpec("custom", threshold=shrinking, accumulator=two_rises, label="two_rises")
    rows = noise(120, 12, ("a", "b"))
    got = bars_of(B.build_bars(table(spark, rows), spec, key=["sym"]), "sym")
    for k in ("a", "b"):
        assert [b["num_ticks"] for b in got if b["sym"] == k] == slow_custom([r[1] for r in rows if r[4] == k])
    assert {b["bar_type"] for b in got} == {"two_rises"}
    whole, first = BarBuilder(spec), BarBuilder(spec)
    want = [b for t, p, v, _, _ in rows for b in whole.update(t, float(p), float(v))]
    mine = [b for t, p, v, _, _ in rows[:50] for b in first.update(t, float(p), float(v))]
    second = BarBuilder.from_state(spec, first.get_state())
    assert mine + [b for t, p, v, _, _ in rows for b in second.update(t, float(p), float(v))] == want
    with pytest.raises(ValueError):
        BarSpec("custom")
    with pytest.raises(ThresholdError):
        BarSpec("run", threshold=shrinking)


def test_registry_of_builders():
    assert len(registry.names()) == 10
    builder = registry.get_builder("dollar")(threshold=10.0, stream_id="x")
    assert len(builder.update(0, 5.0, 2.0)) == 1 and builder.stream_id == "x"
    assert registry.get_builder("time")(interval_ms=5).spec.bar_type == "time"
    assert registry.get_builder("run_volume")(span=5, min_run_length=2).spec.min_run_length == 2
    registry.clear()
    try:
        assert registry.names() == []
        with pytest.raises(KeyError):
            registry.get_builder("tick")

        @registry.register("mine")
        def mine(df):
            return df

        assert registry.get("mine") is mine
    finally:
        registry.clear()
        registry.register_all()
    assert len(registry.names()) == 10


def test_polars_frames_by_arrow(spark, monkeypatch):
    class Frame:  # what this needs of a polars frame
        def __init__(self, table):
            self.table = table

        def to_arrow(self):
            return self.table

    monkeypatch.setitem(sys.modules, "polars", types.SimpleNamespace(from_arrow=Frame))
    df = table(spark, noise(80, 2))
    frame = Frame(df.drop("sym", "side").toArrow())
    names = [f"{f}{m}_bars" for f in ("", "imbalance_", "run_") for m in ("tick", "volume", "dollar")]
    for name in names:
        args = (20.0,) if "_" not in name.removesuffix("_bars") else ()
        got = getattr(polars_frames, name)(spark, frame, *args).to_arrow().to_pylist()
        assert got == bars_of(getattr(B, f"compute_{name}")(df.drop("sym", "side"), *args)), name
    assert polars_frames.time_bars(spark, frame, 5000).to_arrow().column_names == list(BAR_COLUMNS)
    assert polars_frames.from_polars(spark, frame).count() == 80


def test_exchange_by_code_and_next_open(spark, monkeypatch):
    import pandas as pd

    day = 86_400_000
    opens = [day * d + 34_200_000 for d in (3, 4, 8)]
    schedule = pd.DataFrame({"open": pd.to_datetime(opens, unit="ms", utc=True), "close": pd.to_datetime([o + 3_600_000 for o in opens], unit="ms", utc=True)})
    asked = []
    monkeypatch.setitem(sys.modules, "exchange_calendars", types.SimpleNamespace(get_calendar=lambda code, **k: asked.append((code, k)) or types.SimpleNamespace(schedule=schedule)))
    exchange = Exchange.by_code(spark, "XNYS", start="1970-01-01")
    assert asked == [("XNYS", {"start": "1970-01-01"})]
    stamps = [0, *(o + x for o in opens for x in (-1, 0, 1, 3_599_999, 3_600_000)), 6 * day, 9 * day]
    df = spark.createDataFrame([(t,) for t in stamps], "ts long")
    got = {r["ts"]: r for r in exchange.with_next_open(exchange.mark(df, "ts", "shut"), "ts", "next").collect()}
    for t in stamps:
        assert got[t]["shut"] == (not any(o <= t < o + 3_600_000 for o in opens))
        assert got[t]["next"] == min((o for o in opens if o > t), default=None)
    monkeypatch.setitem(sys.modules, "exchange_calendars", None)
    with pytest.raises(ImportError, match="exchange_calendars"):
        Exchange.by_code(spark, "XNYS")


def test_next_open_of_calendars(spark):
    monday, hour = 1_704_672_000_000, 3_600_000
    df = spark.createDataFrame([(monday + h * hour,) for h in (0, 9, 10, 24 * 4 + 12, 24 * 5)], "ts long")
    ask = lambda c: [r[0] for r in df.select(c.next_open(F.col("ts")), "ts").orderBy("ts").collect()]
    open_ = monday + 9 * hour + hour // 2
    assert ask(Session(9, 30, 16, 0)) == [open_, open_, open_ + 24 * hour, open_ + 7 * 24 * hour, open_ + 7 * 24 * hour]
    assert ask(Weekdays()) == [monday + 7 * 24 * hour] * 5
    assert ask(Continuous()) == [monday + h * hour for h in (0, 9, 10, 108, 120)]


def test_sink_with_a_callback(spark, tmp_path):
    from barspark.streaming.bars import on_bars, stream_bars

    df = sample(spark).selectExpr("'x' AS sym", "*")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen = []
    on_bars(stream_bars(source, BarSpec("standard", "tick", Static(50)), key=["sym"]), seen.append, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert [b["bar_id"] for b in seen] == list(range(10))


def test_streamed_query_takes_ticks_by_time(spark):
    from barspark import queries

    run = lambda name: sorted(tuple(r) for r in queries.queries()[name](spark, "/root/testdata/sf0.001").collect())
    assert run("stream_volume_bars") == run("volume_bars") != []


def test_ties_go_by_event_in_streams(spark, tmp_path):
    from barspark import queries

    rows = spark.range(900).selectExpr("899 - id AS event_id", "timestamp_millis((899 - id) div 30 * 1000) AS ts", "id % 2 AS user_id", "'view' AS event_type", "CAST(id % 89 AS DOUBLE) AS value", """'{"k": 99}' AS props""")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: sorted(tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect())
    assert run("stream_volume_bars") == run("resume_equals_full") == run("volume_bars") != []


def test_sources(spark, tmp_path):
    frame = sample(spark).toPandas()
    assert from_frame(spark, frame).count() == 500 and sample(spark).columns == ["timestamp", "price", "volume"]
    frame.to_csv(tmp_path / "ticks.csv", index=False)
    assert read_csv(spark, str(tmp_path / "ticks.csv")).orderBy("timestamp").collect() == sample(spark).orderBy("timestamp").collect()
    ticks = synthetic(spark, 1000, instruments=3)
    assert ticks.count() == 3000 and ticks.where("price <= 0 or volume <= 0").count() == 0


def slow_ljung_box(x, lags):
    x = x - x.mean()
    d, n = (x * x).sum(), len(x)
    rho = [(x[k:] * x[:-k]).sum() / d for k in range(1, lags + 1)]
    return n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(rho, 1))


def test_quality_values(spark):
    rnd = np.random.default_rng(3)
    for shape, n in (("walk", 120), ("sticky", 300), ("short", 4)):
        r = rnd.normal(size=n) * 0.01
        if shape == "sticky":
            for i in range(1, n):
                r[i] += 0.7 * r[i - 1]
        close = 100 * np.exp(np.cumsum(r))
        df = spark.createDataFrame([(i, float(c), "tick", 3, i * 1000) for i, c in enumerate(close)], "bar_id long, close double, bar_type string, num_ticks long, open_ts long")
        x = np.diff(np.log(close))
        got = quality.quality_report(df).first()
        lags = min(max(1, min(10, n // 5)), len(x) - 1)
        q = slow_ljung_box(x, lags)
        assert got["lags"] == lags and got["lb_statistic"] == pytest.approx(q, rel=1e-9) and got["lb_p_value"] == pytest.approx(chi2_sf(q, lags), abs=1e-12)
        assert got["reject_autocorrelation"] == (chi2_sf(q, lags) < 0.05)
        if len(x) >= 4:
            m = [np.mean(x**p) for p in (2, 3, 4)]
            jb = len(x) / 6 * ((m[1] / m[0] ** 1.5) ** 2 + (m[2] / m[0] ** 2 - 3) ** 2 / 4)
            assert got["jb_statistic"] == pytest.approx(jb, rel=1e-9) and got["jb_p_value"] == pytest.approx(math.exp(-jb / 2), rel=1e-9)
        else:
            assert got["jb_statistic"] is None
    assert quality.quality_report(df.limit(1)).first()["lb_statistic"] is None


def test_quality_of_days_and_runs(spark):
    day = 86_400_000
    rows = [(i, 1.0, "run_tick", t, (i // 4) * day) for i, t in enumerate([1, 1, 2, 3, 5, 10, 20, 5, 2, 1] * 10)]
    df = spark.createDataFrame(rows, "bar_id long, close double, bar_type string, num_ticks long, open_ts long")
    got = quality.quality_report(df).first()
    assert (got["n_days"], got["mean_per_day"], got["std_per_day"], got["cv"], got["per_day"]) == (25, 4.0, 0.0, 0.0, [4] * 25)
    assert got["fraction_fragmented"] == 0.5


def slow_seeds(rows, family, target, span):
    """Seeds by two plain simulations."""

    def simulate(limit):
        out, total, own, buys, sells, way, free = [], 0.0, 0.0, 0.0, 0.0, None, 0.0
        for s in rows:
            own += 1
            if family == "imbalance":
                total += s or 0
                if abs(total) >= limit:
                    out.append((own, total / own))
                    total, own = math.copysign(max(0.0, abs(total) - limit), total), 0.0
                continue
            total += 1
            if s is not None and way is None:
                buys, sells, free = buys + (free if s > 0 else 0), sells + (free if s < 0 else 0), 0.0
            way = way if s is None else s
            buys, sells, free = buys + (way == 1), sells + (way == -1), free + (way is None)
            if total >= limit:
                out.append((total, buys / (buys + sells) if buys + sells else 0.5))
                total = max(0.0, total - limit)
                way = way if total else None
                buys, sells, free = (total if way == 1 else 0.0), (total if way == -1 else 0.0), total if way is None else 0.0
        return out

    total = float(len(rows))
    first = simulate(total / target)
    stats = simulate(total / target * len(first) / target if first else total) or [(total, 0.5)]
    a, (t, p) = 2 / (span + 1), stats[0]
    for x, y in stats[1:]:
        t, p = a * x + (1 - a) * t, a * y + (1 - a) * p
    return t, p


def test_seeds_by_plain_simulation(spark):
    rows = noise(300, 21)
    schema = {c: c for c in ("timestamp", "price", "volume", "side")}
    for family in ("imbalance", "run"):
        for target in (3, 20):
            got = calibrate.ewma_seeds(table(spark, rows), family, "tick", 20, target, schema=schema).first()
            want = slow_seeds([r[3] for r in rows], family, target, 20)
            assert (got["initial_t"], got["initial_proportion"]) == pytest.approx(want, rel=1e-12)
    for family in ("imbalance", "run"):
        for metric in ("volume", "dollar"):
            assert calibrate.fixed_threshold(table(spark, rows), f"{family}_{metric}", 5, schema=schema).first()["threshold"] > 0
    with pytest.raises(ValueError):
        calibrate.fixed_threshold(table(spark, rows), "time", 5)


def test_odd_column_names(spark):
    df = table(spark, noise(60, 8)).withColumnRenamed("sym", "my key, odd").withColumnRenamed("seq", "the order")
    spec = BarSpec("imbalance", "tick", Static(3.0))
    assert B.build_bars(df, spec, key=["my key, odd"], order=["timestamp", "the order"]).columns[0] == "my key, odd"
    assert B.build_bars(df, spec, key=["my key, odd"], order=["timestamp", "the order"]).count() >= 3
    assert calibrate.ewma_seeds(df, "run", key=["my key, odd"]).count() == 1


def test_bars_by_a_table_function(spark):
    from barspark.streaming.udtf import register_bars

    df = table(spark, noise(200, 4, ("a", "b"))).drop("side")
    df.createOrReplaceTempView("trades")
    spec = BarSpec("run", "volume", Ewma(20, None, 20.0, 0.5))
    register_bars(spark, "my_bars", spec)
    got = spark.sql("SELECT * FROM my_bars(TABLE(SELECT sym, timestamp, price, volume FROM trades) PARTITION BY sym ORDER BY timestamp)")
    assert bars_of(got, "sym") == bars_of(B.build_bars(df, spec, key=["sym"]), "sym") != []
