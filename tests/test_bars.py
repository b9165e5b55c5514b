import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.functions.calendars import Session, Weekdays
from barspark.functions.chi2 import chi2_sf
from barspark.functions.fold import BarBuilder, Fold
from barspark.model import BarSpec, Ewma, SchemaError, StateError, Static, ThresholdError
from barspark.operators import bars as B
from barspark.operators import calibrate, quality
from barspark.operators.ticks import SchemaMapping
from barspark.plans import closed_form
from barspark.sources.ticks import sample

DDL = "timestamp long, price double, volume double, side double"


def frame(spark, rows):
    return spark.createDataFrame([(t, float(p), float(v), s) for t, p, v, s in rows], DDL)


def ticks(spark, prices, volumes=None, sides=None, step=1000):
    volumes, sides = volumes or [1.0] * len(prices), sides or [None] * len(prices)
    return frame(spark, [(i * step, p, v, s) for i, (p, v, s) in enumerate(zip(prices, volumes, sides, strict=True))])


def rows(df):
    return [r.asDict() for r in df.orderBy("bar_id").collect()]


def test_tick_bars(spark):
    got = rows(B.compute_tick_bars(ticks(spark, [10, 12, 11, 13, 14, 15]), 2))
    assert [(b["bar_id"], b["open"], b["close"], b["num_ticks"]) for b in got] == [(0, 10, 12, 2), (1, 11, 13, 2), (2, 14, 15, 2)]


def test_volume_carries_over(spark):
    got = rows(B.compute_volume_bars(ticks(spark, [1, 1, 1], [7, 7, 7]), 10))
    assert [(b["volume"], b["num_ticks"]) for b in got] == [(14, 2), (7, 1)]


def test_one_huge_trade_closes_one_bar_a_tick(spark):
    got = rows(B.compute_volume_bars(ticks(spark, [1] * 4, [100, 1, 1, 1]), 10))
    assert [b["num_ticks"] for b in got] == [1, 1, 1, 1]


def test_time_bar_holds_the_crossing_tick(spark):
    df = frame(spark, [(t, 1, 1, None) for t in (36030000, 36060000, 36075000, 36130000)])
    assert [b["num_ticks"] for b in rows(B.compute_time_bars(df, 60000))] == [2, 2]
    df = frame(spark, [(t, 1, 1, None) for t in (10000, 40000, 70001, 100000, 130000)])
    assert [b["num_ticks"] for b in rows(B.compute_time_bars(df, 30000, anchor="first_tick"))] == [2, 1, 1, 1]


def test_zero_volume_and_empty(spark):
    assert rows(B.compute_tick_bars(ticks(spark, [1, 2], [0, 0]), 2))[0]["vwap"] == 0.0
    assert rows(B.compute_tick_bars(ticks(spark, []), 2)) == []
    assert B.compute_tick_bars(ticks(spark, [1]), 2).columns == list(B.BAR_COLUMNS)


def test_ewma_run_and_imbalance(spark):
    schema = {c: c for c in ("timestamp", "price", "volume", "side")}
    five = ticks(spark, [1] * 5, sides=[1.0] * 5)
    for compute in (B.compute_imbalance_tick_bars, B.compute_run_tick_bars):
        assert [b["num_ticks"] for b in rows(compute(five, initial_ewa_t=10, schema=schema))] == [5]
    seven = ticks(spark, [1] * 7, sides=[1.0] * 3 + [-1.0] * 4)
    assert [b["num_ticks"] for b in rows(B.compute_run_tick_bars(seven, span=10000, initial_ewa_t=6, schema=schema))] == [3, 4]


def test_ewma_moves_by_its_factor():
    spec = BarSpec("run", "tick", Ewma(20, None, 2.0, 0.5))
    fold = Fold(spec)
    closed = [fold.step(i, 1.0, 1.0) for i in range(1)]
    assert closed == [(0, fold.threshold)] and fold.expected_p == (2 / 21) * 1.0 + (19 / 21) * 0.5


def test_session_forces_a_close(spark):
    monday = 1_704_672_000_000  # 2024-01-08
    df = frame(spark, [(monday + 10 * 3_600_000, 1, 1, None), (monday + 17 * 3_600_000, 1, 1, None)])
    assert [b["num_ticks"] for b in rows(B.compute_tick_bars(df, 100, calendar=Session(9, 30, 16, 0)))] == [1]
    day = 86_400_000
    df = frame(spark, [(monday + h, 1, 1, None) for h in (-2 * day, -2 * day + 1, -day, 36_000_000)])
    assert [b["num_ticks"] for b in rows(B.compute_tick_bars(df, 100, calendar=Weekdays()))] == [3]


def test_refused_input(spark):
    with pytest.raises(SchemaError):
        SchemaMapping({"timestamp": "t", "price": "p", "volume": "v", "odd": "o"})
    with pytest.raises(SchemaError):
        B.compute_tick_bars(ticks(spark, [1]), 2, {"timestamp": "t", "price": "p", "volume": "v"})
    with pytest.raises(ValueError):
        B.compute_tick_bars(ticks(spark, [1]), 0)
    with pytest.raises(ThresholdError):
        Ewma(span=0)
    with pytest.raises(Exception, match="TickDataError in price"):
        B.compute_tick_bars(ticks(spark, [1, -1]), 2).collect()


SPECS = [BarSpec("standard", m, Static(t)) for m, t in (("tick", 3.0), ("volume", 5.0), ("dollar", 40.0))] + [
    BarSpec("time", interval_ms=2500), BarSpec("time", interval_ms=2500, anchor="first_tick"), BarSpec("run", "volume", Static(6.0)), BarSpec("standard", "tick", Static(0.0)),
]


@pytest.mark.parametrize("spec", SPECS, ids=str)
def test_closed_form_equals_fold(spark, spec):
    rnd = random.Random(3)
    df = ticks(spark, [rnd.randint(1, 20) for _ in range(300)], [float(rnd.choice((0, 1, 2, 9, 30))) for _ in range(300)], [rnd.choice((1.0, -1.0, None)) for _ in range(300)])
    assert rows(B.build_bars(df, spec)) == rows(B.build_bars(df, spec, exact_parity=True))


def test_chunks_equal_one_scan(spark):
    rnd = random.Random(5)
    df = ticks(spark, [1] * 400, [float(rnd.choice((0, 1, 2, 9, 60))) for _ in range(400)]).withColumnRenamed("volume", "volume").selectExpr("*", "price * volume AS dollar")
    spec = BarSpec("standard", "volume", Static(11.0))
    chunked = {r["timestamp"]: r["bar_id"] for r in closed_form.chunked(df, spec, ["timestamp"], 5).collect()}
    whole = {r["timestamp"]: r["bar_id"] for r in B.assign_bars(df, spec).collect()}
    assert chunked == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9)), max_size=60), st.integers(0, 60), st.sampled_from(["standard", "imbalance", "run"]))
def test_saved_and_resumed_equals_whole(data, cut, family):
    spec = BarSpec(family, "volume", Static(7.0) if family == "standard" else Ewma(5, None, 7.0, 0.5))
    whole, first = BarBuilder(spec), BarBuilder(spec)
    want = [b for i, (p, v) in enumerate(data) for b in whole.update(i, p, v)]
    got = [b for i, (p, v) in enumerate(data[:cut]) for b in first.update(i, p, v)]
    second = BarBuilder.from_state(spec, first.get_state())
    got += [b for i, (p, v) in enumerate(data) for b in second.update(i, p, v)]  # overlap is dropped
    assert got == want


def test_state_must_fit():
    state = BarBuilder(SPECS[0]).get_state()
    with pytest.raises(StateError):
        BarBuilder.from_state(SPECS[1], state)
    with pytest.raises(StateError):
        BarBuilder.from_state(SPECS[0], state, stream_id="other")


def test_batch_equals_updates(spark):
    rnd = random.Random(9)
    data = [(rnd.randint(1, 9), float(rnd.randint(0, 9))) for _ in range(200)]
    for spec in (BarSpec("imbalance", "volume", Ewma(20, None, 8.0, 0.5)), BarSpec("run", "tick", Ewma(20, None, 4.0, 0.5), warmup_bars=2, min_run_length=2)):
        builder = BarBuilder(spec)
        want = [b for i, (p, v) in enumerate(data) for b in builder.update(i * 1000, float(p), v)]
        assert rows(B.build_bars(ticks(spark, *map(list, zip(*data, strict=True))), spec)) == want


@pytest.mark.parametrize("calendar", [None, Session(0, 2, 0, 5)])
def test_stream_equals_batch(spark, tmp_path, calendar):
    from barspark.streaming.bars import stream_bars

    df = sample(spark).selectExpr("timestamp % 2 AS sym", "*").selectExpr("CAST(timestamp / 1000 AS LONG) % 2 AS sym", "timestamp", "price", "volume")
    df.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.parquet(str(tmp_path / "in"))
    spec = BarSpec("standard", "volume", Static(40.0))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(source, spec, key=["sym"], calendar=calendar).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r["sym"], r["bar_id"])
    got = sorted((r.asDict() for r in spark.table("streamed").collect()), key=key)
    want = sorted((r.asDict() for r in B.build_bars(df, spec, key=["sym"], calendar=calendar).collect()), key=key)
    assert got == want and got


def test_resumed_run_keeps_its_order(spark):
    from barspark.streaming.bars import resumable_bars

    df = sample(spark).selectExpr("1 AS sym", "timestamp", "price", "volume", "timestamp AS arrival")
    spec, options = BarSpec("standard", "tick", Static(7)), {"key": "sym", "order": ["arrival"], "watermark_key": None, "strict_ordering": True}
    first = resumable_bars(df.where("timestamp >= 9000"), spec, **options)
    states = first.where("state is not null").select("sym", "state")
    with pytest.raises(Exception, match="timestamp 0 after 499000"):
        resumable_bars(df.where("timestamp < 9000"), spec, states, **options).collect()


def test_resumed_run_holds_one_batch(spark):
    from barspark.streaming.bars import resumable_bars

    df = spark.range(3000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id % 3 END AS sym", "id * 10 AS timestamp", "id % 7 + 1.0D AS price", "1.0D AS volume")
    spec, options = BarSpec("standard", "tick", Static(7)), {"key": "sym"}
    whole = B.build_bars(df, spec, key=["sym"])
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "11")
    try:
        first = resumable_bars(df.where("timestamp <= 14000"), spec, **options)
        assert "CoGroup" not in first._jdf.queryExecution().toString()  # a cogroup holds all rows of a key at a time
        second = resumable_bars(df.where("timestamp > 9000"), spec, first, **options)
        got = first.where("state is null").union(second.where("state is null")).drop("state").select(whole.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect())) and whole.count() == 428
        assert second.where("state is not null").count() == 4
    finally:
        spark.conf.set(conf, before)


def test_calibration(spark):
    df = ticks(spark, [10] * 10, [100] * 10)
    value = lambda kind, n: calibrate.fixed_threshold(df, kind, n).first()["threshold"]
    assert (value("tick", 2), value("volume", 5), value("dollar", 2)) == (5.0, 200.0, 5000.0)
    assert set(calibrate.ewma_seeds(df, "run", target_bars=5).first().asDict()) == {"initial_t", "initial_proportion"}


def test_quality(spark):
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12 and abs(chi2_sf(18.307038053275146, 10) - 0.05) < 1e-12
    bars = B.compute_tick_bars(ticks(spark, [100 + (i * 7) % 5 for i in range(100)]), 1)
    r = quality.quality_report(bars).first()
    assert (r["n_bars"], r["lags"], r["n_days"], r["fraction_fragmented"]) == (100, 10, 1, None) and r["reject_autocorrelation"]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry
    from barspark import registry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.names()) == 10
    with pytest.raises(ValueError):
        registry.register("tick", len)
    with pytest.raises(KeyError):
        registry.get("odd")
