"""Bars from ticks or minutes: the planner and the public functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.calendars import Continuous, Exchange
from barspark.model import BAR_COLUMNS, BarSpec, Ewma, SchemaError, Static
from barspark.operators import ticks as T
from barspark.plans import closed_form, sequential


#: A table without key is scanned in chunks, as far as its rule allows, from this estimated size on.
CHUNK_BYTES = 256 << 20


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barspark-"))
    return df.checkpoint()


def _estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the table's size; 0 where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


@dataclass(frozen=True)
class _Plan:
    """Projected ticks, and how their bars are found."""

    rows: DataFrame
    keys: list[str]
    sort: list[str]
    way: sequential.Pass | None  # None: windows
    ordered: bool  # rows are in the order of their timestamps


def _plan(
    df: DataFrame, spec: BarSpec, schema: Mapping[str, str] | None, key: Sequence[str], order: Sequence[str] | None, watermark: str | None,
    after_watermark: int | None, strict_ordering: bool, calendar, validate: str, minutes: bool, exact_parity: bool,
) -> _Plan:
    mapping = T.SchemaMapping(schema, minutes)
    mapping.check(df)
    own_mark = watermark not in (None, "timestamp")
    if own_mark and watermark not in df.columns:
        raise SchemaError(f"no watermark column {watermark!r}")
    stamp = mapping.columns["timestamp"]
    if strict_ordering and (not order or order[0] == stamp):
        raise ValueError("strict ordering needs an order that is not the timestamp's own")
    order = list(order or [stamp, *([watermark] if own_mark else [])])
    rows = T.project(df, mapping, key, order, [watermark] if own_mark else [], validate)
    keys, sort = [f"__in_{c}" for c in key], [f"__in_{c}" for c in order]
    ordered = watermark == "timestamp" or strict_ordering or order[0] == stamp
    calendar = calendar or Continuous()
    if not calendar.has_sessions and closed_form.fits(spec, ordered) and not exact_parity:
        return _Plan(rows, keys, sort, None, ordered)
    signed = spec.family in ("imbalance", "run", "custom")
    derive = ("close" if minutes else "price") if signed and not mapping.has_side else None
    sent = [*keys, "timestamp", *(("open", "high", "low", "close") if minutes else ("price",)), "volume"]
    sent += ["side"] if signed and mapping.has_side else []
    if isinstance(calendar, Exchange):
        rows, sent = calendar.mark(rows, "timestamp", "out"), [*sent, "out"]
    elif calendar.has_sessions:
        rows, sent = rows.withColumn("out", calendar.is_boundary(F.col("timestamp"))), [*sent, "out"]
    if own_mark:
        rows, sent = rows.withColumn("mark", F.col(f"__in_{watermark}").cast("long")), [*sent, "mark"]
    rows = rows.repartition(*keys) if keys else rows.repartition(1)
    rows = rows.sortWithinPartitions(*keys, *sort).select(*sent)
    mark = None if watermark is None else "mark" if own_mark else "timestamp"
    return _Plan(rows, keys, sort, sequential.Pass(spec, tuple(keys), derive, mark, after_watermark, strict_ordering, minutes), ordered)


def _with_values(rows: DataFrame, minutes: bool) -> DataFrame:
    if minutes:
        return rows.withColumn("dollar", F.col("close") * F.col("volume"))
    return rows.withColumns({c: F.col("price") for c in ("open", "high", "low", "close")} | {"dollar": F.col("price") * F.col("volume")})


def _windows(plan: _Plan, spec: BarSpec, watermark: str | None, after_watermark: int | None, strict_ordering: bool, minutes: bool, chunks: int | None) -> DataFrame:
    rows = plan.rows
    mark = None if watermark is None else "timestamp" if watermark == "timestamp" else f"__in_{watermark}"
    if mark and after_watermark is not None:
        rows = rows.where(F.col(mark) > after_watermark)
    rows = _with_values(rows, minutes)
    if not plan.keys and not strict_ordering and chunks != 0 and closed_form.chunks_fit(spec):
        if not chunks and _estimated_bytes(rows) >= CHUNK_BYTES:
            chunks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if chunks:
            return closed_form.chunked(rows, spec, plan.sort, chunks, mark)
    window = T.sequence_window(plan.keys, plan.sort)
    if strict_ordering:
        rows = T.require_order(rows, window)
    if mark:
        rows = T.drop_seen(rows, mark, window)
    return closed_form.assign(rows.withColumn("__seq", F.row_number().over(window).cast("long")), spec, window)


def assign_bars(
    df: DataFrame, spec: BarSpec, schema: Mapping[str, str] | None = None, *, key: Sequence[str] = (), order: Sequence[str] | None = None,
    watermark: str | None = "timestamp", after_watermark: int | None = None, strict_ordering: bool = False, calendar=None,
    validate: str = "lazy", minutes: bool = False, exact_parity: bool = False, chunks: int | None = None,
) -> DataFrame:
    """The ticks that count with ``bar_id``, ``__closed`` (bars closed by this tick) and (sequential) ``__limit``.

    Keys are independent instruments. Rows of a key are taken in the order of
    ``order`` (default: the timestamp, then a custom watermark). Only rows whose
    watermark is above all before it count. Fixed thresholds without sessions are
    windows (a time bar only where rows come in the order of time); a large table
    without key is scanned in range chunks instead, ``chunks`` of them (0: never).
    All else goes through the sequential rule, one key in one task, in one pass.
    """
    plan = _plan(df, spec, schema, key, order, watermark, after_watermark, strict_ordering, calendar, validate, minutes, exact_parity)
    if plan.way:
        return _with_values(sequential.assigned(plan.rows, plan.way), minutes)
    return _windows(plan, spec, watermark, after_watermark, strict_ordering, minutes, chunks)


def _sums(assigned: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each bar's sums and whether it is still open."""
    first, last = (lambda c: F.min_by(c, "__seq")), (lambda c: F.max_by(c, "__seq"))
    return assigned.groupBy(*(F.col(f"__in_{c}") for c in key), "bar_id").agg(
        first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"),
        F.sum("volume").alias("volume"), F.sum("dollar").alias("dollar_value"), F.count(F.lit(1)).alias("num_ticks"),
        first("timestamp").alias("open_ts"), last("timestamp").alias("close_ts"), (F.max("__closed") <= F.col("bar_id")).alias("is_partial"),
    )


def build_bars(
    df: DataFrame, spec: BarSpec, schema: Mapping[str, str] | None = None, *, include_partial: bool = False, key: Sequence[str] = (), order: Sequence[str] | None = None,
    watermark: str | None = "timestamp", after_watermark: int | None = None, strict_ordering: bool = False, calendar=None,
    validate: str = "lazy", minutes: bool = False, exact_parity: bool = False, chunks: int | None = None,
) -> DataFrame:
    """Completed bars (and, if asked, each key's open one): key columns and the 12 bar columns.

    The options are those of ``assign_bars``.
    """
    plan = _plan(df, spec, schema, key, order, watermark, after_watermark, strict_ordering, calendar, validate, minutes, exact_parity)
    if plan.way:
        bars = sequential.bars(plan.rows, plan.way)
    else:
        bars = _sums(_windows(plan, spec, watermark, after_watermark, strict_ordering, minutes, chunks), key)
    bars = bars.select(*(F.col(f"__in_{c}").alias(c) for c in key), *(c for c in bars.columns if not c.startswith("__in_")))
    if spec.warmup_bars:
        bars = bars.where(F.col("bar_id") >= spec.warmup_bars)
    if spec.family == "run" and spec.min_run_length:
        bars = bars.where(F.col("num_ticks") >= spec.min_run_length)
    bars = bars.withColumn("vwap", F.when(F.col("volume") == 0, 0.0).otherwise(F.col("dollar_value") / F.col("volume")))
    bars = bars.withColumn("bar_type", F.lit(spec.bar_type))
    if include_partial:
        return bars.select(*key, *BAR_COLUMNS, "is_partial")
    return bars.where(~F.col("is_partial")).select(*key, *BAR_COLUMNS)


def threshold_trace(
    df: DataFrame, spec: BarSpec, schema: Mapping[str, str] | None = None, *, key: Sequence[str] = (), order: Sequence[str] | None = None,
    watermark: str | None = "timestamp", after_watermark: int | None = None, strict_ordering: bool = False, calendar=None, validate: str = "lazy", minutes: bool = False,
) -> DataFrame:
    """The threshold after each bar that ticks closed: key columns, ``bar_id, threshold_after``."""
    plan = _plan(df, spec, schema, key, order, watermark, after_watermark, strict_ordering, calendar, validate, minutes, True)
    bars = sequential.bars(plan.rows, plan.way).where("threshold_after is not null")
    return bars.select(*(F.col(f"__in_{c}").alias(c) for c in key), "bar_id", "threshold_after")


def order_refusals(df: DataFrame, schema: Mapping[str, str] | None = None, *, key: Sequence[str] = (), order: Sequence[str], validate: str = "lazy") -> DataFrame:
    """Key columns and ``rejected``: whether ``strict_ordering`` would refuse the key's rows in this order."""
    mapping = T.SchemaMapping(schema)
    mapping.check(df)
    rows = T.project(df, mapping, key, order, validate=validate)
    window = T.sequence_window([f"__in_{c}" for c in key], [f"__in_{c}" for c in order])
    late = rows.withColumn("late", F.coalesce(F.col("timestamp") < F.lag("timestamp").over(window), F.lit(False)))
    return late.groupBy(*(F.col(f"__in_{c}").alias(c) for c in key)).agg(F.max("late").alias("rejected"))


def _positive(x: float) -> Static:
    if not x > 0:
        raise ValueError(f"must be positive, got {x}")
    return Static(x)


def compute_tick_bars(df: DataFrame, threshold: int, schema=None, **options) -> DataFrame:
    """Bars of ``threshold`` ticks."""
    return build_bars(df, BarSpec("standard", "tick", _positive(threshold)), schema, **options)


def compute_volume_bars(df: DataFrame, threshold: float, schema=None, **options) -> DataFrame:
    """Bars that close when their volume reaches ``threshold``."""
    return build_bars(df, BarSpec("standard", "volume", _positive(threshold)), schema, **options)


def compute_dollar_bars(df: DataFrame, threshold: float, schema=None, **options) -> DataFrame:
    """Bars that close when their price times volume reaches ``threshold``."""
    return build_bars(df, BarSpec("standard", "dollar", _positive(threshold)), schema, **options)


def compute_time_bars(df: DataFrame, interval_ms: int, schema=None, *, anchor: str = "clock", **options) -> DataFrame:
    """Bars that close at the tick that crosses the next boundary."""
    return build_bars(df, BarSpec("time", interval_ms=interval_ms, anchor=anchor), schema, **options)


def _information(family: str, metric: str, minutes: bool = False):
    def compute(df: DataFrame, span: float = 20, halflife: float | None = None, initial_ewa_t: float = 1.0, initial_ewa_proportion: float = 0.5,
                warmup_bars: int = 0, min_run_length: int = 0, schema=None, **options) -> DataFrame:
        spec = BarSpec(family, metric, Ewma(span, halflife, initial_ewa_t, initial_ewa_proportion), warmup_bars=warmup_bars, min_run_length=min_run_length)
        if minutes:
            options = {"minutes": True, "watermark": None} | options
        return build_bars(df, spec, schema, **options)

    compute.__name__ = f"compute_{family}_{metric}_bars" + "_from_minutes" * minutes
    compute.__doc__ = f"{family.capitalize()} bars over {metric} with a moving threshold" + (" from OHLCV minutes." if minutes else ".")
    return compute


compute_imbalance_tick_bars, compute_imbalance_volume_bars, compute_imbalance_dollar_bars = (_information("imbalance", m) for m in ("tick", "volume", "dollar"))
compute_run_tick_bars, compute_run_volume_bars, compute_run_dollar_bars = (_information("run", m) for m in ("tick", "volume", "dollar"))
compute_imbalance_volume_bars_from_minutes, compute_imbalance_dollar_bars_from_minutes = (_information("imbalance", m, True) for m in ("volume", "dollar"))
compute_run_volume_bars_from_minutes, compute_run_dollar_bars_from_minutes = (_information("run", m, True) for m in ("volume", "dollar"))


def compute_volume_bars_from_minutes(df: DataFrame, threshold: float, schema=None, **options) -> DataFrame:
    """Volume bars from OHLCV minutes; ``num_ticks`` counts minutes."""
    return build_bars(df, BarSpec("standard", "volume", _positive(threshold)), schema, **({"minutes": True, "watermark": None} | options))


def compute_dollar_bars_from_minutes(df: DataFrame, threshold: float, schema=None, **options) -> DataFrame:
    """Dollar bars (close times volume) from OHLCV minutes."""
    return build_bars(df, BarSpec("standard", "dollar", _positive(threshold)), schema, **({"minutes": True, "watermark": None} | options))
