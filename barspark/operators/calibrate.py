"""Thresholds and moving-average seeds from a tick table, per key."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barspark.functions.fold import Fold
from barspark.model import BarSpec, Static
from barspark.operators import ticks as T


def _metric(metric: str):
    return {"tick": F.lit(1.0), "volume": F.col("volume"), "dollar": F.col("price") * F.col("volume")}[metric]


def _simulate(rows: pa.Table, family: str, metric: str, threshold: float) -> list[tuple[float, float]]:
    """(size, proportion) of the bars that a fixed threshold gives one key's ticks."""
    fold, stats = Fold(BarSpec(family, metric, Static(threshold))), []
    for m, side in zip(rows.column("__metric").to_pylist(), rows.column("side").to_pylist(), strict=True):
        fold._add(0, m, side)
        if fold._full(0, threshold):
            stats.append(fold.stats())
            fold._close(threshold, False)
            if family == "run" and fold.total == 0.0:
                fold.direction = None  # calibration lets the next run take any direction
    return stats


def _guess(rows: pa.Table, family: str, metric: str, target: float) -> tuple[pa.Table, float, float]:
    """One key's ticks in order, their total, and the threshold that one simulation suggests."""
    rows = rows.sort_by("__seq")
    total = 0.0
    for m in rows.column("__metric").to_pylist():
        total += m
    found = len(_simulate(rows, family, metric, total / target))
    return rows, total, total / target * found / target if found else total


def _rows(ticks: DataFrame, family: str, metric: str, key: Sequence[str], order: Sequence[str], schema) -> DataFrame:
    mapping = T.SchemaMapping(schema)
    rows = T.project(ticks, mapping, key, order)
    window = T.sequence_window([f"__in_{c}" for c in key], [f"__in_{c}" for c in order])
    if family in ("imbalance", "run") and not mapping.has_side:
        rows = T.derive_sign(rows, "price", window)
    return rows.select(*(F.col(f"__in_{c}").alias(c) for c in key), F.row_number().over(window).alias("__seq"), _metric(metric).alias("__metric"), "side")


def fixed_threshold(ticks: DataFrame, bar_type: str, target_bars: float, *, key: Sequence[str] = (), order: Sequence[str] = ("timestamp",), schema=None) -> DataFrame:
    """Key columns and the ``threshold`` that gives about ``target_bars`` bars.

    Tick, volume and dollar bars: the total by the target, one aggregate. The
    others: one simulation at that guess, scaled by the bars it gave (the total,
    if none).
    """
    if not target_bars > 0:
        raise ValueError("target_bars must be positive")
    if bar_type in ("tick", "volume", "dollar"):
        m = T.SchemaMapping(schema).columns
        own = ticks.select(*key, *(F.col(m[f]).cast("double").alias(f) for f in ("price", "volume")))
        return own.groupBy(*key).agg((F.sum(_metric(bar_type)) / F.lit(float(target_bars))).alias("threshold"))
    family, _, metric = bar_type.partition("_")
    if family not in ("imbalance", "run") or metric not in ("tick", "volume", "dollar"):
        raise ValueError(f"no threshold for bar type {bar_type!r}")

    def run(keys: tuple, rows: pa.Table) -> pa.Table:
        _, _, value = _guess(rows, family, metric, target_bars)
        return pa.table([*(pa.array([k.as_py()], k.type) for k in keys[: len(key)]), pa.array([value])], names=[*key, "threshold"])

    return _grouped(_rows(ticks, family, metric, key, order, schema), key, run, ("threshold",))


def ewma_seeds(ticks: DataFrame, family: str, metric: str = "tick", span: float = 20, target_bars: int = 50, *, key: Sequence[str] = (), order: Sequence[str] = ("timestamp",), schema=None) -> DataFrame:
    """Key columns, ``initial_t`` and ``initial_proportion`` for a moving threshold."""
    if family not in ("imbalance", "run"):
        raise ValueError(f"unknown family {family!r}")
    a = 2.0 / (span + 1.0)

    def run(keys: tuple, rows: pa.Table) -> pa.Table:
        rows, total, level = _guess(rows, family, metric, target_bars)
        stats = _simulate(rows, family, metric, level) or [(total, 0.5)]
        t, p = stats[0]
        for x, y in stats[1:]:
            t, p = a * x + (1.0 - a) * t, a * y + (1.0 - a) * p
        return pa.table([*(pa.array([k.as_py()], k.type) for k in keys[: len(key)]), pa.array([t]), pa.array([p])], names=[*key, "initial_t", "initial_proportion"])

    return _grouped(_rows(ticks, family, metric, key, order, schema), key, run, ("initial_t", "initial_proportion"))


def _grouped(rows: DataFrame, key: Sequence[str], run, names: Sequence[str]) -> DataFrame:
    kinds = StructType([*(rows.schema[k] for k in key), *(StructField(n, DoubleType()) for n in names)])
    grouped = rows.groupBy(*key) if key else rows.groupBy(F.lit(0).alias("__all"))
    return grouped.applyInArrow(run, kinds)


def convergence(trace: DataFrame, key: Sequence[str] = (), value: str = "threshold_after", window: int = 20, tolerance: float = 0.1) -> DataFrame:
    """First bar whose value is within ``tolerance`` of the mean of the ``window`` before."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*key).orderBy("bar_id").rowsBetween(-window, -1)
    near = trace.withColumn("mean", F.avg(value).over(w)).withColumn("seen", F.count(F.lit(1)).over(w))
    near = near.where((F.col("seen") == window) & (F.abs(F.col(value) - F.col("mean")) < tolerance * F.abs("mean")))
    return near.groupBy(*key).agg(F.min("bar_id").alias("converged_at"))
