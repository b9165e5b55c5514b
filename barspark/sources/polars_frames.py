"""Polars frames in and out of the ten bar functions, by Arrow.

``tick_bars(spark, frame, 100)`` and so on take a polars frame and return one.
They are for frames that fit the driver anyway; larger inputs are read by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barspark.operators import bars


def from_polars(spark: SparkSession, frame) -> DataFrame:
    """A polars frame as a DataFrame; its NaN stay NaN, its nulls null."""
    return spark.createDataFrame(frame.to_arrow())


def to_polars(df: DataFrame):
    """A DataFrame as a polars frame, ordered by key and bar."""
    import polars

    return polars.from_arrow(df.toArrow())


def _by_polars(compute: Callable[..., DataFrame]) -> Callable:
    def run(spark: SparkSession, frame, *args, key=(), **options):
        out = compute(from_polars(spark, frame), *args, key=key, **options)
        return to_polars(out.orderBy(*key, "bar_id"))

    run.__name__, run.__doc__ = compute.__name__, f"{compute.__doc__} Polars in and out."
    return run


tick_bars, volume_bars, dollar_bars, time_bars = (_by_polars(f) for f in (bars.compute_tick_bars, bars.compute_volume_bars, bars.compute_dollar_bars, bars.compute_time_bars))
imbalance_tick_bars, imbalance_volume_bars, imbalance_dollar_bars = (_by_polars(getattr(bars, f"compute_imbalance_{m}_bars")) for m in ("tick", "volume", "dollar"))
run_tick_bars, run_volume_bars, run_dollar_bars = (_by_polars(getattr(bars, f"compute_run_{m}_bars")) for m in ("tick", "volume", "dollar"))
