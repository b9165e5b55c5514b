"""Statistical quality of bar series, one row per key."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from barspark.functions.chi2 import chi2_sf
from barspark.operators.bars import written

MOST_LAGS = 10


@F.pandas_udf(DoubleType())
def _tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_sf(a, int(b)) for a, b in zip(x, dof, strict=True)], dtype="float64")


def log_returns(bars: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Bars with the finite log return to the bar before (else null)."""
    w = W.partitionBy(*key).orderBy("bar_id")
    r = F.log("close") - F.lag(F.log("close")).over(w)
    return bars.withColumn("log_return", F.when(~F.isnan(r) & (F.abs(r) < float("inf")), r))


def autocorrelation(bars: DataFrame, key: Sequence[str] = (), lags: int | None = None) -> DataFrame:
    """Ljung-Box per key: ``n_returns, lags, lb_statistic, lb_p_value, reject_autocorrelation``."""
    r = log_returns(bars, key).where("log_return is not null").select(*key, "bar_id", "log_return")
    whole, w = W.partitionBy(*key), W.partitionBy(*key).orderBy("bar_id")
    r = r.withColumn("x", F.col("log_return") - F.avg("log_return").over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    most = lags or MOST_LAGS
    for k in range(1, most + 1):
        r = r.withColumn(f"x{k}", F.col("x") * F.lag("x", k).over(w))
    own = r.groupBy(*key).agg(F.first("n").alias("n_returns"), F.sum(F.col("x") * F.col("x")).alias("d"), *(F.sum(f"x{k}").alias(f"c{k}") for k in range(1, most + 1)))
    n = F.col("n_returns")
    default = F.greatest(F.lit(1), F.least(F.lit(MOST_LAGS), F.floor((n + 1) / 5).cast("int")))
    own = own.withColumn("lags", F.least(F.lit(lags) if lags else default, (n - 1).cast("int")))
    rho = lambda k: F.when(F.col("d") > 0, F.coalesce(F.col(f"c{k}"), F.lit(0.0)) / F.col("d")).otherwise(0.0)
    total = F.lit(0.0)
    for k in range(1, most + 1):
        total = total + F.when(F.col("lags") >= k, rho(k) * rho(k) / (n - k)).otherwise(0.0)
    q = F.when(n >= 2, n * (n + 2) * total)
    out = own.withColumn("lb_statistic", q).withColumn("lb_p_value", _tail("lb_statistic", F.greatest(F.lit(1), "lags").cast("double")))
    return out.select(*key, "n_returns", "lags", "lb_statistic", "lb_p_value", (F.col("lb_p_value") < 0.05).alias("reject_autocorrelation"))


def normality(bars: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Jarque-Bera on uncentred moments of the returns; null below four returns."""
    r = log_returns(bars, key).where("log_return is not null")
    m = lambda p: F.avg(F.pow("log_return", F.lit(p)))
    own = r.groupBy(*key).agg(F.count(F.lit(1)).alias("n_returns"), m(2).alias("m2"), m(3).alias("m3"), m(4).alias("m4"))
    skew, kurt = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2"))
    jb = F.when((F.col("n_returns") >= 4) & (F.col("m2") > 0), F.col("n_returns") / 6.0 * (skew * skew + F.pow(kurt - 3.0, F.lit(2.0)) / 4.0))
    out = own.withColumn("jb_statistic", jb).withColumn("jb_p_value", F.exp(-F.col("jb_statistic") / 2.0))
    return out.select(*key, "n_returns", "jb_statistic", "jb_p_value", (F.col("jb_p_value") < 0.05).alias("reject_normality"))


def stability(bars: DataFrame, key: Sequence[str] = (), day_length_ms: int = 86_400_000) -> DataFrame:
    """Bars per day that has any: ``n_days, mean_per_day, std_per_day, cv``, and the counts by day."""
    days = bars.groupBy(*key, F.floor(F.col("open_ts") / F.lit(day_length_ms)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    own = days.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("n").alias("mean_per_day"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std_per_day"),
        F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda s: s["n"]).alias("per_day"),
    )
    return own.withColumn("cv", F.when(F.col("mean_per_day") > 0, F.col("std_per_day") / F.col("mean_per_day")).otherwise(0.0))


def fragmentation(bars: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Share of bars with at most two ticks, if any is a run bar (else null)."""
    own = bars.groupBy(*key).agg(F.avg((F.col("num_ticks") <= 2).cast("double")).alias("f"), F.max(F.startswith("bar_type", F.lit("run_"))).alias("run"))
    return own.select(*key, F.when(F.col("run"), F.col("f")).alias("fraction_fragmented"))


def quality_report(bars: DataFrame, key: Sequence[str] = (), lags: int | None = None, day_length_ms: int = 86_400_000) -> DataFrame:
    """All diagnostics, one row per key.

    The bars are written once, since several aggregates and windows read them.
    """
    bars = written(bars.select(*key, "bar_id", "close", "bar_type", "num_ticks", "open_ts"))
    out = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("n_bars"))
    parts = [autocorrelation(bars, key, lags), normality(bars, key).drop("n_returns"), stability(bars, key, day_length_ms), fragmentation(bars, key)]
    for part in parts:
        out = out.join(part, list(key), "left") if key else out.join(part.withColumn("__one", F.lit(1)), F.lit(1) == F.col("__one"), "left").drop("__one")
    return out
