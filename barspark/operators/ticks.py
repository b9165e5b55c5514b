"""From user tables to checked, signed and ordered ticks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barspark.model import MINUTE_REQUIRED, TICK_REQUIRED, SchemaError, TickDataError

OPTIONAL = ("side",)


class SchemaMapping:
    """Column names of a table by field; unknown and missing fields are refused."""

    def __init__(self, mapping: Mapping[str, str] | None, minutes: bool = False):
        required = MINUTE_REQUIRED if minutes else TICK_REQUIRED
        self.columns = dict(mapping) if mapping is not None else {f: f for f in required}
        if unknown := self.columns.keys() - {*required, *OPTIONAL}:
            raise SchemaError(f"unknown fields {sorted(unknown)}")
        if missing := set(required) - self.columns.keys():
            raise SchemaError(f"missing fields {sorted(missing)}")

    def check(self, df: DataFrame) -> None:
        if absent := set(self.columns.values()) - set(df.columns):
            raise SchemaError(f"no columns {sorted(absent)}; the table has {df.columns}")

    @property
    def has_side(self) -> bool:
        return "side" in self.columns


def sequence_window(key: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*key).orderBy(*order)


def _guard(value: Column, bad: Column, what: str) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(value.cast("string"), F.lit("null"))))).otherwise(value)


def _bad_number(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (x == float("inf")) | (x < 0)


def _not_allowed(minutes: bool) -> dict[str, Column]:
    """By column, whether its value is refused."""
    numbers = ("open", "high", "low", "close", "volume") if minutes else ("price", "volume")
    bad = {"timestamp": F.col("timestamp").isNull()} | {f: _bad_number(F.col(f)) for f in numbers}
    bad["side"] = F.col("side").isNotNull() & ~F.col("side").isin(1.0, -1.0)
    if minutes:
        bad["low"] = bad["low"] | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
    return bad


def project(df: DataFrame, mapping: SchemaMapping, key: Sequence[str], order: Sequence[str], extra: Sequence[str] = (), validate: str = "lazy") -> DataFrame:
    """Key, order and extra columns, ``timestamp`` and the mapped numbers as doubles.

    A NaN side becomes null (unknown). ``validate`` is ``lazy`` (a bad row fails
    the job that reads it), ``eager`` (checked now) or ``off``.
    """
    mapping.check(df)
    minutes = "open" in mapping.columns
    numbers = ("open", "high", "low", "close", "volume") if minutes else ("price", "volume")
    col = {f: F.col(c).cast("double") for f, c in mapping.columns.items()}
    side = F.nanvl(col["side"], F.lit(None).cast("double")) if mapping.has_side else F.lit(None).cast("double")
    kept = [c for c in dict.fromkeys([*key, *order, *extra])]
    out = df.select(
        *(F.col(c).alias(f"__in_{c}") for c in kept), F.col(mapping.columns["timestamp"]).cast("long").alias("timestamp"), *(col[f].alias(f) for f in numbers), side.alias("side")
    )
    bad = _not_allowed(minutes)
    if validate == "eager":
        if row := first_invalid(df, mapping, key, order):
            raise TickDataError(f"row not allowed: {row}")
    elif validate == "lazy":
        out = out.select(*(F.col(c) if c not in bad else _guard(F.col(c), bad[c], f"TickDataError in {c}").alias(c) for c in out.columns))
    return out


def first_invalid(df: DataFrame, mapping: SchemaMapping, key: Sequence[str] = (), order: Sequence[str] = ()) -> dict | None:
    """The first row, by key and order, whose values are not allowed, with its number ``row`` (from 0) in its key; or None.

    One pass finds the row, a second counts those before it; one row reaches the driver.
    """
    off = project(df, mapping, key, order, validate="off")
    bad = F.lit(False)
    for x in _not_allowed("open" in mapping.columns).values():
        bad = bad | x
    found = off.where(bad).orderBy(*(f"__in_{c}" for c in (*key, *order))).first()
    if found is None:
        return None
    before = off
    for c in key:
        before = before.where(F.col(f"__in_{c}").eqNullSafe(F.lit(found[f"__in_{c}"])))
    if order:
        at = F.struct(*(F.lit(found[f"__in_{c}"]).cast(off.schema[f"__in_{c}"].dataType) for c in order))
        before = before.where(F.struct(*(f"__in_{c}" for c in order)) < at)
    return {"row": before.count() if order else None} | {c.removeprefix("__in_"): found[c] for c in off.columns}


def derive_sign(df: DataFrame, price: str, window, name: str = "side") -> DataFrame:
    """Tick rule: the sign of the last price change so far; null before the first."""
    change = F.signum(F.col(price) - F.lag(price).over(window))
    moved = df.withColumn("__moved", F.when(change != 0, change))
    return moved.withColumn(name, F.last("__moved", ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0))).drop("__moved")


def drop_seen(df: DataFrame, watermark: str, window, above: int | None = None) -> DataFrame:
    """Rows whose watermark is above all before it (and above a resumed one).

    Accepted rows are exactly the running record highs, so this equals dropping
    each row not above the last accepted.
    """
    if above is not None:
        df = df.where(F.col(watermark) > above)
    before = F.max(watermark).over(window.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(watermark) > F.col("__before"))).drop("__before")


def out_of_order(df: DataFrame, window) -> DataFrame:
    """Rows whose timestamp is below their predecessor's."""
    return df.withColumn("__late", F.col("timestamp") < F.lag("timestamp").over(window)).where("__late").drop("__late")


def require_order(df: DataFrame, window) -> DataFrame:
    """Fail the job at the first timestamp below its predecessor's."""
    late = F.col("timestamp") < F.lag("timestamp").over(window)
    return df.withColumn("timestamp", F.when(late, F.raise_error(F.lit("TickDataError: timestamps out of order"))).otherwise(F.col("timestamp")))


def resample_minutes(df: DataFrame, mapping: Mapping[str, str] | None = None, *, key: Sequence[str] = (), order: Sequence[str] | None = None, interval_ms: int = 60_000) -> DataFrame:
    """OHLCV candles of a fixed length: key columns, ``timestamp`` (start) and the values."""
    m = SchemaMapping(mapping)
    m.check(df)
    c = {f: F.col(n) for f, n in m.columns.items()}
    place = F.struct(*(order or [m.columns["timestamp"]]))
    start = (F.floor(c["timestamp"] / F.lit(interval_ms)) * interval_ms).cast("long")
    return df.groupBy(*key, start.alias("timestamp")).agg(
        F.min_by(c["price"], place).alias("open"), F.max(c["price"]).alias("high"), F.min(c["price"]).alias("low"),
        F.max_by(c["price"], place).alias("close"), F.sum(c["volume"]).alias("volume"),
    )
