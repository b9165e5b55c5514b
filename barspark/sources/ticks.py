"""Tick tables: files, pandas and Arrow frames, a generator, and views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TICK_DDL = "timestamp long, price double, volume double"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TICK_DDL).csv(path, header=True)


def from_frame(spark: SparkSession, frame) -> DataFrame:
    """A pandas or Arrow frame as a DataFrame; ``DataFrame.toPandas`` and ``toArrow`` lead back."""
    return spark.createDataFrame(frame)


def synthetic(spark: SparkSession, n: int = 250_000, seed: int = 42, instruments: int = 1) -> DataFrame:
    """Seeded random walks on a 100 ms grid: ``instrument, timestamp, price, volume``."""
    rows = spark.range(n * instruments, numPartitions=max(1, instruments)).select(
        (F.col("id") % instruments).alias("instrument"), (F.floor(F.col("id") / instruments) * 100).cast("long").alias("timestamp"),
        (F.randn(seed) * 2e-4).alias("step"), (-F.log(1.0 - F.rand(seed + 1)) * 0.5 + 0.01).alias("volume"),
    )
    walk = W.partitionBy("instrument").orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("instrument", "timestamp", (F.exp(F.sum("step").over(walk)) * 50_000).alias("price"), "volume")


def sample(spark: SparkSession) -> DataFrame:
    """A small deterministic sample: 500 ticks, one a second."""
    i = F.col("id")
    return spark.range(500).select((i * 1000).alias("timestamp"), F.round(100 + 5 * F.sin(i / 17) + 0.01 * (i % 7), 2).alias("price"), (1.0 + (i * 37) % 11).alias("volume"))


def events_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks: price in whole cents, so that sums are exact."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        "user_id", "event_type", F.col("event_id").alias("seq"), F.floor(micros / 1000).cast("long").alias("timestamp"),
        F.round(F.col("value") * 100).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )
