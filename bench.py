"""Headline bar queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The twelve of the published baseline run on the same 250,000 ticks of one
instrument with its parameters (``250k_*``), the costliest of them also on
100 times as many ticks of 400 instruments and on a table where one of 400
instruments holds a third of the rows (``25m_*``, ``skewed_*``), and the engine's
queries over ``events``. Two rounds of warm-up come first.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barspark.model import BarSpec, Ewma, Static
from barspark.operators.bars import build_bars
from barspark.queries import queries
from barspark.sources.ticks import synthetic

EVENTS = ("tick_bars", "volume_bars", "dollar_bars", "time_bars_clock", "imbalance_tick_static", "imbalance_volume_static",
          "imbalance_dollar_static", "run_tick_static", "run_volume_static", "run_dollar_static", "imbalance_tick_ewma", "run_tick_ewma")
BASELINE = {
    "tick": BarSpec("standard", "tick", Static(100)),
    "volume": BarSpec("standard", "volume", Static(5000.0)),
    "dollar": BarSpec("standard", "dollar", Static(250_000.0)),
    "time": BarSpec("time", interval_ms=300_000),
    "imbalance_tick": BarSpec("imbalance", "tick", Static(30)),
    "imbalance_volume": BarSpec("imbalance", "volume", Static(50.0)),
    "imbalance_dollar": BarSpec("imbalance", "dollar", Static(100_000.0)),
    "run_tick": BarSpec("run", "tick", Static(30)),
    "run_volume": BarSpec("run", "volume", Static(2000.0)),
    "run_dollar": BarSpec("run", "dollar", Static(100_000.0)),
    "imbalance_tick_ewma": BarSpec("imbalance", "tick", Ewma(20, None, 5.0, 0.3)),
    "run_tick_ewma": BarSpec("run", "tick", Ewma(20, None, 5.0, 0.5)),
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")

    def stored(name, df):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    one = stored("one", synthetic(spark, 250_000)).cache()
    one.count()
    many = stored("many", synthetic(spark, 62_500, instruments=400))
    third = F.when(F.col("instrument") % 3 == 0, F.lit(0)).otherwise(F.col("instrument"))
    skewed = stored("skewed", synthetic(spark, 6_250, instruments=400).select(third.alias("instrument"), (F.col("timestamp") * 400 + F.col("instrument")).alias("timestamp"), "price", "volume"))
    options = {"key": ["instrument"], "order": ["timestamp"]}
    bars = lambda df, spec: lambda: build_bars(df, spec, **options)
    runs = {f"250k_{n}": bars(one, spec) for n, spec in BASELINE.items()}
    runs |= {n: (lambda f=queries()[n]: f(spark, sf_dir)) for n in EVENTS}
    runs |= {f"25m_{n}": bars(many, BASELINE[n]) for n in ("volume", "imbalance_tick_ewma")}
    runs |= {f"skewed_{n}": bars(skewed, BASELINE[n]) for n in ("volume", "imbalance_tick_ewma")}
    took = {}
    for _ in range(2):  # the baseline is measured warm as well
        for name in BASELINE:
            runs[f"250k_{name}"]().write.format("noop").mode("overwrite").save()
    for name, run in runs.items():
        best = []
        for _ in range(1 if name.startswith("25m") else 3):
            t = time.time()
            run().write.format("noop").mode("overwrite").save()
            best.append(time.time() - t)
        took[name] = round(min(best), 3)
    print(json.dumps({"metric": "bar queries, best of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()
    shutil.rmtree(folder)


if __name__ == "__main__":
    main()
