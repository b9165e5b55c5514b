"""Bars as a table function, so that SQL can build them.

``register_bars(spark, "volume_bars", spec)`` and then::

    SELECT * FROM volume_bars(TABLE(SELECT sym, ts AS timestamp, px AS price, qty AS volume FROM trades) PARTITION BY sym ORDER BY timestamp)

Each partition is one instrument, in the order given. Rows come one by one, so
this is the slow way in; ``build_bars`` is the fast one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from barspark.functions.fold import BarBuilder
from barspark.model import BAR_COLUMNS, BAR_DDL, BarSpec


def register_bars(spark: SparkSession, name: str, spec: BarSpec, *, key: str = "sym", key_type: str = "string", watermark: bool = True) -> None:
    """Make a table function of a spec; its table argument has ``key, timestamp, price, volume`` and maybe ``side``.

    Rows: ``key`` and the 12 bar columns of each completed bar. Without
    ``watermark``, rows at or below the last timestamp count as well.
    """

    class Bars:
        def __init__(self):
            self.builder = BarBuilder(spec, watermark_key="timestamp" if watermark else None)

        def eval(self, row):
            names = row.__fields__
            side = row["side"] if "side" in names else None
            for b in self.builder.update(int(row["timestamp"]), float(row["price"]), float(row["volume"]), side):
                yield (row[key], *(b[c] for c in BAR_COLUMNS))

    spark.udtf.register(name, udtf(Bars, returnType=f"`{key}` {key_type}, {BAR_DDL}"))
