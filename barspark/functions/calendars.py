"""Trading sessions as column predicates on Unix milliseconds (UTC)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barspark.extend import Calendar

DAY = 86_400_000
#: Up to this many sessions are broadcast for the interval join.
MOST_BROADCAST_SESSIONS = 200_000


def _day(ts: Column) -> Column:
    return F.floor(ts / F.lit(DAY)).cast("long")


def _weekday(day: Column) -> Column:
    """0 for Monday; day 0 was a Thursday."""
    return F.pmod(day + 3, F.lit(7))


@dataclass(frozen=True)
class Continuous(Calendar):
    has_sessions = False

    def is_boundary(self, ts: Column) -> Column:
        return F.lit(False)

    def next_open(self, ts: Column) -> Column:
        return ts


@dataclass(frozen=True)
class Session(Calendar):
    """Daily hours ``[start, end)`` on Monday to Friday by the opening day; an end at or before the start is the next day."""

    start_hour: int
    start_minute: int
    end_hour: int
    end_minute: int
    has_sessions = True

    @property
    def _start(self) -> int:
        return (self.start_hour * 60 + self.start_minute) * 60_000

    @property
    def _length(self) -> int:
        end = (self.end_hour * 60 + self.end_minute) * 60_000
        return end - self._start if end > self._start else end - self._start + DAY

    def is_boundary(self, ts: Column) -> Column:
        day, within = _day(ts), F.pmod(ts, F.lit(DAY))
        today = (_weekday(day) < 5) & within.between(self._start, self._start + self._length - 1)
        overnight = (_weekday(day - 1) < 5) & (within + DAY).between(self._start, self._start + self._length - 1)
        return ~(today | overnight)

    def next_open(self, ts: Column) -> Column:
        """The first session opening after ``ts``."""
        opens = [F.when((_weekday(_day(ts) + d) < 5) & ((_day(ts) + d) * DAY + self._start > ts), (_day(ts) + d) * DAY + self._start) for d in range(4)]
        return F.coalesce(*opens)


@dataclass(frozen=True)
class Weekdays(Calendar):
    has_sessions = True

    def is_boundary(self, ts: Column) -> Column:
        return _weekday(_day(ts)) >= 5

    def next_open(self, ts: Column) -> Column:
        """Midnight of the next Monday, also within a week."""
        return (_day(ts) + 7 - _weekday(_day(ts))) * DAY


class Exchange:
    """Sessions of a table ``open_ms, close_ms`` (half-open, not overlapping).

    As a table cannot be a column expression, ticks meet it by ``mark`` and
    ``with_next_open``: an equality join on the day, then a look at that day's
    few sessions.
    """

    has_sessions = True

    def __init__(self, sessions: DataFrame):
        self.sessions = sessions.select(F.col("open_ms").cast("long"), F.col("close_ms").cast("long"))
        n = self.sessions.limit(MOST_BROADCAST_SESSIONS + 1).count()
        self.small = n <= MOST_BROADCAST_SESSIONS

    @classmethod
    def by_code(cls, spark: SparkSession, code: str, start: str | None = None, end: str | None = None) -> Exchange:
        """The sessions of an exchange such as XNYS, from the library ``exchange_calendars`` where it is installed."""
        try:
            import exchange_calendars
        except ImportError as missing:
            raise ImportError("calendars by code need the package exchange_calendars; a table of sessions needs none") from missing
        limits = {k: v for k, v in (("start", start), ("end", end)) if v is not None}
        table = exchange_calendars.get_calendar(code, **limits).schedule
        ms = lambda x: int(x.timestamp() * 1000)
        rows = [(ms(a), ms(b)) for a, b in zip(table["open"], table["close"], strict=True)]
        return cls(spark.createDataFrame(rows, "open_ms long, close_ms long"))

    def _by_day(self, ticks: DataFrame, ts: str, days: DataFrame) -> DataFrame:
        days = F.broadcast(days) if self.small else days
        return ticks.withColumn("__day", _day(F.col(ts))).join(days, "__day", "left")

    def mark(self, ticks: DataFrame, ts: str, name: str) -> DataFrame:
        """``ticks`` with the boundary flag: whether no session is open."""
        days = self.sessions.select("*", F.explode(F.sequence(_day(F.col("open_ms")), _day(F.col("close_ms")))).alias("__day"))
        # one row per day: its sessions, so that a tick meets a single row
        days = days.groupBy("__day").agg(F.collect_list(F.struct("open_ms", "close_ms")).alias("__open"))
        inside = F.coalesce(F.exists("__open", lambda s: (s["open_ms"] <= F.col(ts)) & (F.col(ts) < s["close_ms"])), F.lit(False))
        return self._by_day(ticks, ts, days).withColumn(name, ~inside).drop("__day", "__open")

    def with_next_open(self, ticks: DataFrame, ts: str, name: str) -> DataFrame:
        """``ticks`` with the first opening after ``ts`` (null after the last)."""
        opens = self.sessions.groupBy(_day(F.col("open_ms")).alias("day")).agg(F.collect_set("open_ms").alias("__opens"))
        # each session day stands for itself and the days without one before it
        order = W.orderBy("day")
        opens = opens.select("day", "__opens", F.lag("day").over(order).alias("before"), F.min(F.array_min("__opens")).over(order.rowsBetween(1, W.unboundedFollowing)).alias("__later"))
        first = F.coalesce(F.col("before") + 1, F.least(F.col("day"), F.lit(0)))
        days = opens.select(F.explode(F.sequence(first, F.col("day"))).alias("__day"), "__opens", "__later")
        after = F.array_min(F.filter("__opens", lambda x: x > F.col(ts)))
        return self._by_day(ticks, ts, days).withColumn(name, F.coalesce(after, "__later")).drop("__day", "__opens", "__later")
