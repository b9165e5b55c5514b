"""The engine's operators as queries over the test tables, with DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.calendars import Exchange, Session, Weekdays
from barspark.model import BarSpec, Ewma, Static
from barspark.operators import bars as B
from barspark.operators import calibrate, quality
from barspark.operators import ticks as T
from barspark.sources.ticks import events_ticks
from barspark.streaming.bars import resumable_bars, stream_bars

KEY = ("user_id",)
OPTIONS = {"key": KEY, "order": ("timestamp", "seq")}
HOUR = 3_600_000

TICKS_SQL = """raw AS (
  SELECT user_id, event_id AS seq, epoch_us(ts) // 1000 AS timestamp, round(value * 100) AS price,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events),
signed AS (
  SELECT *, sign(price - lag(price) OVER w) AS step FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, seq)),
kept AS (
  SELECT * FROM (
    SELECT *, last_value(CASE WHEN step <> 0 THEN step::DOUBLE END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS side,
      max(timestamp) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM signed WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, seq))
  WHERE top IS NULL OR timestamp > top),
t AS (SELECT *, price * volume AS dollar, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, seq) AS i FROM kept)"""

BARS_SQL = """SELECT user_id, bar_id::BIGINT AS bar_id, arg_min(price, i) AS open, max(price) AS high, min(price) AS low, arg_max(price, i) AS close,
  sum(volume) AS volume, sum(dollar) AS dollar_value, CASE WHEN sum(volume) = 0 THEN 0.0::DOUBLE ELSE sum(dollar) / sum(volume) END AS vwap,
  count(*) AS num_ticks, arg_min(timestamp, i) AS open_ts, arg_max(timestamp, i) AS close_ts, '{label}' AS bar_type
FROM b GROUP BY user_id, bar_id HAVING {having}"""


def _closed_sql(could: str, label: str, having: str = "max(k) > bar_id") -> str:
    return f"""WITH {TICKS_SQL},
f AS (SELECT *, ({could}) - i AS slack FROM t WINDOW u AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, i + least(0, min(slack) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS k FROM f),
b AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY user_id ORDER BY i), 0) AS bar_id FROM c)
""" + BARS_SQL.format(label=label, having=having)


def _metric_sql(metric: str) -> str:
    return {"tick": "1.0::DOUBLE", "volume": "t.volume", "dollar": "t.dollar"}[metric]


def _imbalance_sql(metric: str, limit: str, t0: float, p0: float, label: str, warm: int = 0, a: str = "(2.0::DOUBLE / 21.0::DOUBLE)", source: str = TICKS_SQL) -> str:
    return f"""WITH RECURSIVE {source},
r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS mine, 0::BIGINT AS bar, 0.0::DOUBLE AS sg, 0.0::DOUBLE AS own, {t0}::DOUBLE AS et, {p0}::DOUBLE AS ep FROM t
  UNION ALL
  SELECT user_id, i, bar, bar + hit::BIGINT, CASE WHEN hit THEN sign(sg) * greatest(0.0::DOUBLE, abs(sg) - lim) ELSE sg END, CASE WHEN hit THEN 0.0::DOUBLE ELSE own END,
    CASE WHEN hit THEN {a} * own + (1.0::DOUBLE - {a}) * et ELSE et END,
    CASE WHEN hit THEN {a} * (CASE WHEN own = 0 THEN 0.0::DOUBLE ELSE sg / own END) + (1.0::DOUBLE - {a}) * ep ELSE ep END
  FROM (SELECT *, abs(sg) >= lim AS hit FROM (
    SELECT r.user_id, t.i, r.bar, r.sg + coalesce(t.side, 0.0::DOUBLE) * {_metric_sql(metric)} AS sg, r.own + {_metric_sql(metric)} AS own, et, ep, {limit} AS lim
    FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1))),
b AS (SELECT t.*, r.mine AS bar_id, r.bar AS k FROM t JOIN r ON r.user_id = t.user_id AND r.i = t.i)
""" + BARS_SQL.format(label=label, having=f"max(k) > bar_id AND bar_id >= {warm}")


def _run_sql(metric: str, t0: float, p0: float, label: str, least: int = 0, source: str = TICKS_SQL) -> str:
    """One total, and its parts by direction; a carried rest and a tick without side go the last known way."""
    a = "(2.0::DOUBLE / 21.0::DOUBLE)"
    m = _metric_sql(metric)
    return f"""WITH RECURSIVE {source},
r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS mine, 0::BIGINT AS bar, 0.0::DOUBLE AS total, 0.0::DOUBLE AS buys, 0.0::DOUBLE AS sells, NULL::DOUBLE AS way,
    {t0}::DOUBLE AS et, {p0}::DOUBLE AS ep FROM t
  UNION ALL
  SELECT user_id, i, bar, bar + hit::BIGINT, CASE WHEN hit THEN rest ELSE total END,
    CASE WHEN NOT hit THEN buys WHEN way > 0 THEN rest ELSE 0.0::DOUBLE END, CASE WHEN NOT hit THEN sells WHEN way < 0 THEN rest ELSE 0.0::DOUBLE END, way,
    CASE WHEN hit THEN {a} * total + (1.0::DOUBLE - {a}) * et ELSE et END,
    CASE WHEN hit THEN {a} * (CASE WHEN buys + sells > 0 THEN buys / (buys + sells) ELSE 0.5::DOUBLE END) + (1.0::DOUBLE - {a}) * ep ELSE ep END
  FROM (SELECT *, total >= lim AS hit, greatest(0.0::DOUBLE, total - lim) AS rest FROM (
    SELECT r.user_id, t.i, r.bar, total + {m} AS total, now AS way,
      buys + CASE WHEN now > 0 THEN {m} + first ELSE 0.0::DOUBLE END AS buys, sells + CASE WHEN now < 0 THEN {m} + first ELSE 0.0::DOUBLE END AS sells,
      et, ep, et * greatest(ep, 1.0::DOUBLE - ep) AS lim
    FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1, LATERAL (SELECT coalesce(t.side, way) AS now, CASE WHEN way IS NULL THEN total ELSE 0.0::DOUBLE END AS first)))),
b AS (SELECT t.*, r.mine AS bar_id, r.bar AS k FROM t JOIN r ON r.user_id = t.user_id AND r.i = t.i)
""" + BARS_SQL.format(label=label, having=f"max(k) > bar_id AND count(*) >= {least}")


def _before_bars(sql: str) -> str:
    """The common tables of a recursive query, without its bars."""
    return sql.split("\nb AS (")[0].rstrip().rstrip(",")


HOURS_SQL = "NOT ((timestamp // 86400000 + 3) % 7 < 5 AND timestamp % 86400000 >= 34200000 AND timestamp % 86400000 < 57600000)"
WEEKEND_SQL = "(timestamp // 86400000 + 3) % 7 >= 5"

# a forced close leaves no ticks behind, so every stretch of session or after-hours counts from its start
TICK_SESSION_SQL = f"""WITH {TICKS_SQL},
o AS (SELECT *, {HOURS_SQL} AS shut FROM t),
s AS (SELECT *, coalesce(shut <> lag(shut) OVER (PARTITION BY user_id ORDER BY i), false)::INT AS turn FROM o),
g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS stretch FROM s),
j AS (SELECT *, (row_number() OVER (PARTITION BY user_id, stretch ORDER BY i) - 1) // 10 AS part, max(stretch) OVER (PARTITION BY user_id) AS latest FROM g),
b AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY stretch, part) - 1 AS bar_id FROM j)
""" + BARS_SQL.format(label="tick", having="max(stretch) < max(latest) OR count(*) = 10")

VOLUME_SESSION_SQL = f"""WITH RECURSIVE {TICKS_SQL},
o AS (SELECT *, {WEEKEND_SQL} AS shut FROM t),
r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS mine, 0::BIGINT AS bar, 0.0::DOUBLE AS total, false AS filled, false AS was FROM t
  UNION ALL
  SELECT user_id, i, bar, bar + (total >= 500)::BIGINT, total - CASE WHEN total >= 500 THEN 500 ELSE 0 END, total < 500, shut
  FROM (
    SELECT r.user_id, o.i, r.bar + forced::BIGINT AS bar, r.total - CASE WHEN forced THEN 500 ELSE 0 END + o.volume AS total, o.shut
    FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1, LATERAL (SELECT filled AND o.shut <> was AS forced))),
b AS (SELECT t.*, r.mine AS bar_id, max(r.bar) OVER (PARTITION BY r.user_id) AS k FROM t JOIN r ON r.user_id = t.user_id AND r.i = t.i)
""" + BARS_SQL.format(label="volume", having="max(k) > bar_id")

CONVERGENCE_SQL = _before_bars(_imbalance_sql("tick", "et * abs(ep)", 4.0, 0.5, "")) + """,
trace AS (SELECT user_id, mine AS bar_id, et * abs(ep) AS v FROM r WHERE bar > mine),
near AS (SELECT *, avg(v) OVER w AS m, count(*) OVER w AS n FROM trace
  WINDOW w AS (PARTITION BY user_id ORDER BY bar_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT user_id, min(bar_id) AS converged_at FROM near WHERE n = 20 AND abs(v - m) < 0.1 * abs(m) GROUP BY user_id"""

CALIBRATION_TICKS_SQL = TICKS_SQL.split("kept AS")[0] + """t0 AS (
  SELECT *, price * volume AS dollar, row_number() OVER w AS i,
    last_value(CASE WHEN step <> 0 THEN step::DOUBLE END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS side
  FROM signed WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, seq)),
t AS (SELECT t0.*, {m} AS m, sum({m}) OVER (PARTITION BY user_id) AS whole FROM t0)"""


def _simulation_sql(name: str, family: str, limit: str, ticks: str = "t") -> str:
    """Recursion over ticks at a limit per user: a row per tick, with size and proportion where a bar closes.

    A run's rest of 0 lets the next run take any direction.
    """
    if family == "imbalance":
        total, full, size, share = "r.total + coalesce(t.side, 0.0::DOUBLE) * t.m", "abs(total) >= lim", "own", "CASE WHEN own = 0 THEN 0.0::DOUBLE ELSE total / own END"
        rest = "sign(total) * greatest(0.0::DOUBLE, abs(total) - lim)"
    else:
        total, full, size, share = "r.total + t.m", "total >= lim", "total", "CASE WHEN buys + sells > 0 THEN buys / (buys + sells) ELSE 0.5::DOUBLE END"
        rest = "greatest(0.0::DOUBLE, total - lim)"
    return f"""{name} AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS bar, 0.0::DOUBLE AS total, 0.0::DOUBLE AS own, 0.0::DOUBLE AS buys, 0.0::DOUBLE AS sells, NULL::DOUBLE AS way,
    NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM {ticks}
  UNION ALL
  SELECT user_id, i, bar + hit::BIGINT, CASE WHEN hit THEN rest ELSE total END, CASE WHEN hit THEN 0.0::DOUBLE ELSE own END,
    CASE WHEN NOT hit THEN buys WHEN way > 0 THEN rest ELSE 0.0::DOUBLE END, CASE WHEN NOT hit THEN sells WHEN way < 0 THEN rest ELSE 0.0::DOUBLE END,
    CASE WHEN hit AND rest = 0 THEN NULL ELSE way END, CASE WHEN hit THEN {size} END, CASE WHEN hit THEN {share} END
  FROM (SELECT *, {full} AS hit, {rest} AS rest FROM (
    SELECT r.user_id, t.i, r.bar, {total} AS total, r.own + t.m AS own, now AS way,
      buys + CASE WHEN now > 0 THEN t.m + first ELSE 0.0::DOUBLE END AS buys, sells + CASE WHEN now < 0 THEN t.m + first ELSE 0.0::DOUBLE END AS sells, {limit} AS lim
    FROM {name} r JOIN {ticks} t ON t.user_id = r.user_id AND t.i = r.i + 1,
      LATERAL (SELECT coalesce(t.side, r.way) AS now, CASE WHEN r.way IS NULL THEN r.total ELSE 0.0::DOUBLE END AS first))))"""


def _ticks_for(metric: str) -> str:
    return CALIBRATION_TICKS_SQL.replace("{m}", {"tick": "1.0::DOUBLE", "volume": "t0.volume", "dollar": "t0.dollar"}[metric])


def _calibration_sql(family: str, metric: str, target: int = 10) -> str:
    return f"""WITH RECURSIVE {_ticks_for(metric)},
{_simulation_sql("g", family, f"t.whole / {target}.0::DOUBLE")}
SELECT user_id, CASE WHEN max(bar) > 0 THEN whole / {target} * max(bar) / {target} ELSE whole END AS threshold
FROM g JOIN (SELECT DISTINCT user_id, whole FROM t) USING (user_id) GROUP BY user_id, whole"""


def _seeds_sql(family: str, target: int = 5) -> str:
    a = "(2.0::DOUBLE / 21.0::DOUBLE)"
    return f"""WITH RECURSIVE {_ticks_for("tick")},
{_simulation_sql("g", family, f"t.whole / {target}.0::DOUBLE")},
level AS (SELECT user_id, whole, CASE WHEN max(bar) > 0 THEN whole / {target} * max(bar) / {target} ELSE whole END AS lvl
  FROM g JOIN (SELECT DISTINCT user_id, whole FROM t) USING (user_id) GROUP BY user_id, whole),
t2 AS (SELECT t.*, level.lvl FROM t JOIN level USING (user_id)),
{_simulation_sql("h", family, "t.lvl", "t2")},
bars AS (SELECT user_id, bar, x, y FROM h WHERE x IS NOT NULL),
e AS (
  SELECT user_id, bar, x, y FROM bars WHERE bar = 1
  UNION ALL
  SELECT e.user_id, b.bar, {a} * b.x + (1.0::DOUBLE - {a}) * e.x, {a} * b.y + (1.0::DOUBLE - {a}) * e.y FROM e JOIN bars b ON b.user_id = e.user_id AND b.bar = e.bar + 1)
SELECT l.user_id, coalesce(arg_max(e.x, e.bar), any_value(l.whole)) AS initial_t, coalesce(arg_max(e.y, e.bar), 0.5::DOUBLE) AS initial_proportion
FROM level l LEFT JOIN e ON e.user_id = l.user_id GROUP BY l.user_id"""


# an order in which timestamps fall now and then
SHUFFLED = 7919, 10_007
SHUFFLED_SQL = f"""raw AS (
  SELECT user_id, event_id AS seq, epoch_us(ts) // 1000 AS timestamp, round(value * 100) AS price,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, (event_id * {SHUFFLED[0]}) % {SHUFFLED[1]} AS place FROM events),
t AS (SELECT *, price * volume AS dollar, row_number() OVER (PARTITION BY user_id ORDER BY place, seq) AS i FROM raw)"""
TIME_UNORDERED_SQL = f"""WITH RECURSIVE {SHUFFLED_SQL},
r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS mine, 0::BIGINT AS bar, NULL::BIGINT AS edge FROM t
  UNION ALL
  SELECT user_id, i, bar, bar + (ts >= edge)::BIGINT, edge + CASE WHEN ts >= edge THEN {24 * HOUR} ELSE 0 END
  FROM (SELECT r.user_id, t.i, r.bar, t.timestamp AS ts, coalesce(r.edge, t.timestamp // {24 * HOUR} * {24 * HOUR} + {24 * HOUR}) AS edge
    FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1)),
b AS (SELECT t.*, r.mine AS bar_id, r.bar AS k FROM t JOIN r ON r.user_id = t.user_id AND r.i = t.i)
""" + BARS_SQL.format(label="time", having="max(k) > bar_id")

STRICT_SQL = f"""WITH {SHUFFLED_SQL},
w AS (SELECT user_id, timestamp < lag(timestamp) OVER (PARTITION BY user_id ORDER BY i) AS late FROM t)
SELECT user_id, count(*) FILTER (WHERE late) AS n_late, coalesce(bool_or(late), false) AS rejected FROM w GROUP BY user_id"""

GIVEN_SIDES_SQL = TICKS_SQL.replace("CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)",
    "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS given FROM events)",
).replace("last_value(CASE WHEN step <> 0 THEN step::DOUBLE END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS side", "given AS side")

INVALID_SQL = f"""WITH {TICKS_SQL.split("signed AS")[0].rstrip().rstrip(",")},
n AS (SELECT *, row_number() OVER (ORDER BY timestamp, seq) - 1 AS row FROM raw)
SELECT row::BIGINT AS row, seq, price - 200 AS price FROM n WHERE price - 200 < 0 ORDER BY row LIMIT 1"""

# sessions of a table: every third day from 10:00 to 14:00
EXCHANGE_SQL = f"""WITH raw AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS timestamp FROM events),
days AS (SELECT DISTINCT unnest(range((SELECT min(timestamp) // 86400000 FROM raw), (SELECT max(timestamp) // 86400000 + 1 FROM raw))) AS d),
s AS (SELECT d * 86400000 + 10 * {HOUR} AS open_ms, d * 86400000 + 14 * {HOUR} AS close_ms FROM days WHERE d % 3 = 0)
SELECT seq, NOT EXISTS (SELECT 1 FROM s WHERE open_ms <= timestamp AND timestamp < close_ms) AS shut,
  coalesce((SELECT min(open_ms) FROM s WHERE open_ms > timestamp), -1)::BIGINT AS next_open FROM raw"""

NEXT_OPEN_SQL = f"""WITH raw AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS timestamp FROM events),
o AS (SELECT seq, timestamp, unnest(range(timestamp // 86400000, timestamp // 86400000 + 8)) AS d FROM raw)
SELECT seq, min(d * 86400000 + 34200000) FILTER (WHERE (d + 3) % 7 < 5 AND d * 86400000 + 34200000 > timestamp)::BIGINT AS session,
  min(d * 86400000) FILTER (WHERE (d + 3) % 7 = 0 AND d > timestamp // 86400000)::BIGINT AS weekday FROM o GROUP BY seq"""

# all diagnostics of the tick bars of each event type; four lags, so that the chi-squared tail has a closed form
TYPE_BARS_SQL = f"""raw AS (SELECT event_type, event_id AS seq, epoch_us(ts) // 1000 AS timestamp, round(value * 100) + 1 AS price FROM events),
top AS (SELECT *, max(timestamp) OVER (PARTITION BY event_type ORDER BY timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY timestamp, seq) - 1 AS i FROM top WHERE top IS NULL OR timestamp > top),
bars AS (SELECT event_type, i // 10 AS bar_id, arg_max(price, i) AS close, arg_min(timestamp, i) AS open_ts, count(*) AS num_ticks FROM k GROUP BY event_type, i // 10 HAVING count(*) = 10)"""
REPORT_SQL = f"""WITH {TYPE_BARS_SQL},
r AS (SELECT event_type, bar_id, ln(close) - lag(ln(close)) OVER (PARTITION BY event_type ORDER BY bar_id) AS x FROM bars),
x AS (SELECT event_type, bar_id, x, x - avg(x) OVER (PARTITION BY event_type) AS c FROM r WHERE x IS NOT NULL),
l AS (SELECT *, {", ".join(f"c * lag(c, {k}) OVER (PARTITION BY event_type ORDER BY bar_id) AS c{k}" for k in range(1, 5))} FROM x),
s AS (SELECT event_type, count(*) AS n, sum(c * c) AS d, {", ".join(f"sum(c{k}) AS c{k}" for k in range(1, 5))}, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM l GROUP BY event_type),
q AS (SELECT *, n * (n + 2) * ({" + ".join(f"(c{k} / d) * (c{k} / d) / (n - {k})" for k in range(1, 5))}) AS lb,
  n / 6.0::DOUBLE * (m3 * m3 / (m2 * m2 * m2) + (m4 / (m2 * m2) - 3) * (m4 / (m2 * m2) - 3) / 4) AS jb FROM s),
days AS (SELECT event_type, open_ts // {24 * HOUR} AS dy, count(*) AS n FROM bars GROUP BY ALL),
st AS (SELECT event_type, count(*) AS n_days, avg(n) AS mean_per_day, stddev_samp(n) AS std_per_day FROM days GROUP BY event_type),
nb AS (SELECT event_type, count(*) AS n_bars FROM bars GROUP BY event_type)
SELECT event_type, n_bars, n AS n_returns, 4::INTEGER AS lags, round(lb, 6) AS lb_statistic, round(exp(-lb / 2) * (1 + lb / 2), 6) AS lb_p_value,
  exp(-lb / 2) * (1 + lb / 2) < 0.05 AS reject_autocorrelation, round(jb, 6) AS jb_statistic, round(exp(-jb / 2), 6) AS jb_p_value, exp(-jb / 2) < 0.05 AS reject_normality,
  n_days, round(mean_per_day, 6) AS mean_per_day, round(coalesce(std_per_day, 0), 6) AS std_per_day, round(coalesce(std_per_day, 0) / mean_per_day, 6) AS cv, NULL::DOUBLE AS fraction_fragmented
FROM q JOIN st USING (event_type) JOIN nb USING (event_type)"""


def _bars(spec: BarSpec, **more) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: B.build_bars(events_ticks(spark, d), spec, **OPTIONS, **more)


def _volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.compute_volume_bars(events_ticks(spark, sf_dir), 500, **OPTIONS)


def _tick_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ticks(spark, sf_dir)
    return T.derive_sign(rows, "price", T.sequence_window(KEY, ("timestamp", "seq"))).select("user_id", "seq", "side")


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ticks(spark, sf_dir).withColumn("mark", F.floor(F.col("timestamp") / HOUR).cast("long"))
    return T.drop_seen(rows, "mark", T.sequence_window(KEY, ("timestamp", "seq"))).select("user_id", "seq", "mark")


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.resample_minutes(events_ticks(spark, sf_dir), key=KEY, order=("timestamp", "seq"), interval_ms=24 * HOUR)


MINUTES_SQL = f"""raw AS (
  SELECT user_id, event_id AS seq, epoch_us(ts) // 1000 AS timestamp, round(value * 100) AS price,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events),
minutes AS (
  SELECT user_id, timestamp // {24 * HOUR} * {24 * HOUR} AS timestamp, arg_min(price, (timestamp, seq)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (timestamp, seq)) AS close, sum(volume) AS volume FROM raw GROUP BY ALL)"""


def _minute_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.compute_volume_bars_from_minutes(_minutes(spark, sf_dir), 500, key=KEY)


MINUTE_VOLUME_SQL = f"""WITH {MINUTES_SQL},
t AS (SELECT *, close * volume AS dollar, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) AS i FROM minutes),
f AS (SELECT *, floor(sum(volume) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) / 500)::BIGINT - i AS slack FROM t),
c AS (SELECT *, i + least(0, min(slack) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS k FROM f),
b AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY user_id ORDER BY i), 0) AS bar_id FROM c)
SELECT user_id, bar_id::BIGINT AS bar_id, arg_min(open, i) AS open, max(high) AS high, min(low) AS low, arg_max(close, i) AS close,
  sum(volume) AS volume, sum(dollar) AS dollar_value, CASE WHEN sum(volume) = 0 THEN 0.0::DOUBLE ELSE sum(dollar) / sum(volume) END AS vwap,
  count(*) AS num_ticks, arg_min(timestamp, i) AS open_ts, arg_max(timestamp, i) AS close_ts, 'volume' AS bar_type
FROM b GROUP BY user_id, bar_id HAVING max(k) > bar_id"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hours, week = events_ticks(spark, sf_dir), Session(9, 30, 16, 0), Weekdays()
    return rows.select("seq", hours.is_boundary(F.col("timestamp")).alias("after_hours"), week.is_boundary(F.col("timestamp")).alias("weekend"))


SESSIONS_SQL = """SELECT event_id AS seq,
  NOT (isodow(ts) <= 5 AND (epoch_us(ts) // 1000) % 86400000 >= 34200000 AND (epoch_us(ts) // 1000) % 86400000 < 57600000) AS after_hours,
  isodow(ts) > 5 AS weekend FROM events"""


def _resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a run that stops, saves its bars and state, and goes on with overlapping input."""
    rows = events_ticks(spark, sf_dir).select("user_id", "timestamp", "seq", "price", "volume")
    cut = rows.agg(F.percentile_approx("timestamp", 0.5).alias("t")).first()["t"] or 0
    spec, options = BarSpec("standard", "volume", Static(500.0)), {"key": "user_id", "order": ("timestamp", "seq")}
    first, path = resumable_bars(rows.where(F.col("timestamp") <= cut), spec, **options), f"{_scratch(spark)}/resume-{uuid.uuid4().hex}"
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    second = resumable_bars(rows.where(F.col("timestamp") > cut - 5 * HOUR), spec, first.where("state is not null").select("user_id", "state"), **options)
    return first.where("state is null").union(second.where("state is null")).drop("state")


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ticks(spark, sf_dir).withColumn("place", F.col("seq") * SHUFFLED[0] % SHUFFLED[1])


def _time_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.compute_time_bars(_shuffled(spark, sf_dir), 24 * HOUR, key=KEY, order=("place", "seq"), watermark=None)


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late ticks of every user, and whether strict ordering refuses that user's ticks.

    The refusal is that of the engine: each user's run of the rule, by a flag instead of a failed job.
    """
    rows = _shuffled(spark, sf_dir)
    late = T.out_of_order(rows, T.sequence_window(KEY, ("place", "seq"))).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    refused = B.order_refusals(rows, key=KEY, order=("place", "seq"))
    return refused.join(late, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_late"), "rejected")


def _given_sides(spark: SparkSession, sf_dir: str, spec: BarSpec) -> DataFrame:
    fifth = F.col("seq") % 5
    rows = events_ticks(spark, sf_dir).withColumn("given", F.when(fifth == 0, None).when(fifth <= 2, -1.0).otherwise(1.0))
    schema = {"timestamp": "timestamp", "price": "price", "volume": "volume", "side": "given"}
    return B.build_bars(rows, spec, schema, **OPTIONS)


def _first_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ticks(spark, sf_dir).withColumn("price", F.col("price") - 200)
    found = T.first_invalid(rows, T.SchemaMapping(None), order=("timestamp", "seq"))
    return spark.createDataFrame([(found["row"], found["seq"], found["price"])] if found else [], "row long, seq long, price double")


def _exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, day = events_ticks(spark, sf_dir).select("seq", "timestamp"), 86_400_000
    span = rows.agg(F.floor(F.min("timestamp") / day).alias("a"), F.floor(F.max("timestamp") / day).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("d")).where("d % 3 = 0")
    exchange = Exchange(days.select((F.col("d") * day + 10 * HOUR).alias("open_ms"), (F.col("d") * day + 14 * HOUR).alias("close_ms")))
    return exchange.with_next_open(exchange.mark(rows, "timestamp", "shut"), "timestamp", "next_open").select("seq", "shut", F.coalesce("next_open", F.lit(-1)).alias("next_open"))


def _next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("timestamp")
    return events_ticks(spark, sf_dir).select("seq", Session(9, 30, 16, 0).next_open(at).alias("session"), Weekdays().next_open(at).alias("weekday"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume bars of a stream: a micro-batch for each third of the time, through the state store into files.

    A file source takes files by modification time, which says nothing of the ticks in them. So each
    third arrives when the query has ended with the one before, and the query goes on from its checkpoint.
    """
    base = f"{_scratch(spark)}/stream-{uuid.uuid4().hex}"
    rows = events_ticks(spark, sf_dir).select("user_id", "timestamp", "seq", "price", "volume")
    cuts = rows.agg(F.percentile_approx("timestamp", [1 / 3, 2 / 3]).alias("t")).first()["t"] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(F.col("timestamp") > low)
        (part if high is None else part.where(F.col("timestamp") <= high)).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        bars = stream_bars(source, BarSpec("standard", "volume", Static(500.0)), **OPTIONS)
        bars.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{base}/out")


def _scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="barspark-")
    return found.rstrip("/")


def _quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ticks(spark, sf_dir).withColumn("price", F.col("price") + 1).withColumn("volume", F.lit(1.0))
    bars = B.compute_tick_bars(rows, 10, key=("event_type",), order=("timestamp", "seq"))
    report = quality.quality_report(bars, ("event_type",), lags=4).drop("per_day")
    exact = ("lb_statistic", "lb_p_value", "jb_statistic", "jb_p_value", "mean_per_day", "std_per_day", "cv")
    return report.withColumns({c: F.round(c, 6) for c in exact})


def _above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.compute_volume_bars(events_ticks(spark, sf_dir), 500, after_watermark=WATERMARK, **OPTIONS)


def _custom_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ticks(spark, sf_dir).withColumn("mark", F.floor(F.col("timestamp") / HOUR).cast("long"))
    return B.compute_tick_bars(rows, 10, key=KEY, order=("timestamp", "seq"), watermark="mark")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollar bars of all events as one stream, in chunks."""
    return B.compute_dollar_bars(events_ticks(spark, sf_dir), 50_000_000.0, order=("timestamp", "seq"), chunks=8)


def _calibrated(kind: str):
    return lambda spark, d: calibrate.fixed_threshold(events_ticks(spark, d), kind, 10, **OPTIONS)


def _seeds(family: str):
    return lambda spark, d: calibrate.ewma_seeds(events_ticks(spark, d), family, "tick", 20, 5, **OPTIONS)


EWMA = Ewma(20, None, 4.0, 0.5)
HALF_LIFE = Ewma(20, 5.0, 4.0, 0.5)
WATERMARK = 1_704_067_200_000 + 10 * 86_400_000


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "tick_rule": _tick_rule,
        "dedup_watermark": _dedup,
        "tick_bars": _bars(BarSpec("standard", "tick", Static(10))),
        "tick_bars_partial": _bars(BarSpec("standard", "tick", Static(10)), include_partial=True),
        "volume_bars": _volume_bars,
        "dollar_bars": _bars(BarSpec("standard", "dollar", Static(2_000_000.0))),
        "time_bars_clock": _bars(BarSpec("time", interval_ms=24 * HOUR)),
        "time_bars_first_tick": _bars(BarSpec("time", interval_ms=24 * HOUR, anchor="first_tick")),
        "minute_resample": _minutes,
        "minute_volume": _minute_volume,
        "session_flags": _sessions,
        "tick_bars_session": _bars(BarSpec("standard", "tick", Static(10)), calendar=Session(9, 30, 16, 0)),
        "volume_bars_session": _bars(BarSpec("standard", "volume", Static(500.0)), calendar=Weekdays()),
        "resume_equals_full": _resume,
        "imbalance_tick_warmup": _bars(BarSpec("imbalance", "tick", EWMA, warmup_bars=3)),
        "run_tick_min_run": _bars(BarSpec("run", "tick", EWMA, min_run_length=3)),
        "minute_dollar": lambda s, d: B.compute_dollar_bars_from_minutes(_minutes(s, d), 2_000_000.0, key=KEY),
        "quality_stability": lambda s, d: quality.stability(_volume_bars(s, d), KEY, 24 * HOUR).withColumns({c: F.round(c, 9) for c in ("std_per_day", "cv")} | {"per_day": F.concat_ws(",", F.col("per_day").cast("array<string>"))}),
        "quality_fragmentation": lambda s, d: quality.fragmentation(_bars(BarSpec("run", "tick", EWMA))(s, d), KEY),
        "quality_report": _quality_report,
        "time_bars_unordered": _time_unordered,
        "strict_ordering_rejects": _strict,
        "imbalance_volume_given_sides": lambda s, d: _given_sides(s, d, BarSpec("imbalance", "volume", Static(300.0))),
        "run_volume_given_sides": lambda s, d: _given_sides(s, d, BarSpec("run", "volume", Ewma(20, None, 300.0, 0.5))),
        "imbalance_tick_half_life": _bars(BarSpec("imbalance", "tick", HALF_LIFE)),
        "first_invalid_row": _first_invalid,
        "exchange_sessions": _exchange,
        "next_open": _next_open,
        "stream_volume_bars": _streamed,
        "volume_bars_after_watermark": _above,
        "tick_bars_custom_watermark": _custom_mark,
        "dollar_bars_chunked": _chunked,
        "threshold_trace": lambda s, d: B.threshold_trace(events_ticks(s, d), BarSpec("imbalance", "tick", EWMA), **OPTIONS).withColumn("threshold_after", F.round("threshold_after", 9)),
        "log_returns": lambda s, d: quality.log_returns(_volume_bars(s, d), KEY).select("user_id", "bar_id", F.round("log_return", 9).alias("log_return")),
        "ewma_convergence": lambda s, d: calibrate.convergence(B.threshold_trace(events_ticks(s, d), BarSpec("imbalance", "tick", EWMA), **OPTIONS), KEY),
        "ewma_seeds_imbalance": _seeds("imbalance"),
        "ewma_seeds_run": _seeds("run"),
    }
    size = {"tick": 6.0, "volume": 300.0, "dollar": 500_000.0}
    for m, limit in size.items():
        out[f"imbalance_{m}_static"] = _bars(BarSpec("imbalance", m, Static(limit)))
        out[f"run_{m}_static"] = _bars(BarSpec("run", m, Static(limit)))
        out[f"imbalance_{m}_ewma"] = _bars(BarSpec("imbalance", m, Ewma(20, None, limit, 0.5)))
        out[f"run_{m}_ewma"] = _bars(BarSpec("run", m, Ewma(20, None, limit, 0.5)))
        out[f"calib_fixed_{m}"] = _calibrated(m)
    for m in ("volume", "dollar"):
        for family in ("imbalance", "run"):
            f = getattr(B, f"compute_{family}_{m}_bars_from_minutes")
            out[f"minute_{family}_{m}"] = lambda s, d, f=f, m=m: f(_minutes(s, d), 20, None, size[m], 0.5, key=KEY)
    for family in ("imbalance", "run"):
        for m in size:
            out[f"calib_fixed_{family}_{m}"] = _calibrated(f"{family}_{m}")
    return out


def _unkeyed(sql: str) -> str:
    """The same query over all rows as one stream."""
    return sql.replace("PARTITION BY user_id ", "").replace("GROUP BY user_id, bar_id", "GROUP BY bar_id").replace("SELECT user_id, bar_id::BIGINT", "SELECT bar_id::BIGINT")


def oracle_sql() -> dict[str, str]:
    volume = _closed_sql("floor(sum(volume) OVER u / 500)::BIGINT", "volume")
    day = 24 * HOUR
    could = "greatest(0, floor((timestamp - ({start})) / {day}::DOUBLE)::BIGINT + 1)"
    clock = f"first_value(timestamp) OVER u // {day} * {day} + {day}"
    out = {
        "tick_rule": f"WITH {TICKS_SQL.split('kept AS')[0].rstrip().rstrip(',')} SELECT user_id, seq, last_value(CASE WHEN step <> 0 THEN step::DOUBLE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS side FROM signed",
        "dedup_watermark": f"SELECT user_id, seq, mark FROM (SELECT user_id, event_id AS seq, epoch_us(ts) // 1000 // {HOUR} AS mark, max(epoch_us(ts) // 1000 // {HOUR}) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE top IS NULL OR mark > top",
        "tick_bars": _closed_sql("i // 10", "tick"),
        "tick_bars_partial": _closed_sql("i // 10", "tick", "true").replace("AS bar_type", "AS bar_type, max(k) <= bar_id AS is_partial"),
        "volume_bars": volume,
        "resume_equals_full": volume,
        "dollar_bars": _closed_sql("floor(sum(dollar) OVER u / 2000000)::BIGINT", "dollar"),
        "time_bars_clock": _closed_sql(could.format(start=clock, day=day), "time"),
        "time_bars_first_tick": _closed_sql(could.format(start=f"first_value(timestamp) OVER u + {day}", day=day), "time"),
        "minute_resample": f"WITH {MINUTES_SQL} SELECT user_id, timestamp, open, high, low, close, volume FROM minutes",
        "minute_volume": MINUTE_VOLUME_SQL,
        "minute_dollar": MINUTE_VOLUME_SQL.replace("sum(volume) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) / 500", "sum(close * volume) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) / 2000000").replace("'volume' AS", "'dollar' AS"),
        "session_flags": SESSIONS_SQL,
        "tick_bars_session": TICK_SESSION_SQL,
        "volume_bars_session": VOLUME_SESSION_SQL,
        "ewma_convergence": CONVERGENCE_SQL,
        "time_bars_unordered": TIME_UNORDERED_SQL,
        "strict_ordering_rejects": STRICT_SQL,
        "imbalance_volume_given_sides": _imbalance_sql("volume", "300::DOUBLE", 0.0, 0.0, "imbalance_volume", source=GIVEN_SIDES_SQL),
        "run_volume_given_sides": _run_sql("volume", 300.0, 0.5, "run_volume", source=GIVEN_SIDES_SQL),
        "imbalance_tick_half_life": _imbalance_sql("tick", "et * abs(ep)", 4.0, 0.5, "imbalance_tick", a=f"({HALF_LIFE.alpha!r}::DOUBLE)"),
        "first_invalid_row": INVALID_SQL,
        "exchange_sessions": EXCHANGE_SQL,
        "next_open": NEXT_OPEN_SQL,
        "stream_volume_bars": volume,
        "volume_bars_after_watermark": volume.replace("FROM events)", f"FROM events WHERE epoch_us(ts) // 1000 > {WATERMARK})", 1),
        "tick_bars_custom_watermark": _closed_sql("i // 10", "tick").replace("max(timestamp) OVER", f"max(timestamp // {HOUR}) OVER").replace("timestamp > top", f"timestamp // {HOUR} > top"),
        "dollar_bars_chunked": _unkeyed(_closed_sql("floor(sum(dollar) OVER u / 50000000)::BIGINT", "dollar")),
        "threshold_trace": _before_bars(_imbalance_sql("tick", "et * abs(ep)", 4.0, 0.5, "")) + " SELECT user_id, mine AS bar_id, round(et * abs(ep), 9) AS threshold_after FROM r WHERE bar > mine",
        "log_returns": f"WITH bars AS ({volume}) SELECT user_id, bar_id, round(CASE WHEN isfinite(x) THEN x END, 9) AS log_return FROM (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS x FROM bars WINDOW w AS (PARTITION BY user_id ORDER BY bar_id))",
        "quality_report": REPORT_SQL,
        "ewma_seeds_imbalance": _seeds_sql("imbalance"),
        "ewma_seeds_run": _seeds_sql("run"),
        "imbalance_tick_warmup": _imbalance_sql("tick", "et * abs(ep)", 4.0, 0.5, "imbalance_tick", 3),
        "run_tick_min_run": _run_sql("tick", 4.0, 0.5, "run_tick", 3),
        "quality_stability": f"WITH bars AS ({volume}), d AS (SELECT user_id, open_ts // {day} AS dy, count(*) AS n FROM bars GROUP BY ALL) SELECT user_id, count(*) AS n_days, avg(n) AS mean_per_day, round(coalesce(stddev_samp(n), 0), 9) AS std_per_day, round(coalesce(stddev_samp(n), 0) / avg(n), 9) AS cv, string_agg(n::VARCHAR, ',' ORDER BY dy) AS per_day FROM d GROUP BY user_id",
        "quality_fragmentation": f"WITH bars AS ({_run_sql('tick', 4.0, 0.5, 'run_tick')}) SELECT user_id, avg((num_ticks <= 2)::DOUBLE) AS fraction_fragmented FROM bars GROUP BY user_id",
        "calib_fixed_tick": f"WITH {TICKS_SQL} SELECT user_id, count(*) / 10.0::DOUBLE AS threshold FROM raw GROUP BY user_id",
        "calib_fixed_volume": f"WITH {TICKS_SQL} SELECT user_id, sum(volume) / 10.0::DOUBLE AS threshold FROM raw GROUP BY user_id",
        "calib_fixed_dollar": f"WITH {TICKS_SQL} SELECT user_id, sum(price * volume) / 10.0::DOUBLE AS threshold FROM raw GROUP BY user_id",
    }
    for family in ("imbalance", "run"):
        for m in ("tick", "volume", "dollar"):
            out[f"calib_fixed_{family}_{m}"] = _calibration_sql(family, m)
    size = {"tick": "6", "volume": "300", "dollar": "500000"}
    for m, limit in size.items():
        out[f"imbalance_{m}_static"] = _imbalance_sql(m, f"{limit}::DOUBLE", 0.0, 0.0, f"imbalance_{m}")
        out[f"imbalance_{m}_ewma"] = _imbalance_sql(m, "et * abs(ep)", float(limit), 0.5, f"imbalance_{m}")
        out[f"run_{m}_ewma"] = _run_sql(m, float(limit), 0.5, f"run_{m}")
        running = "i" if m == "tick" else f"sum({m}) OVER u"
        out[f"run_{m}_static"] = _closed_sql(f"floor({running} / {limit})::BIGINT", f"run_{m}")
    minute_ticks = MINUTES_SQL + """,
steps AS (SELECT *, sign(close - lag(close) OVER (PARTITION BY user_id ORDER BY timestamp)) AS step FROM minutes),
t AS (SELECT *, close * volume AS dollar, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) AS i,
  last_value(CASE WHEN step <> 0 THEN step::DOUBLE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS side FROM steps)"""
    as_minutes = lambda sql: sql.replace("arg_min(price, i)", "arg_min(open, i)").replace("max(price)", "max(high)").replace("min(price)", "min(low)").replace("arg_max(price, i)", "arg_max(close, i)")
    for m in ("volume", "dollar"):
        out[f"minute_imbalance_{m}"] = as_minutes(_imbalance_sql(m, "et * abs(ep)", float(size[m]), 0.5, f"imbalance_{m}", source="@@")).replace("@@", minute_ticks)
        out[f"minute_run_{m}"] = as_minutes(_run_sql(m, float(size[m]), 0.5, f"run_{m}", source="@@")).replace("@@", minute_ticks)
    return out
