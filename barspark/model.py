"""Schemas, errors and the specification of a bar."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from barspark.extend import Accumulator, Threshold

# The columns of a bar, and the fields of a tick and of a minute.
BAR_COLUMNS = (
    "bar_id", "open", "high", "low", "close", "volume", "dollar_value", "vwap", "num_ticks", "open_ts", "close_ts", "bar_type",
)
BAR_DDL = (
    "bar_id long, open double, high double, low double, close double, volume double, dollar_value double, "
    "vwap double, num_ticks long, open_ts long, close_ts long, bar_type string"
)
TICK_REQUIRED, MINUTE_REQUIRED = ("timestamp", "price", "volume"), ("timestamp", "open", "high", "low", "close", "volume")


class BarError(Exception):
    """Any error of this engine."""


class SchemaError(BarError, ValueError):
    """A mapping or a table lacks or does not know a column."""


class ThresholdError(BarError, ValueError):
    """A threshold or its parameters are out of range."""


class StateError(BarError, ValueError):
    """A saved state does not fit."""


class TickDataError(BarError, ValueError):
    """A row's values are not allowed."""


@dataclass(frozen=True)
class Static:
    """A fixed threshold, 0 or more (at 0 every tick closes a bar)."""

    threshold: float

    def __post_init__(self) -> None:
        if not self.threshold >= 0:
            raise ThresholdError(f"threshold must be 0 or more, got {self.threshold}")


@dataclass(frozen=True)
class Ewma:
    """Two moving averages over closed bars: expected size and expected proportion.

    The factor is ``2 / (span + 1)``, or ``1 - exp(-ln 2 / halflife)`` if a
    half-life is given.
    """

    span: float = 20
    halflife: float | None = None
    initial_t: float = 1.0
    initial_proportion: float = 0.5
    min_threshold: float = 0.0

    def __post_init__(self) -> None:
        if not self.span > 0 or self.halflife is not None and not self.halflife > 0:
            raise ThresholdError("span and halflife must be positive")
        if not self.initial_t >= 0:
            raise ThresholdError("initial_t must be 0 or more")

    @property
    def alpha(self) -> float:
        return 2.0 / (self.span + 1.0) if self.halflife is None else 1.0 - math.exp(-math.log(2.0) / self.halflife)


@dataclass(frozen=True)
class BarSpec:
    """What closes a bar: a family, a metric, a threshold, and what is returned."""

    family: str  # "standard", "time", "imbalance", "run" or "custom"
    metric: str = "tick"  # "tick", "volume" or "dollar"
    threshold: Static | Ewma | Callable[[], Threshold] = field(default_factory=lambda: Static(0.0))
    interval_ms: int = 0
    anchor: str = "clock"
    warmup_bars: int = 0
    min_run_length: int = 0
    session_carry: str = "keep"  # "keep": a forced close leaves volume's and dollar's debt; "reset": 0
    accumulator: Callable[[], Accumulator] | None = None  # of the family "custom"
    label: str = "custom"

    def __post_init__(self) -> None:
        if self.family not in ("standard", "time", "imbalance", "run", "custom"):
            raise ValueError(f"unknown family {self.family!r}")
        if (self.family == "custom") != (self.accumulator is not None):
            raise ValueError("the family custom, and no other, takes an accumulator")
        if callable(self.threshold) and self.family != "custom":
            raise ThresholdError("a threshold of your own is for the family custom")
        if self.metric not in ("tick", "volume", "dollar"):
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.family == "time" and (self.interval_ms <= 0 or self.anchor not in ("clock", "first_tick")):
            raise ValueError("a time bar needs a positive interval_ms and the anchor clock or first_tick")
        if isinstance(self.threshold, Ewma) and self.family not in ("imbalance", "run", "custom"):
            raise ThresholdError("a moving threshold is for imbalance and run bars")

    @property
    def bar_type(self) -> str:
        return {"standard": self.metric, "time": "time", "custom": self.label}.get(self.family, f"{self.family}_{self.metric}")
