"""What users may plug in: what fills a bar, what threshold closes it, and calendars.

Objects are made once per key by the factories in ``BarSpec`` and live in one
task, in tick order. Their attributes are their state; those of streams must be
values that JSON holds.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column


class Accumulator(ABC):
    """Decides from the ticks of the open bar whether it is full."""

    @abstractmethod
    def add(self, ts: int, price: float, volume: float, side: float | None) -> None:
        """Take a tick into the open bar."""

    @abstractmethod
    def full(self, threshold: float) -> bool:
        """Whether the open bar closes with the tick added last."""

    @abstractmethod
    def close(self, threshold: float, forced: bool) -> None:
        """Start the next bar; ``forced`` at a session's edge."""

    def stats(self) -> tuple[float, float]:
        """Size and proportion of the open bar, handed to the threshold at its close."""
        return 0.0, 0.0


class Threshold(ABC):
    """A threshold that may follow the bars closed so far."""

    @abstractmethod
    def current(self) -> float:
        """The threshold of the open bar."""

    def closed(self, size: float, proportion: float) -> None:
        """A bar was closed by its ticks (not by a session's edge)."""


class Calendar(ABC):
    """Sessions as column expressions on Unix milliseconds."""

    has_sessions: bool = True

    @abstractmethod
    def is_boundary(self, ts: Column) -> Column:
        """Whether no session is open."""

    @abstractmethod
    def next_open(self, ts: Column) -> Column:
        """When a session opens next."""
