"""Bar types by name: a batch function, and a builder for streams."""

from __future__ import annotations

from collections.abc import Callable

from barspark.functions.fold import BarBuilder
from barspark.model import BarSpec, Ewma, Static
from barspark.operators import bars

_FUNCTIONS: dict[str, Callable] = {}
_BUILDERS: dict[str, Callable[..., BarBuilder]] = {}


def register(name: str, function: Callable | None = None, builder: Callable[..., BarBuilder] | None = None):
    """Add a batch function under a name, also as a decorator, and a builder if there is one; a name is taken once."""
    if function is None and builder is None:
        return lambda f: register(name, f)
    if name in names():
        raise ValueError(f"{name!r} is registered already")
    if function is not None:
        _FUNCTIONS[name] = function
    if builder is not None:
        _BUILDERS[name] = builder
    return function


def _found(table: dict[str, Callable], name: str) -> Callable:
    if name not in table:
        raise KeyError(f"no bar type {name!r}; known: {sorted(table)}")
    return table[name]


def get(name: str) -> Callable:
    """The batch function of a bar type."""
    return _found(_FUNCTIONS, name)


def get_builder(name: str) -> Callable[..., BarBuilder]:
    """The function that makes a ``BarBuilder`` of a bar type."""
    return _found(_BUILDERS, name)


def names() -> list[str]:
    return sorted(_FUNCTIONS.keys() | _BUILDERS.keys())


def clear() -> None:
    """Forget all bar types, for tests; ``register_all`` brings the ten back."""
    _FUNCTIONS.clear()
    _BUILDERS.clear()


def _standard(metric: str) -> Callable[..., BarBuilder]:
    def build(threshold: float, **options) -> BarBuilder:
        return BarBuilder(BarSpec("standard", metric, Static(threshold)), **options)

    return build


def _time(interval_ms: int, anchor: str = "clock", **options) -> BarBuilder:
    return BarBuilder(BarSpec("time", interval_ms=interval_ms, anchor=anchor), **options)


def _information(family: str, metric: str) -> Callable[..., BarBuilder]:
    def build(span: float = 20, halflife: float | None = None, initial_ewa_t: float = 1.0, initial_ewa_proportion: float = 0.5,
              warmup_bars: int = 0, min_run_length: int = 0, **options) -> BarBuilder:
        moving = Ewma(span, halflife, initial_ewa_t, initial_ewa_proportion)
        return BarBuilder(BarSpec(family, metric, moving, warmup_bars=warmup_bars, min_run_length=min_run_length), **options)

    return build


def register_all() -> None:
    """The ten bar types."""
    register("time", bars.compute_time_bars, _time)
    for metric in ("tick", "volume", "dollar"):
        register(metric, getattr(bars, f"compute_{metric}_bars"), _standard(metric))
        for family in ("imbalance", "run"):
            register(f"{family}_{metric}", getattr(bars, f"compute_{family}_{metric}_bars"), _information(family, metric))


register_all()
