"""Upper tail of the chi-squared distribution."""

from __future__ import annotations

import math


def chi2_sf(x: float, dof: int) -> float:
    """P(X >= x): regularised upper incomplete gamma function at (dof / 2, x / 2)."""
    a, x = dof / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300  # continued fraction of the upper one
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (d_ if abs(d_ := k * d + b) > tiny else tiny)
        c = c_ if abs(c_ := b + k / c) > tiny else tiny
        step = d * c
        out *= step
        if abs(step - 1) < 1e-16:
            break
    return scale * out
