"""The error function, the normal distribution and expected improvements as column expressions, and as SQL of another engine.

erf is within 1e-14 of the true one: up to CUT its series of positive terms, which converges with every term, beyond it
the continued fraction of its complement; both are of a fixed length and in nested form, and stay in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
#: Where the fraction takes over, and how many terms each has.
CUT, TERMS, DEPTH = 2.5, 52, 40


def erf(x: Column) -> Column:
    """MTH12: the error function; null of null, NaN of NaN."""

    def of(v: Column) -> Column:
        # As lambdas' variables the value, its square and half its inverse square are worked out once.
        def series(y: Column) -> Column:
            total = F.lit(1.0)
            for n in range(TERMS, 0, -1):
                total = 1 + y * (2 / (2 * n + 1)) * total
            return v * total * F.exp(-y) * (2 / math.sqrt(math.pi))

        def fraction(half: Column) -> Column:
            part = F.lit(1.0)
            for k in range(DEPTH, 0, -1):
                part = 1 + half * k / part
            return F.signum(v) * (1 - F.exp(-0.5 / half) / (F.sqrt(0.5 / half) * math.sqrt(math.pi)) / part)

        let = lambda value, body: F.transform(F.array(value), body)[0]
        size = F.greatest(F.least(F.abs(v), F.lit(30.0)), F.lit(CUT))
        return F.when(F.isnan(v), v).when(F.abs(v) <= CUT, let(v * v, series)).otherwise(let(0.5 / (size * size), fraction))

    return F.transform(F.array(x), of)[0]


def density(u: Column) -> Column:
    return F.exp(-u * u / 2) / math.sqrt(2 * math.pi)


def below(u: Column) -> Column:
    """The normal distribution function."""
    return (1 + erf(u / math.sqrt(2))) / 2


def _known(mean: Column, sd: Column, best: Column, value: Column) -> Column:
    """A value where there is a deviation, 0 where there is none, null of null."""
    return F.when(mean.isNotNull() & sd.isNotNull() & best.isNotNull(), F.when(sd > TINY, value).otherwise(0.0))


def improvement(mean: Column, sd: Column, best: Column, xi: float = 0.0) -> Column:
    """NUM22, MTH12: the expected improvement on the best value, 0 where the deviation is at most TINY."""
    gain = best - xi - mean
    u = F.try_divide(gain, sd)
    return _known(mean, sd, best, F.greatest(F.lit(0.0), gain * below(u) + sd * density(u)))


def generalised(mean: Column, sd: Column, best: Column, g: int = 1) -> Column:
    """NUM23: the g-th moment of the improvement, through the recursion of truncated normal moments."""
    u = F.try_divide(best - mean, sd)
    moments = [below(u), -density(u)]
    for k in range(2, g + 1):
        moments.append(-F.pow(u, F.lit(k - 1)) * density(u) + (k - 1) * moments[k - 2])
    total = F.lit(0.0)
    for k in range(g + 1):
        total = total + (-1) ** k * math.comb(g, k) * F.pow(u, F.lit(g - k)) * moments[k]
    return _known(mean, sd, best, F.greatest(F.lit(0.0), F.pow(sd, F.lit(g)) * total))


def restrained(gain: Column, x: Column, incumbent: Column, limit: float, eps: float = 1e-3) -> Column:
    """NUM29: an improvement, 0 where the inputs x (array) lie more than eps and at most limit from the incumbent's."""
    far = F.sqrt(F.aggregate(F.zip_with(x, incumbent, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    return F.when((far > eps) & (far <= limit), 0.0).otherwise(gain)


def erf_sql(x: str) -> str:
    """The same expression as text."""
    total, part = "1.0", "1.0"
    for n in range(TERMS, 0, -1):
        total = f"(1 + y * {2 / (2 * n + 1)!r} * {total})"
    for k in range(DEPTH, 0, -1):
        part = f"(1 + h * {k} / {part})"
    return f"list_transform([{{'x': {x}, 'y': ({x}) * ({x}), 's': greatest(abs({x}), {CUT})}}], lambda v: CASE WHEN abs(v.x) <= {CUT} THEN v.x * {total.replace('y', 'v.y')} * exp(-v.y) * {2 / math.sqrt(math.pi)!r} ELSE sign(v.x) * (1 - exp(-v.s * v.s) / (v.s * {math.sqrt(math.pi)!r}) / {part.replace('h', '(0.5 / (v.s * v.s))')}) END)[1]"


def below_sql(u: str) -> str:
    return f"((1 + {erf_sql(f'({u}) / {math.sqrt(2)!r}')}) / 2)"


def density_sql(u: str) -> str:
    return f"(exp(-({u}) * ({u}) / 2) / {math.sqrt(2 * math.pi)!r})"
