"""Optimisation test functions and kernels over arrays of doubles, as column expressions (MTH21-23)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column, f: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))


def _indexed(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    return total(F.transform(x, f))


def sphere(x: Column) -> Column:
    return total(x, lambda v: v * v)


def rosenbrock(x: Column) -> Column:
    steps = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: 100 * (b - a * a) * (b - a * a) + (1 - a) * (1 - a))
    return total(steps)


def shifted_rosenbrock(x: Column, shift: float = 0.5) -> Column:
    return rosenbrock(F.transform(x, lambda v: v - shift + 1))


def ackley(x: Column, a: float = 20.0, b: float = 0.2, c: float = 2 * math.pi) -> Column:
    n = F.size(x)
    return -a * F.exp(-b * F.sqrt(total(x, lambda v: v * v) / n)) - F.exp(total(x, lambda v: F.cos(c * v)) / n) + a + math.e


def griewank(x: Column) -> Column:
    product = F.aggregate(F.transform(x, lambda v, i: F.cos(v / F.sqrt(i + 1))), F.lit(1.0), lambda s, v: s * v)
    return total(x, lambda v: v * v) / 4000 - product + 1


def levy(x: Column) -> Column:
    w = F.transform(x, lambda v: 1 + (v - 1) / 4)
    first = F.pow(F.sin(math.pi * F.get(w, F.lit(0))), 2)
    last = F.get(w, F.size(w) - 1)
    middle = total(F.slice(w, F.lit(1), F.size(w) - 1), lambda v: F.pow(v - 1, 2) * (1 + 10 * F.pow(F.sin(math.pi * v + 1), 2)))
    return first + middle + F.pow(last - 1, 2) * (1 + F.pow(F.sin(2 * math.pi * last), 2))


def trid(x: Column) -> Column:
    pairs = F.zip_with(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1), lambda a, b: a * b)
    return total(x, lambda v: (v - 1) * (v - 1)) - total(pairs)


def branin(x1: Column, x2: Column) -> Column:
    a = x2 - 5.1 / (4 * math.pi**2) * x1 * x1 + 5 / math.pi * x1 - 6
    return a * a + 10 * (1 - 1 / (8 * math.pi)) * F.cos(x1) + 10


def camel6(x1: Column, x2: Column) -> Column:
    return (4 - 2.1 * x1 * x1 + F.pow(x1, 4) / 3) * x1 * x1 + x1 * x2 + (-4 + 4 * x2 * x2) * x2 * x2


# The published constants of the Hartman (6-D) and Shekel (4-D, 10 wells) functions.
HARTMAN_ALPHA = [1.0, 1.2, 3.0, 3.2]
HARTMAN_A = [[10, 3, 17, 3.5, 1.7, 8], [0.05, 10, 17, 0.1, 8, 14], [3, 3.5, 1.7, 10, 17, 8], [17, 8, 0.05, 10, 0.1, 14]]
HARTMAN_P = [[0.1312, 0.1696, 0.5569, 0.0124, 0.8283, 0.5886], [0.2329, 0.4135, 0.8307, 0.3736, 0.1004, 0.9991], [0.2348, 0.1451, 0.3522, 0.2883, 0.3047, 0.6650], [0.4047, 0.8828, 0.8732, 0.5743, 0.1091, 0.0381]]
SHEKEL_BETA = [0.1, 0.2, 0.2, 0.4, 0.4, 0.6, 0.3, 0.7, 0.5, 0.5]
SHEKEL_C = [[4, 4, 4, 4], [1, 1, 1, 1], [8, 8, 8, 8], [6, 6, 6, 6], [3, 7, 3, 7], [2, 9, 2, 9], [5, 5, 3, 3], [8, 1, 8, 1], [6, 2, 6, 2], [7, 3.6, 7, 3.6]]


def hartman6(x: Column) -> Column:
    wells = [alpha * F.exp(-sum((a * F.pow(F.get(x, F.lit(i)) - p, 2) for i, (a, p) in enumerate(zip(row, at, strict=True))), F.lit(0.0))) for alpha, row, at in zip(HARTMAN_ALPHA, HARTMAN_A, HARTMAN_P, strict=True)]
    return -sum(wells, F.lit(0.0))


def shekel4(x: Column) -> Column:
    wells = [1 / (sum((F.pow(F.get(x, F.lit(i)) - c, 2) for i, c in enumerate(well)), F.lit(0.0)) + beta) for beta, well in zip(SHEKEL_BETA, SHEKEL_C, strict=True)]
    return -sum(wells, F.lit(0.0))


def squared_distance(x: Column, y: Column) -> Column:
    """ARR1, squared."""
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def kernel(r: Column, kind: str, eps: float = 1.0) -> Column:
    """MTH22: radial kernels of a distance."""
    if kind == "cubic":
        return r * r * r
    if kind == "linear":
        return r
    if kind == "thin_plate":
        return F.when(r > 1e-12, r * r * F.ln(r)).otherwise(0.0)
    return F.exp(-F.pow(eps * r, 2))


def ard_correlation(x: Column, y: Column, theta: Column) -> Column:
    """MTH23: exp(-sum theta_i (x_i - y_i)^2)."""
    squares = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.exp(-total(F.zip_with(theta, squares, lambda t, s: t * s)))
