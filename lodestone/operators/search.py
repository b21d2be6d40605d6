"""Searches: differential evolution, particle swarm, efficient global optimisation, surrogate-assisted evolution, NSGA-II.

The loops run on the driver over small populations; what is evaluated is any function of a (n, d) array, so a
generation is one vectorised call, or one Spark job if the function runs one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from lodestone.functions.models import Radial, distances, expected_improvement

Objective = Callable[[np.ndarray], np.ndarray]


def _start(bounds, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.random.Generator]:
    box = np.asarray(bounds, float)
    if box.ndim != 2 or box.shape[1] != 2 or (box[:, 1] <= box[:, 0]).any():
        raise ValueError("bounds are pairs of a lower and a higher number")
    rng = np.random.default_rng(seed)
    return box[:, 0], box[:, 1], box[:, 0] + rng.random((n, len(box))) * (box[:, 1] - box[:, 0]), rng


def _crossed(parent: np.ndarray, mutant: np.ndarray, rate: float, kind: str, rng: np.random.Generator) -> np.ndarray:
    """Binomial or exponential crossover of each row; one component at least is the mutant's."""
    n, d = parent.shape
    if kind == "bin":
        take = rng.random((n, d)) < rate
        take[np.arange(n), rng.integers(0, d, n)] = True
    else:
        run = np.minimum(d, rng.geometric(max(1 - rate, 1e-9), n))
        take = (np.arange(d)[None] - rng.integers(0, d, n)[:, None]) % d < run[:, None]
    return np.where(take, mutant, parent)


def evolve(func: Objective, bounds, pop: int = 50, weight: float = 0.7, rate: float = 0.9, evaluations: int = 1000, strategy: str = "best/1", crossover: str = "bin", seed: int = 0):
    """NUM31 by generations: (point, value, best value after each generation)."""
    low, high, x, rng = _start(bounds, pop, seed)
    y, used = func(x), pop
    history = [float(y.min())]
    while used + pop <= evaluations:
        others = np.array([rng.choice(pop - 1, 3, replace=False) for _ in range(pop)])
        others += others >= np.arange(pop)[:, None]
        base = x[y.argmin()][None] if strategy == "best/1" else x[others[:, 2]]
        trial = np.clip(_crossed(x, base + weight * (x[others[:, 0]] - x[others[:, 1]]), rate, crossover, rng), low, high)
        value = func(trial)
        better = value <= y
        x, y, used = np.where(better[:, None], trial, x), np.where(better, value, y), used + pop
        history.append(float(y.min()))
    return x[y.argmin()], float(y.min()), history


def swarm(func: Objective, bounds, particles: int = 50, iterations: int = 100, inertia: float = 0.72, own: float = 1.49, social: float = 1.49, seed: int = 0):
    """NUM32: (point, value, history)."""
    low, high, x, rng = _start(bounds, particles, seed)
    v, y = np.zeros_like(x), func(x)
    best_x, best_y, history = x.copy(), y.copy(), [float(y.min())]
    for _ in range(iterations):
        lead = best_x[best_y.argmin()]
        v = inertia * v + own * rng.random(x.shape) * (best_x - x) + social * rng.random(x.shape) * (lead - x)
        x = np.clip(x + v, low, high)
        y = func(x)
        better = y < best_y
        best_x, best_y = np.where(better[:, None], x, best_x), np.where(better, y, best_y)
        history.append(float(best_y.min()))
    return best_x[best_y.argmin()], float(best_y.min()), history


def ego(func: Objective, bounds, factory, n_init: int = 20, n_iter: int = 30, candidates: int = 2048, seed: int = 0):
    """NUM33: each round the candidate of largest expected improvement is evaluated: (point, value, history)."""
    low, high, x, rng = _start(bounds, n_init, seed)
    y = func(x)
    history = [float(y.min())]
    for _ in range(n_iter):
        model = factory().fit(x, y)
        tried = low + rng.random((candidates, len(low))) * (high - low)
        new = tried[expected_improvement(*model.predict(tried), float(y.min())).argmax()][None]
        x, y = np.vstack([x, new]), np.append(y, func(new))
        history.append(float(y.min()))
    return x[y.argmin()], float(y.min()), history


def assisted_evolution(func: Objective, bounds, factory=Radial, pop: int = 30, weight: float = 0.7, rate: float = 0.9, best: int = 9, local: int | None = None, radius: float = 0.25, evaluations: int = 300, seed: int = 0):
    """NUM34: each parent's local surrogate proposes a point, crossed with the parent; the children of the best parents are evaluated
    and replace their own parents if they are better: (point, value, history)."""
    low, high, x, rng = _start(bounds, pop, seed)
    y = func(x)
    seen_x, seen_y, history = x.copy(), y.copy(), [float(y.min())]
    near = local or min(len(low) * 2 + 5, pop)
    while len(seen_y) + best <= evaluations:
        parents = np.argsort(y, kind="stable")[:best]
        children = []
        for p in parents:
            span = high - low
            order = np.argsort(distances(((x[p] - low) / span)[None], (seen_x - low) / span)[0], kind="stable")[:near]
            model = factory().fit(seen_x[order], seen_y[order])
            box = np.stack([np.maximum(low, x[p] - radius * span), np.minimum(high, x[p] + radius * span)], 1)
            proposed, _, _ = swarm(lambda z, m=model: m.predict(z)[0], box, 20, 20, seed=int(rng.integers(1 << 31)))
            a, b = x[rng.choice(pop, 2, replace=False)]
            mutant = proposed + weight * rng.random() * (a - b) * (rng.random() < 0.5)
            children.append(np.clip(_crossed(x[p][None], mutant[None], rate, "exp", rng)[0], low, high))
        children = np.array(children)
        value = func(children)
        better = value < y[parents]
        x[parents[better]], y[parents[better]] = children[better], value[better]
        seen_x, seen_y = np.vstack([seen_x, children]), np.append(seen_y, value)
        history.append(float(y.min()))
    return x[y.argmin()], float(y.min()), history


def front_ranks(f: np.ndarray) -> np.ndarray:
    """NUM5 for a population in memory."""
    worse = (f[:, None] >= f[None]).all(2) & (f[:, None] > f[None]).any(2)
    rank, left, k = np.full(len(f), -1), np.ones(len(f), bool), 0
    while left.any():
        front = left & ~(worse & left[None]).any(1)
        rank[front], left, k = k, left & ~front, k + 1
    return rank


def crowding(f: np.ndarray) -> np.ndarray:
    """WIN7 for one front in memory; boundary points are infinite."""
    out = np.zeros(len(f))
    if len(f) <= 2:
        return np.full(len(f), np.inf)
    for column in f.T:
        order = np.argsort(column, kind="stable")
        span = column[order[-1]] - column[order[0]]
        if span > 1e-12:
            out[order[[0, -1]]] = np.inf
            out[order[1:-1]] += (column[order[2:]] - column[order[:-2]]) / span
    return out


def selected(f: np.ndarray, n: int) -> np.ndarray:
    """TOP8: whole fronts, then the least crowded of the front that is cut."""
    rank = front_ranks(f)
    wide = np.zeros(len(f))
    for k in np.unique(rank):
        wide[rank == k] = crowding(f[rank == k])
    return np.lexsort((-wide, rank))[:n]


def nsga2(func: Objective, bounds, pop: int = 100, generations: int = 100, eta_c: float = 20.0, eta_m: float = 20.0, cross: float = 0.9, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """NUM35, NUM36: (points, objectives) of the last population's first front."""
    low, high, x, rng = _start(bounds, pop, seed)
    f = func(x)
    d = len(low)
    for _ in range(generations):
        place = np.empty(len(x), int)
        place[selected(f, len(x))] = np.arange(len(x))
        duel = rng.integers(0, len(x), (2, 2, pop // 2))
        a, b = (x[np.where(place[p[0]] < place[p[1]], p[0], p[1])] for p in duel)
        u = rng.random(a.shape)
        beta = np.where(u <= 0.5, (2 * u) ** (1 / (eta_c + 1)), (1 / (2 * (1 - u))) ** (1 / (eta_c + 1)))
        beta = np.where((rng.random((len(a), 1)) < cross) & (rng.random(a.shape) < 0.5), beta, 1.0)
        child = np.vstack([(1 + beta) * a + (1 - beta) * b, (1 - beta) * a + (1 + beta) * b]) / 2
        u = rng.random(child.shape)
        step = np.where(u < 0.5, (2 * u) ** (1 / (eta_m + 1)) - 1, 1 - (2 * (1 - u)) ** (1 / (eta_m + 1)))
        child = np.clip(child + (rng.random(child.shape) < 1 / d) * step * (high - low), low, high)
        x, f = np.vstack([x, child]), np.vstack([f, func(child)])
        keep = selected(f, pop)
        x, f = x[keep], f[keep]
    first = front_ranks(f) == 0
    return x[first], f[first]


def hypervolume_sampled(f: np.ndarray, ref, n: int = 100_000, seed: int = 0) -> float:
    """NUM8: share of random points of the box below ref that a point dominates, times the box."""
    f, ref = np.atleast_2d(f), np.asarray(ref, float)
    low = np.minimum(f.min(0), ref)
    points = low + np.random.default_rng(seed).random((n, len(ref))) * (ref - low)
    hit = np.zeros(n, bool)
    for row in f:
        hit |= (row <= points).all(1)
    return float(hit.mean() * math.prod(ref - low))
