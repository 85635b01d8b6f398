"""Searches for parameters that score best: Parzen estimators and differential evolution.

A score takes a list of parameter sets and returns one number each, so that one
Spark job scores a whole batch; nothing else of these searches touches data.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

Bounds = dict[str, tuple[float, float]]
Score = Callable[[list[dict[str, float]]], list[float]]


class _Density:
    """A mixture of normal curves around the values seen, cut off at the bounds, and one flat part."""

    def __init__(self, values: list[float], low: float, high: float):
        self.low, self.high = low, high
        xs = sorted(values)
        width = high - low
        least = width / min(100, len(xs) + 2)
        self.parts = []
        for i, x in enumerate(xs):
            # as wide as the larger distance to a neighbour, within limits
            left = x - (xs[i - 1] if i else low)
            right = (xs[i + 1] if i + 1 < len(xs) else high) - x
            self.parts.append((x, min(width, max(left, right, least))))
        self.parts.append(((low + high) / 2, width))

    def draw(self, rng: random.Random) -> float:
        x, s = rng.choice(self.parts)
        for _ in range(100):
            v = rng.gauss(x, s)
            if self.low <= v <= self.high:
                return v
        return x

    def log(self, v: float) -> float:
        total = 0.0
        for x, s in self.parts:
            inside = 0.5 * (math.erf((self.high - x) / (s * math.sqrt(2))) - math.erf((self.low - x) / (s * math.sqrt(2))))
            total += math.exp(-0.5 * ((v - x) / s) ** 2) / (s * math.sqrt(2 * math.pi) * max(inside, 1e-12))
        return math.log(max(total / len(self.parts), 1e-300))


def parzen(score: Score, bounds: Bounds, tries: int = 100, seed: int = 42, start: int = 20, batch: int = 5, candidates: int = 24) -> tuple[dict[str, float], float, list[float]]:
    """The best set found, its score, and the scores in order of trial.

    After ``start`` random sets, the sets seen are parted into the better ones
    (as many as the root of their number) and the others, each side gets a
    density for each parameter, and of the candidates drawn from the better side's densities those are
    tried next that are most likely under the better side rather than the
    other. ``batch`` sets are scored together.
    """
    rng = random.Random(seed)
    seen: list[tuple[float, int, dict[str, float]]] = []

    def tried(sets):
        for s, v in zip(sets, score(sets), strict=True):
            seen.append((v, len(seen), s))

    tried([{k: rng.uniform(a, b) for k, (a, b) in bounds.items()} for _ in range(min(start, tries))])
    while len(seen) < tries:
        order = sorted(seen, key=lambda x: (-x[0], x[1]))
        n_good = max(2, math.ceil(math.sqrt(len(order))))
        better, other = order[:n_good], order[n_good:]
        pairs = {k: (_Density([s[k] for _, _, s in better], a, b), _Density([s[k] for _, _, s in other], a, b)) for k, (a, b) in bounds.items()}
        new = []
        for _ in range(min(batch, tries - len(seen))):
            chosen = {}
            for k, (up, down) in pairs.items():
                drawn = [up.draw(rng) for _ in range(candidates)]
                chosen[k] = max(drawn, key=lambda v, up=up, down=down: up.log(v) - down.log(v))
            new.append(chosen)
        tried(new)
    best = max(seen, key=lambda x: (x[0], -x[1]))
    return best[2], best[0], [v for v, _, _ in seen]


def evolution(score: Score, bounds: Bounds, generations: int = 20, size: int | None = None, seed: int = 42, cross: float = 0.7, spread: tuple[float, float] = (0.5, 1.0), tolerance: float = 0.01) -> tuple[dict[str, float], float, list[float]]:
    """Differential evolution: each member is challenged by the best one plus a scaled difference of two others, crossed with it.

    Each generation is scored at once. It ends after ``generations``, or when
    the scores spread by less than ``tolerance`` of their mean. The history has
    the best score of each generation, the first population's included.
    """
    rng = random.Random(seed)
    names = list(bounds)
    n = size or max(5, 15 * len(names))
    cells = {k: rng.sample(range(n), n) for k in names}  # one member in each n-th of every range
    pop = [{k: a + (cells[k][i] + rng.random()) / n * (b - a) for k, (a, b) in bounds.items()} for i in range(n)]
    scores = list(score(pop))
    history = [max(scores)]
    for _ in range(generations):
        mean = sum(scores) / n
        if math.sqrt(sum((s - mean) ** 2 for s in scores) / n) <= tolerance * abs(mean):
            break
        best = pop[max(range(n), key=lambda i: (scores[i], -i))]
        scale = rng.uniform(*spread)
        trials = []
        for i in range(n):
            a, b = rng.sample([j for j in range(n) if j != i], 2)
            sure = rng.choice(names)
            trial = dict(pop[i])
            for k, (low, high) in bounds.items():
                if k == sure or rng.random() < cross:
                    v = best[k] + scale * (pop[a][k] - pop[b][k])
                    trial[k] = v if low <= v <= high else rng.uniform(low, high)
            trials.append(trial)
        for i, (t, s) in enumerate(zip(trials, score(trials), strict=True)):
            if s >= scores[i]:
                pop[i], scores[i] = t, s
        history.append(max(scores))
    k = max(range(n), key=lambda i: (scores[i], -i))
    return pop[k], scores[k], history
