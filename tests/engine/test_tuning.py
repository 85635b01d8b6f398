"""Each search finds a planted optimum that a plain random draw with as many tries misses."""

import math
import random

from tidelake.operators.tuning import evolution, parzen

BOUNDS = {f"x{i}": (-5.0, 5.0) for i in range(6)}
PLANTED = {f"x{i}": v for i, v in enumerate((1.5, -2.0, 3.3, 0.4, -4.1, 2.2))}


def planted(sets):
    return [math.exp(-sum((s[k] - PLANTED[k]) ** 2 for k in PLANTED) / 12) for s in sets]


def by_draws(tries, seed):
    rng = random.Random(seed)
    return max(planted([{k: rng.uniform(a, b) for k, (a, b) in BOUNDS.items()} for _ in range(tries)]))


def by_draws_near_the_best(tries, seed):
    """Half at random, half near the best quarter of those."""
    rng = random.Random(seed)
    first = [{k: rng.uniform(a, b) for k, (a, b) in BOUNDS.items()} for _ in range(tries // 2)]
    good = [s for _, s in sorted(zip(planted(first), first, strict=True), key=lambda x: -x[0])[: tries // 8]]
    near = [{k: min(b, max(a, g[k] + rng.gauss(0, (b - a) / 10))) for k, (a, b) in BOUNDS.items()} for g in (rng.choice(good) for _ in range(tries - len(first)))]
    return max(planted(first + near))


def test_parzen_finds_what_draws_miss():
    for seed in (1, 2, 3):
        calls = []
        best, value, history = parzen(lambda sets: calls.append(len(sets)) or planted(sets), BOUNDS, tries=200, seed=seed)
        assert len(history) == 200 == sum(calls) and calls[0] == 20 and set(calls[1:]) == {5}
        assert value == max(history) == planted([best])[0] and all(-5 <= v <= 5 for v in best.values())
        assert value > 0.8 > max(by_draws(200, seed), by_draws_near_the_best(200, seed))
    assert parzen(planted, BOUNDS, tries=60, seed=9) == parzen(planted, BOUNDS, tries=60, seed=9)


def test_evolution_finds_what_draws_miss():
    for seed in (1, 2, 3):
        calls = []
        best, value, history = evolution(lambda sets: calls.append(len(sets)) or planted(sets), BOUNDS, generations=25, size=40, seed=seed)
        assert value > 0.95 > max(by_draws(sum(calls), seed), by_draws_near_the_best(sum(calls), seed)) and history == sorted(history) and len(calls) == len(history)
        assert all(-5 <= v <= 5 for v in best.values())
    flat = evolution(lambda sets: [1.0] * len(sets), BOUNDS, generations=25, size=10)
    assert len(flat[2]) == 1  # nothing to find: it ends at once


def test_few_tries_and_one_parameter():
    best, value, history = parzen(lambda sets: [-((s["a"] - 2) ** 2) for s in sets], {"a": (0, 10)}, tries=40)
    assert abs(best["a"] - 2) < 0.3 and len(history) == 40
    assert len(parzen(planted, BOUNDS, tries=5)[2]) == 5
