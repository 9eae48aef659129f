"""Adaptive draws of hyper-parameters: a tree-structured Parzen estimator over a handful of trials.

After ``startup`` random draws, the trials so far are parted into the best share and the rest.  For each parameter two
densities are laid over their values; candidates are drawn from the first, and the one with the largest ratio of both is tried
next.  Only parameters and scores of trials are held, never rows; every trial is a set of Spark fits.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

#: ("float", low, high), ("log", low, high), ("int", low, high) or ("choice", values)
Range = tuple


@dataclass(frozen=True)
class ParzenSampler:
    """Draws for a space of parameters; the same seed and the same trials give the same next draw."""
    space: Mapping[str, Range]
    seed: int = 42
    startup: int = 3
    candidates: int = 24
    best_share: float = 0.1

    def next(self, trials: Sequence[Mapping], scores: Sequence[float]) -> dict:
        """The draw after ``trials`` with ``scores`` (higher is better)."""
        rng = random.Random(f"{self.seed}|{len(trials)}")
        if len(trials) < self.startup:
            return {name: self._random(rng, r) for name, r in self.space.items()}
        order = sorted(range(len(trials)), key=lambda i: (-scores[i], i))
        n = max(1, math.ceil(self.best_share * len(trials)))
        good, bad = [trials[i] for i in order[:n]], [trials[i] for i in order[n:]]
        return {name: self._drawn(rng, r, [t[name] for t in good], [t[name] for t in bad]) for name, r in self.space.items()}

    def _random(self, rng: random.Random, r: Range):
        if r[0] == "choice":
            return rng.choice(list(r[1]))
        return self._outside(r, rng.uniform(*self._span(r)))

    def _drawn(self, rng: random.Random, r: Range, good: list, bad: list):
        if r[0] == "choice":
            values = list(r[1])
            weigh = lambda seen: [(1 / len(values) + seen.count(v)) / (1 + len(seen)) for v in values]
            a, b = weigh(good), weigh(bad)
            tries = rng.choices(range(len(values)), weights=a, k=self.candidates)
            return values[max(tries, key=lambda k: (a[k] / b[k], -k))]
        low, high = self._span(r)
        a, b = self._kernels(r, good), self._kernels(r, bad)
        tries = []
        for _ in range(self.candidates):
            centre, width = rng.choice(a)
            x = rng.gauss(centre, width)
            while not low <= x <= high:
                x = rng.gauss(centre, width)
            tries.append(self._inside(r, self._outside(r, x)))
        best = max(tries, key=lambda x: (self._density(a, x, low, high) - self._density(b, x, low, high), -x))
        return self._outside(r, best)

    @staticmethod
    def _span(r: Range) -> tuple[float, float]:
        """The interval draws are made in: logarithms for log ranges, half a step more on both sides for whole numbers."""
        if r[0] == "log":
            return math.log(r[1]), math.log(r[2])
        return (r[1] - 0.5, r[2] + 0.5) if r[0] == "int" else (float(r[1]), float(r[2]))

    @staticmethod
    def _inside(r: Range, value: float) -> float:
        return math.log(value) if r[0] == "log" else float(value)

    @staticmethod
    def _outside(r: Range, x: float):
        if r[0] == "int":
            return min(r[2], max(r[1], math.floor(x + 0.5)))
        return min(r[2], max(r[1], math.exp(x) if r[0] == "log" else x))

    def _kernels(self, r: Range, values: list) -> list[tuple[float, float]]:
        """(centre, width) of one normal per value, as wide as the larger gap to its neighbours, and one over the whole range."""
        low, high = self._span(r)
        xs = sorted(self._inside(r, v) for v in values)
        least = (high - low) / min(100, 1 + len(xs))
        edges = [low, *xs, high]
        return [(x, min(high - low, max(least, edges[i + 1] - edges[i], edges[i + 2] - edges[i + 1]))) for i, x in enumerate(xs)] \
            + [((low + high) / 2, high - low)]

    @staticmethod
    def _density(kernels: list[tuple[float, float]], x: float, low: float, high: float) -> float:
        """Log of the mean of the normals, each cut off at the range's ends."""
        whole = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        total = 0.0
        for centre, width in kernels:
            mass = max(1e-12, whole((high - centre) / width) - whole((low - centre) / width))
            total += math.exp(-0.5 * ((x - centre) / width) ** 2) / (width * mass)
        return math.log(total / len(kernels) + 1e-300)
