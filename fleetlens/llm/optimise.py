"""Limited-memory BFGS for the small convex fits of the classifiers (on bounded samples, on the driver)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, memory: int = 10) -> np.ndarray:
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.abs(g).sum()))
        for (s, y, r), a in zip(steps, reversed(kept), strict=True):
            q += s * (a - r * (y @ q))
        slope, size = -(g @ q), 1.0
        if slope >= 0:
            steps.clear()
            q, slope = g, -(g @ g)
        for _ in range(25):
            new = x - size * q
            v, h = f(new)
            if v <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = new - x, h - g
        if s @ y > 1e-12:
            steps = [*steps[-(memory - 1) :], (s, y, 1 / (s @ y))]
        done = abs(value - v) < 1e-7 * max(1.0, abs(value))
        x, value, g = new, v, h
        if done:
            break
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
