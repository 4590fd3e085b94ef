"""Small dense numerics that the vector operators share; they run on bounded samples only."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """``k`` centres (fewer if there are fewer rows) by Lloyd's rounds; an empty cell takes the farthest row."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64) if k else np.zeros((0, x.shape[1]))
    for _ in range(rounds if k else 0):
        d = (centres**2).sum(1) - 2 * x @ centres.T
        of = d.argmin(1)
        counts = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if (~full).any():
            far = np.argsort(-d[np.arange(len(x)), of])[: int((~full).sum())]
            centres[~full] = x[far]
    return centres


def iterative_quantisation(x: np.ndarray, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """A rotation that brings centred rows near to the corners of the cube: signs, then Procrustes, in turn."""
    d = x.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds if len(x) else 0):
        signs = np.where(x @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(x.T @ signs)
        rotation = u @ vt
    return rotation
