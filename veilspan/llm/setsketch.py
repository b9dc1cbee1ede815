"""SetSketch: registers that hold exponentially spaced, truncated minima.

Every element of a set is the start of one random sequence of points with
exponential spacings; each point falls to a random register, which keeps its
smallest point x as the integer floor(1 - log_b x), cut to [0, Q + 1]. The sketch of
a union is the register-wise maximum. Two sketches agree in a register about as often
as the sets overlap, so bands of registers are a locality-sensitive hash; the counts
of larger, smaller and equal registers give a joint likelihood of the overlap.
"""

from __future__ import annotations

import math

import numpy as np

from .common import splitmix

#: Base and rate of the registers, and the largest value less one.
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOG_BASE = math.log(BASE)
_MASK = (1 << 64) - 1


def sketch(elements: np.ndarray, row: np.ndarray, n: int, m: int) -> np.ndarray:
    """Registers (n, m) as uint16 of n sets. ``elements`` are 64-bit hashes, grouped by
    ``row``, which ascends. The register of an empty set is 0."""
    smallest = np.full(n * m, np.inf)
    seed, owner = elements, row.astype(np.int64)
    x = np.zeros(len(elements))
    limit = np.full(n, np.inf)
    step = 0
    while len(seed):
        step += 1
        h = splitmix(seed + np.uint64(step * int(_GOLDEN) & _MASK))
        u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (RATE * m)
        near = x < limit[owner]
        if not near.all():
            seed, owner, x, h = seed[near], owner[near], x[near], h[near]
        register = ((splitmix(h ^ _GOLDEN) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        np.minimum.at(smallest, owner * m + register.astype(np.int64), x)
        if step < 4 or step % 4 == 0:
            # an element is done when its next point can change no register
            used = np.unique(owner) if step > 8 else np.arange(n)
            limit[used] = smallest.reshape(n, m)[used].max(axis=1)
            live = x < limit[owner]
            seed, owner, x = seed[live], owner[live], x[live]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(smallest) / _LOG_BASE)
    return np.clip(k, 0, Q + 1).astype(np.uint16).reshape(n, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers: (n, m // rows)."""
    n, m = registers.shape
    grouped = registers[:, : m // rows * rows].reshape(n, m // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * _GOLDEN, grouped.shape[:2]).copy()
    for k in range(rows):
        key = splitmix(key ^ (grouped[:, :, k] + np.uint64((k + 1) * int(_GOLDEN) & _MASK)))
    return key


def _p(x: np.ndarray) -> np.ndarray:
    """The chance that one register is larger, for a share x of the union."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG_BASE


def log_likelihood(j: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Of Jaccard similarity j, for sets of nu and nv elements whose registers are
    larger, smaller and equal in so many places."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    up, down = _p(np.maximum(u - v * j, 0)), _p(np.maximum(v - u * j, 0))
    tiny = 1e-300
    return larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))


def estimate(a: np.ndarray, b: np.ndarray, nu: np.ndarray, nv: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most likely Jaccard similarity of each pair of sketches (rows of a and b),
    and the register counts. The likelihood is concave, so thirds find its top."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    nu, nv = nu.astype(float), nv.astype(float)
    lo, hi = np.zeros(len(nu)), np.minimum(nu, nv) / np.maximum(np.maximum(nu, nv), 1)
    for _ in range(steps):
        p, q = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = log_likelihood(p, larger, smaller, equal, nu, nv) < log_likelihood(q, larger, smaller, equal, nu, nv)
        lo, hi = np.where(left, p, lo), np.where(left, hi, q)
    return (lo + hi) / 2, larger, smaller, equal
