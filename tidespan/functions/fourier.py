"""Sums of exponentials over unevenly spaced points at even frequencies, in n log n."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Points of the fine grid that a read is spread over, and the shape of the bump; relative errors stay near 1e-13.
WIDTH, SHAPE = 14, 2.3 * 14
#: Reads spread at once: some 100 MB of bumps.
CHUNK = 400_000
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(80)
#: Fine grids up to which the bump's transform is kept (some 32 kB each): records share them, and it takes eighty cosines a frequency.
KEPT = 16_384


def _bump(z: np.ndarray) -> np.ndarray:
    return np.exp(SHAPE * (np.sqrt(np.maximum(0.0, 1.0 - z * z)) - 1.0))


def _bump_transform(m: int, most: int) -> np.ndarray:
    """The bump's transform at frequencies 0 .. most of a grid of m points."""
    k, bump = np.arange(most + 1), np.zeros(most + 1)
    for node, weight in zip(_NODES, _WEIGHTS, strict=True):
        bump += weight * _bump(np.array(node)) * np.cos(np.pi * WIDTH * k * node / m)
    return bump


@lru_cache(maxsize=32)
def _kept_transform(m: int) -> np.ndarray:
    return _bump_transform(m, m // 4)


def exponential_sums(x: np.ndarray, c: np.ndarray, top: int) -> np.ndarray:
    """sum_j c_j exp(-2 pi i k x_j) for k = 0 .. top.

    Reads are spread onto a regular grid of twice the band with a smooth bump, transformed by one FFT, and the bump's own transform
    is divided out (Dutt and Rokhlin 1993; the bump is that of Barnett, Magland and af Klinteberg 2019).
    """
    half = (top + 1) // 2
    m = 1 << int(np.ceil(np.log2(max(2 * (2 * half + 1), 2 * WIDTH))))
    x = np.mod(x, 1.0)
    c = c * np.exp(-2j * np.pi * half * x)  # frequencies from -half to half
    grid = np.zeros(m, complex)
    for a in range(0, len(x), CHUNK):
        g = x[a : a + CHUNK] * m
        first = np.ceil(g - WIDTH / 2).astype(np.int64)
        at = first[:, None] + np.arange(WIDTH)
        part = _bump((at - g[:, None]) / (WIDTH / 2)) * c[a : a + CHUNK, None]
        at = np.mod(at, m).ravel()
        grid += np.bincount(at, part.real.ravel(), m) + 1j * np.bincount(at, part.imag.ravel(), m)
    k = np.arange(top + 1) - half
    bump = (_kept_transform(m) if m <= KEPT else _bump_transform(m, half))[np.abs(k)]  # |k| is half at most, and m four times that
    return np.fft.fft(grid)[np.mod(k, m)] / (WIDTH / 2 * bump)
