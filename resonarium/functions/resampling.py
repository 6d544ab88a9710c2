"""Surrogates and resampling of arrays; draws depend on (seed, replicate) alone, not on partitions."""

from __future__ import annotations

import numpy as np


def rng_of(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([int(k) & 0xFFFFFFFF for k in key])))


def phase_randomized(x, rng: np.random.Generator) -> np.ndarray:
    """Same amplitude spectrum, uniform phases; the ends of the spectrum keep amplitude with phase zero."""
    x = np.asarray(x, float)
    s = np.fft.rfft(x)
    phase = rng.uniform(0, 2 * np.pi, len(s))
    phase[0] = 0
    if len(x) % 2 == 0:
        phase[-1] = 0
    return np.fft.irfft(np.abs(s) * np.exp(1j * phase), len(x))


def time_shifted(x, rng: np.random.Generator) -> np.ndarray:
    return np.roll(x, -int(rng.integers(1, len(x))))


def ranks(x) -> np.ndarray:
    """Ranks from 0, ties in order of place."""
    out = np.empty(len(x), np.int64)
    out[np.argsort(x, kind="stable")] = np.arange(len(x))
    return out


def aaft(x, rng: np.random.Generator) -> np.ndarray:
    x = np.asarray(x, float)
    normal = np.sort(rng.standard_normal(len(x)))[ranks(x)]
    return np.sort(x)[ranks(phase_randomized(normal, rng))]


def iaaft(x, rng: np.random.Generator, most: int = 100, tol: float = 1e-8) -> np.ndarray:
    """Alternates the spectrum's amplitudes and the values' distribution until ranks or the spectral error settle."""
    x = np.asarray(x, float)
    amplitude, values = np.abs(np.fft.rfft(x)), np.sort(x)
    now = rng.permutation(x)
    order, error = None, np.inf
    for _ in range(most):
        s = np.fft.rfft(now)
        r = ranks(np.fft.irfft(amplitude * np.exp(1j * np.angle(s)), len(x)))
        now = values[r]
        e = np.sqrt(np.mean((np.abs(np.fft.rfft(now)) - amplitude) ** 2)) / max(np.sqrt(np.mean(amplitude**2)), 1e-300)
        if (order is not None and (r == order).all()) or abs(error - e) < tol:
            break
        order, error = r, e
    return now


SURROGATES = {"phase": phase_randomized, "timeshift": time_shifted, "aaft": aaft, "iaaft": iaaft}


def block_index(n: int, rng: np.random.Generator) -> np.ndarray:
    """Indices of a block bootstrap: blocks of about the root of n from random starts, cut to n."""
    size = int(np.ceil(np.sqrt(n)))
    starts = rng.integers(0, n - size + 1, int(np.ceil(n / size)))
    return (starts[:, None] + np.arange(size)).ravel()[:n]


def quantile8(values, q: float) -> float:
    """Median-unbiased quantile."""
    v = np.sort(np.asarray(values, float))
    n = len(v)
    h = (n + 1 / 3) * q + 1 / 3
    k = int(np.floor(h + 4 * np.finfo(float).eps))
    w = h - k
    at = lambda i: v[min(max(i - 1, 0), n - 1)]
    return float(at(k) if abs(w) < 1e-12 else (1 - w) * at(k) + w * at(k + 1))


def adjust(p, method: str = "BH") -> np.ndarray:
    """Adjusted p-values: holm, hochberg, hommel, bonferroni, BH or fdr, BY, none. NaN stay and don't count."""
    p = np.asarray(p, float)
    ok = ~np.isnan(p)
    out, v = p.copy(), p[ok]
    n = len(v)
    if method == "none" or n <= 1:
        return out
    down, up = np.argsort(-v, kind="stable"), np.argsort(v, kind="stable")
    i = np.arange(n, 0, -1)
    back = lambda order, x: x[np.argsort(order, kind="stable")]
    if method == "bonferroni":
        a = v * n
    elif method == "holm":
        a = back(up, np.maximum.accumulate((n - np.arange(n)) * v[up]))
    elif method == "hochberg":
        a = back(down, np.minimum.accumulate((n - i + 1) * v[down]))
    elif method in ("BH", "fdr"):
        a = back(down, np.minimum.accumulate(n / i * v[down]))
    elif method == "BY":
        a = back(down, np.minimum.accumulate((1 / np.arange(1, n + 1)).sum() * n / i * v[down]))
    elif method == "hommel":
        s = v[up]
        k = np.arange(1, n + 1)
        best = np.full(n, (n * s / k).min())
        for m in range(n - 1, 1, -1):
            tail = np.arange(n - m + 1, n)
            q1 = (m * s[tail] / np.arange(2, m + 1)).min()
            q = np.empty(n)
            q[: n - m + 1] = np.minimum(m * s[: n - m + 1], q1)
            q[tail] = q[n - m]
            best = np.maximum(best, q)
        a = back(up, np.maximum(best, s))
    else:
        raise ValueError(f"unknown method {method!r}")
    out[ok] = np.minimum(1, a)
    return out
