"""Elastic alignment of curves by square-root velocities (numpy only)."""

from __future__ import annotations

import numpy as np


def srvf(f, t) -> np.ndarray:
    d = np.diff(f) / np.diff(t)
    d = np.append(d, d[-1])
    return np.sign(d) * np.sqrt(np.abs(d))


def from_srvf(q, t, start: float = 0.0) -> np.ndarray:
    v = q * np.abs(q)
    return start + np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2 * np.diff(t))])


def warp_srvf(q, gamma, t) -> np.ndarray:
    g = np.diff(gamma) / np.diff(t)
    return np.interp(gamma, t, q) * np.sqrt(np.maximum(np.append(g, g[-1]), 0))


def warp(values, gamma) -> np.ndarray:
    """A signal read at the warped times; gamma runs over [0, 1]."""
    return np.interp(gamma, np.linspace(0, 1, len(values)), values)


def best_warp(q1, q2, t, max_step: int = 6) -> np.ndarray:
    """Warp of q2 onto q1 of least squared distance over paths of steps (a, b), a and b up to max_step.

    Dynamic programming row by row; all predecessors of a row's cells by one
    step length a are scored together.
    """
    n = len(t)
    cost = np.full((n, n), np.inf)
    cost[0, 0] = 0
    from_a, from_b = np.zeros((n, n), int), np.zeros((n, n), int)
    for i in range(1, n):
        for a in range(1, min(max_step, i) + 1):
            k = i - a
            ti = t[k : i + 1]
            u = (ti - t[k]) / (t[i] - t[k])
            for b in range(1, min(max_step, n - 1) + 1):
                start = np.arange(0, n - b)
                open_ = np.isfinite(cost[k, start])
                start = start[open_]
                if not len(start):
                    continue
                slope = (t[start + b] - t[start]) / (t[i] - t[k])
                at = t[start][:, None] + u[None, :] * (t[start + b] - t[start])[:, None]
                d = (q1[k : i + 1][None, :] - np.interp(at, t, q2) * np.sqrt(slope)[:, None]) ** 2
                total = cost[k, start] + ((d[:, 1:] + d[:, :-1]) / 2 * np.diff(ti)).sum(1)
                j = start + b
                better = total < cost[i, j]
                j = j[better]
                cost[i, j], from_a[i, j], from_b[i, j] = total[better], a, b
    path, i, j = [(n - 1, n - 1)], n - 1, n - 1
    while i > 0 or j > 0:
        i, j = i - from_a[i, j], j - from_b[i, j]
        path.append((i, j))
    pi, pj = np.array(path[::-1]).T
    g = np.interp(t, t[pi], t[pj])
    return np.maximum.accumulate((g - g[0]) / (g[-1] - g[0]))


def phase_distance(gamma, t) -> float:
    root = np.sqrt(np.maximum(np.diff(gamma) / np.diff(t), 0))
    return float(np.arccos(np.clip((root * np.mean(np.diff(t))).sum(), -1, 1)))


def align(x, y, t=None, max_step: int = 6) -> dict:
    """y warped onto x."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) != len(y):
        raise ValueError("curves of equal length are needed")
    t = np.linspace(0, 1, len(x)) if t is None else np.asarray(t, float)
    u = (t - t[0]) / (t[-1] - t[0])
    qx, qy = srvf(x, u), srvf(y, u)
    gamma = best_warp(qx, qy, u, max_step)
    moved = warp_srvf(qy, gamma, u)
    d = (qx - moved) ** 2
    return {
        "gamma": gamma,
        "aligned": np.interp(gamma, u, y),
        "amplitude_distance": float(np.sqrt(((d[1:] + d[:-1]) / 2 * np.diff(u)).sum())),
        "phase_distance": phase_distance(gamma, u),
        "srvf_x": qx,
        "srvf_y_aligned": moved,
        "solver": "dp",
    }
