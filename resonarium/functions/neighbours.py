"""Nearest neighbours and counts in the maximum norm, by leaves of a median split (numpy only).

Points have weights: how many samples they stand for. Leaves of queries meet only
the leaves of points whose boxes are near enough, so the work follows the
neighbours, not the square of the points.
"""

from __future__ import annotations

import numpy as np

LEAF = 64


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Index arrays of at most `size` points each, split at medians of the widest axis."""
    out, todo = [], [np.arange(len(points))] if len(points) else []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        p = points[own]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argpartition(p[:, axis], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


class Boxes:
    """Points in leaves, with the bounds of each leaf."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, size: int = LEAF):
        self.points, self.weights = np.asarray(points, float), np.asarray(weights)
        self.leaves = leaves(self.points, size)
        shape = (0, self.points.shape[1])
        self.low = np.array([self.points[i].min(0) for i in self.leaves]).reshape(-1, shape[1])
        self.high = np.array([self.points[i].max(0) for i in self.leaves]).reshape(-1, shape[1])

    def near(self, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
        """Points of all leaves that come within `reach` of the box."""
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0).max(1)
        found = np.flatnonzero(gap <= reach)
        return np.concatenate([self.leaves[i] for i in found]) if len(found) else np.zeros(0, np.int64)


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in the maximum norm, rows of a by rows of b."""
    out = np.abs(a[:, None, 0] - b[None, :, 0])
    for axis in range(1, a.shape[1]):
        np.maximum(out, np.abs(a[:, None, axis] - b[None, :, axis]), out=out)
    return out


def smallest(distances: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances of each row, a point counted as often as it weighs; infinite where there are fewer."""
    take = min(k, distances.shape[1])
    if not take:
        return np.full((len(distances), k), np.inf)
    at = np.argpartition(distances, take - 1, axis=1)[:, :take]
    d = np.take_along_axis(distances, at, 1)
    w = weights[at] if weights.ndim == 1 else np.take_along_axis(weights, at, 1)
    order = np.argsort(d, axis=1)
    d, upto = np.take_along_axis(d, order, 1), np.cumsum(np.take_along_axis(w, order, 1), 1)
    out = np.full((len(d), k), np.inf)
    for j in range(k):  # the first point by which j + 1 are counted
        has = upto[:, -1] > j
        first = np.argmax(upto > j, axis=1)
        out[has, j] = d[has, first[has]]
    return out


def nearest(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances from each point to the others; a point of weight w has w - 1 others at distance 0."""
    boxes, out = Boxes(points, weights), np.full((len(points), k), np.inf)
    for own in boxes.leaves:
        p = boxes.points[own]
        d = far(p, p)
        w = np.repeat(boxes.weights[None, own], len(own), 0)
        np.fill_diagonal(w, boxes.weights[own] - 1)
        d = np.where(w > 0, d, np.inf)
        bound = smallest(d, w, k)[:, -1].max()
        other = boxes.near(p.min(0), p.max(0), bound)
        d = far(p, boxes.points[other])
        w = boxes.weights[None, other] - (own[:, None] == other[None, :])
        out[own] = smallest(np.where(w > 0, d, np.inf), w, k)
    return out


def nearest_of(points: np.ndarray, weights: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances below each query's bound to points of another place."""
    boxes, out = Boxes(points, weights), np.full((len(queries), k), np.inf)
    for own in leaves(queries):
        q = queries[own]
        other = boxes.near(q.min(0), q.max(0), bounds[own].max())
        if len(other):
            d = far(q, boxes.points[other])
            out[own] = smallest(np.where(d < bounds[own][:, None], d, np.inf), boxes.weights[other], k)
    return out


def within(points: np.ndarray, weights: np.ndarray, queries: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Weight of the points strictly nearer to each query than its reach."""
    out = np.zeros(len(queries), np.int64)
    if not len(points):
        return out
    if points.shape[1] == 1:  # differences as they are rounded, so candidates at the edges are looked at one by one
        order = np.argsort(points[:, 0], kind="stable")
        v, total = points[order, 0], np.concatenate([[0], np.cumsum(weights[order])])
        q, slack = queries[:, 0], 4 * np.spacing(np.abs(queries[:, 0]) + reach)
        lo, hi = np.searchsorted(v, q - reach - slack, "left"), np.searchsorted(v, q + reach + slack, "right")
        sure_lo, sure_hi = np.searchsorted(v, q - reach + slack, "right"), np.searchsorted(v, q + reach - slack, "left")
        for i in range(len(q)):
            if sure_lo[i] >= sure_hi[i]:
                part = slice(lo[i], hi[i])
                out[i] = weights[order[part]][np.abs(v[part] - q[i]) < reach[i]].sum()
                continue
            out[i] = total[sure_hi[i]] - total[sure_lo[i]]
            for part in (slice(lo[i], sure_lo[i]), slice(sure_hi[i], hi[i])):
                if part.start < part.stop:
                    out[i] += weights[order[part]][np.abs(v[part] - q[i]) < reach[i]].sum()
        return out
    boxes = Boxes(points, weights)
    for own in leaves(queries):
        q = queries[own]
        other = boxes.near(q.min(0), q.max(0), reach[own].max())
        if len(other):
            out[own] = ((far(q, boxes.points[other]) < reach[own][:, None]) * boxes.weights[other]).sum(1)
    return out
