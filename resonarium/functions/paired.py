"""Distances of all pairs by slices of their range, made anew for each slice instead of kept (numpy only).

The same pair has the same distance, to the last bit, however it is met:
features are added one after the other, never by matrix products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Rows of a leaf, columns of a piece, distances that are counted at once, pairs from which bounds are taken, most bounds.
LEAF, WIDE, AT_ONCE, SEEN, BOUNDS = 32, 2048, 1 << 20, 1 << 20, (1 << 16) - 1
#: Bits of a slice's number beside a distance, and pairs of neighbouring slices that are ranked at once.
BITS, CHUNK = 17, 1 << 17


def ready(x: np.ndarray, metric: str) -> np.ndarray:
    """Features as raw takes them: for correlations rows of mean 0 and length 1."""
    if metric == "euclidean":
        return x
    with np.errstate(all="ignore"):
        x = x - x.mean(1, keepdims=True)
        return x / np.sqrt((x**2).sum(1, keepdims=True))


def raw(a: np.ndarray, b: np.ndarray, metric: str, room: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, or 1 - correlations; the features are the first axis, the others are broadcast. room: two rows to work in, overwritten by the next call."""
    shape = np.broadcast_shapes(a.shape[1:], b.shape[1:])
    size = int(np.prod(shape))
    out, t = (np.empty((2, size)) if room is None else room[:, :size]).reshape(2, *shape)
    if not len(a):
        out[...] = 0
    for k, (u, v) in enumerate(zip(a, b)):
        to = t if k else out
        if metric == "euclidean":
            np.subtract(u, v, out=to)
            to *= to
        else:
            np.multiply(u, v, out=to)
        if k:
            out += t
    return out if metric == "euclidean" else np.subtract(1, out, out=out)


def finished(r: np.ndarray, metric: str) -> np.ndarray:
    """Distances of raw, in its place; undefined ones count as equal and largest."""
    if metric == "euclidean":
        np.sqrt(r, out=r)
    else:
        r += 0.0  # no negative zeros
    if np.isnan(r.sum()):
        r[np.isnan(r)] = np.inf
    return r


def leaves(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which each LEAF of them lie together: halves along the widest feature."""
    out, rest = [np.zeros(0, np.intp)], [np.arange(len(x))]
    while rest:
        at = rest.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        half = -(-len(at) // (2 * LEAF)) * LEAF
        part = x[at]
        cut = np.argpartition(part[:, np.argmax(np.ptp(part, axis=0))] if x.shape[1] else np.zeros(len(at)), half)
        rest += [at[cut[half:]], at[cut[:half]]]
    return np.concatenate(out)


def within(x: np.ndarray, ids: np.ndarray, metric: str, lo: float, hi: float, share: int = 0, shares: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, distances) of each unordered pair of different ids whose distance is in [lo, hi], once; of a share of them if shares > 1.

    Leaves whose boxes are too near or too far from each other are passed over.
    """
    n, order, euclid = len(x), leaves(x), metric == "euclidean"
    points = np.ascontiguousarray(x[order].T)
    least, most = (lo * lo * (1 - 1e-9) if lo > 0 else -np.inf, hi * hi * (1 + 1e-9) + 1e-300) if euclid else (lo, hi)
    starts = np.arange(0, n, LEAF)
    low, high = (f.reduceat(points, starts, axis=1) for f in (np.minimum, np.maximum)) if n else (points, points)
    twice, room = len(np.unique(ids)) < n, np.empty((2, LEAF * WIDE))
    for i in range(share, len(starts), shares):
        near = np.arange(i + 1)
        if euclid:
            l, h, li, hi_ = low[:, : i + 1], high[:, : i + 1], low[:, i, None], high[:, i, None]
            gap = np.maximum(np.maximum(li - h, l - hi_), 0)
            far = np.maximum(hi_ - l, h - li)
            near = np.flatnonzero(~((gap * gap).sum(0) * (1 - 1e-9) > most) & ~((far * far).sum(0) * (1 + 1e-9) < least))
        columns = (near[:, None] * LEAF + np.arange(LEAF)).ravel()
        if i == len(starts) - 1:
            columns = columns[columns < n]
        rows, found = points[:, starts[i] : starts[i] + LEAF, None], []
        for j in range(0, len(columns), WIDE):
            to = columns[j : j + WIDE]
            r = raw(rows, points.take(to, axis=1)[:, None], metric, room).ravel()
            hit = (r >= least) & (r <= most) if hi < np.inf else ~(r < least)
            hit = np.flatnonzero(hit)
            d = finished(r[hit], metric)
            u = hit // len(to)
            u, v = u + starts[i], to[hit - u * len(to)]
            keep = (d >= lo) & (d <= hi)
            if to[-1] >= starts[i]:
                keep &= u > v
            if twice:
                keep &= ids[order[u]] != ids[order[v]]
            found.append((u[keep], v[keep], d[keep]))
        if found:
            u, v, d = (np.concatenate(f) for f in zip(*found))
            if len(d):
                yield order[u], order[v], d


def bounds_of(x: np.ndarray, y: np.ndarray, ids: np.ndarray, metric: str) -> list[np.ndarray]:
    """Bounds of slices for each block, about as many pairs in each slice: of all pairs of a small table, else of SEEN random ones."""
    n = len(ids)
    if n * (n - 1) // 2 <= SEEN:
        u, v = np.tril_indices(n, -1)
    else:
        u, v = np.random.default_rng(0).integers(0, n, (2, SEEN))
    differ = ids[u] != ids[v]
    out = []
    for z in (x, y):
        d = np.sort(finished(raw(z[u[differ]].T, z[v[differ]].T, metric), metric))
        distinct = np.unique(d)
        out.append(distinct if len(distinct) <= BOUNDS else np.unique(d[np.linspace(0, len(d) - 1, BOUNDS).astype(int)]))
    return out


def counted(x: np.ndarray, y: np.ndarray, ids: np.ndarray, metric: str, bounds: list[np.ndarray], share: int, shares: int) -> list[np.ndarray]:
    """Pairs of a share in each slice, for each block: slice 2k lies below bound k and above the one before, slice 2k + 1 is bound k."""
    counts, held, size = [np.zeros(2 * len(b) + 1, np.int64) for b in bounds], [], 0

    def flush():
        for k in range(2):
            d = np.sort(np.concatenate([h[k] for h in held]))
            edges = np.stack([np.searchsorted(d, bounds[k], "left"), np.searchsorted(d, bounds[k], "right")], axis=1).ravel()
            counts[k] += np.diff(edges, prepend=0, append=len(d))

    a, b = (np.ascontiguousarray(z.T) for z in (x, y))
    twice, room = len(np.unique(ids)) < len(ids), np.empty((2, 2, LEAF * WIDE))
    for i in range(share * LEAF, len(ids), shares * LEAF):
        at = slice(i, min(i + LEAF, len(ids)))
        for j in range(0, at.stop, WIDE):
            to = slice(j, min(j + WIDE, at.stop))
            two = [finished(raw(z[:, at, None], z[:, None, to], metric, r), metric) for z, r in zip((a, b), room)]
            if to.stop > i or twice:
                below = np.arange(at.start, at.stop)[:, None] > np.arange(to.start, to.stop)
                below &= ids[at, None] != ids[None, to]
                two = [d[below] for d in two]
            held.append([d.ravel().copy() for d in two])
            size += held[-1][0].size
            if size >= AT_ONCE:
                flush()
                held, size = [], 0
    if held:
        flush()
    return counts


def finder(bounds: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Function that gives the slice of each value. A guide over equal cells leads to the first bound that may be at or above it."""
    some = np.append(bounds, np.nan)

    def slices(at, v):
        return 2 * at + (some[at] == v)

    finite = bounds[np.isfinite(bounds)]
    cells = 1 << 18
    with np.errstate(all="ignore"):
        scale = cells / (finite[-1] - finite[0]) if len(finite) > 1 else np.inf
    if not 0 < scale < np.inf:
        return lambda v: slices(np.searchsorted(bounds, v), v)

    def cell(v):
        c = v - finite[0]
        c *= scale
        return np.clip(c, 0, cells, out=c).astype(np.int32)

    guide = np.searchsorted(cell(bounds), np.arange(cells + 1)).astype(np.int32)

    def find(v):
        at = guide[cell(v)]
        left = np.flatnonzero(some[at] < v)
        for _ in range(6):
            at[left] += 1
            left = left[some[at[left]] < v[left]]
        if len(left):
            at[left] = np.searchsorted(bounds, v[left])
        return slices(at, v)

    return find


def ranges(counts: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(first slice, last slice, share, shares): neighbouring slices of at most `most` pairs together; one of equal distances beyond that is cut into shares."""
    out, first, last, held = [], -1, -1, 0
    for s in np.flatnonzero(counts).tolist():
        c = int(counts[s])
        if first >= 0 and held + c > most:
            out.append((first, last, 0, 1))
            first, held = -1, 0
        if s % 2 and c > most:
            shares = -(-c // most)
            out += [(s, s, k, shares) for k in range(shares)]
            continue
        first, last, held = s if first < 0 else first, s, held + c
    if first >= 0:
        out.append((first, last, 0, 1))
    return out


def limits(bounds: np.ndarray, first, last):
    """The least and the largest values that may lie in slices first to last (numbers, or arrays of them)."""
    k, m = np.floor_divide(first, 2), np.floor_divide(last, 2)
    padded = np.concatenate([[-np.inf], bounds, [np.inf]])
    lo = np.where(np.mod(first, 2), padded[k + 1], np.nextafter(padded[k], np.inf))
    hi = np.where(np.mod(last, 2) | (m == len(bounds)), padded[m + 1], np.nextafter(padded[m + 1], -np.inf))
    return lo[()], hi[()]


def middles(counts: np.ndarray) -> np.ndarray:
    """Mean rank in each slice, about the mean of all ranks."""
    return np.cumsum(counts) - counts / 2 + 0.5 - (counts.sum() + 1) / 2


def left_out(counts: list[np.ndarray]) -> float:
    """The most, as a share of the norms of the ranks, that sums of products of ranks about their slices' middles can come to; slices of one distance have none."""
    norms = [((middles(c) ** 2) @ c, (c[::2].astype(float) ** 3).sum() / 12) for c in counts]
    return float(np.sqrt(norms[0][1] / max(norms[0][0], 1)) * np.sqrt(norms[1][1] / max(norms[1][0], 1)))


def numbers(d: np.ndarray) -> np.ndarray:
    """Distances of 0 or more as whole numbers: their bits, which are in the same order."""
    return d.view(np.uint64)


def packs(bounds: np.ndarray, counts: np.ndarray, first: int, last: int) -> list[tuple[int, int, float, bool]]:
    """(first slice, last slice, least value, tight): neighbouring slices whose values' numbers differ in fewer than 64 - BITS bits, so that BITS more fit beside them; others stand alone."""
    out, room = [], 1 << (64 - BITS)
    held = first + np.flatnonzero(counts[first : last + 1])
    ends = limits(bounds, held, held)
    low, high = (numbers(np.maximum(e, 0.0) + 0.0).tolist() for e in ends)
    for s, lo, hi, least in zip(held.tolist(), low, high, ends[0].tolist()):
        tight = least >= 0 and hi - lo < room
        if out and tight and out[-1][3] and hi - base < room:
            out[-1] = (out[-1][0], s, out[-1][2], True)
        else:
            out.append((s, s, least, tight))
            base = lo
    return out


def products(x: np.ndarray, y: np.ndarray, ids: np.ndarray, metric: str, bounds: list[np.ndarray], counts: list[np.ndarray], first: int, last: int, share: int, shares: int) -> tuple[float, float, float]:
    """Sums over the pairs whose distance in x is in slices first to last: exact rank squared, exact rank times the middle of the pair's slice in y,
    and the middle of its slice in x times that in y. Ranks are about the mean of all ranks, ties averaged.
    """
    find, own, other = finder(bounds[1]), middles(counts[0]), middles(counts[1])
    lo, hi = limits(bounds[0], first, last)
    points = np.ascontiguousarray(y.T)
    pairs = within(x, ids, metric, lo, hi, share, shares)
    slices_of = lambda u, v: find(finished(raw(points.take(u, axis=1), points.take(v, axis=1), metric), metric))
    if shares > 1:
        n, s = 0, 0.0
        for u, v, _ in pairs:
            n, s = n + len(u), s + other[slices_of(u, v)].sum()
        return n * own[first] ** 2, own[first] * s, own[first] * s
    parts = packs(bounds[0], counts[0], first, last)
    size = [int(counts[0][f : l + 1].sum()) for f, l, *_ in parts]
    begins = np.cumsum([0, *size])
    filled, loose = begins[:-1].copy(), {k: [] for k, part in enumerate(parts) if not part[3]}
    least, bits, low = np.array([part[2] for part in parts]), np.uint64(BITS), np.uint64((1 << BITS) - 1)
    base = numbers(np.maximum(least, 0.0) + 0.0)
    keys = np.empty(begins[-1], np.uint64)
    for u, v, d in pairs:
        at = slices_of(u, v)
        if len(parts) > 1:
            part = np.searchsorted(least, d, "right") - 1
            order = np.argsort(part.astype(np.uint16) if len(parts) < 1 << 16 else part, kind="stable")
            d, at, part = d[order], at[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        else:
            part, cuts = np.zeros(1, int), np.array([0, len(d)])
        for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
            k = int(part[i])
            if k in loose:
                loose[k].append((d[i:j].copy(), at[i:j].copy()))
            elif filled[k] + j - i <= begins[k + 1]:
                packed = keys[filled[k] : filled[k] + j - i]
                np.subtract(numbers(d[i:j]), base[k], out=packed)
                packed <<= bits
                packed |= at[i:j].astype(np.uint64)
            filled[k] += j - i
    if (filled != begins[1:]).any():
        raise RuntimeError(f"{(filled - begins[:-1]).sum()} pairs in slices {first} to {last} instead of {begins[-1]}")
    rr = rm = mm = 0.0
    below = int(counts[0][:first].sum()) - (int(counts[0].sum()) + 1) / 2
    for k, (f, l, *_) in enumerate(parts):
        if k in loose:
            d, at = (np.concatenate(z) for z in zip(*loose.pop(k)))
            order = np.argsort(d)
            d, at = d[order], at[order]
        else:
            here = keys[begins[k] : begins[k + 1]]
            here.sort()
        held = f + np.flatnonzero(counts[0][f : l + 1])
        edges = np.cumsum(counts[0][held])
        i = j = 0
        for c in np.unique(np.append(np.searchsorted(edges, np.arange(CHUNK, size[k], CHUNK)), len(edges) - 1)).tolist():
            to = int(edges[c])
            v, s = (here[i:to] >> bits, (here[i:to] & low).astype(np.intp)) if parts[k][3] else (d[i:to], at[i:to])
            far = other[s]
            head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            if len(head) == len(v):
                rank = np.arange(i + 1, to + 1) + below
            else:
                m = np.diff(np.append(head, len(v)))
                rank = np.repeat(below + i + head + (m + 1) / 2, m)
            rr, rm = rr + rank @ rank, rm + rank @ far
            mm += own[held[j : c + 1]] @ np.add.reduceat(far, np.append(i, edges[j:c]) - i)
            i, j = to, c + 1
        below += size[k]
    return rr, rm, mm
