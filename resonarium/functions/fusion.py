"""Fusion of feature blocks from sums of products (numpy only).

Every method here works on the features' Gram matrix, which Spark sums in one
pass over the observations; scores are one more pass.
"""

from __future__ import annotations

import numpy as np


def cut(blocks: list[int]) -> list[slice]:
    ends = np.cumsum(blocks)
    return [slice(e - b, e) for b, e in zip(blocks, ends)]


def psd_eigh(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, none negative, and vectors, each with its largest part positive."""
    w, v = np.linalg.eigh((g + g.T) / 2)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    return w, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def mfa(g: np.ndarray, blocks: list[int], ncomp: int = 2) -> dict:
    """Multiple factor analysis; g: sums of products of the centred features. scores = centred features @ weights."""
    at = cut(blocks)
    w = np.array([1 / psd_eigh(g[s, s])[0][0] for s in at])
    scale = np.concatenate([np.full(b, np.sqrt(x)) for b, x in zip(blocks, w)])
    ev, v = psd_eigh(g * np.outer(scale, scale))
    v = v[:, :ncomp]
    return {
        "eigenvalues": ev[:ncomp],
        "explained": (ev / ev.sum())[:ncomp],
        "contributions": np.array([(v[s] ** 2).sum(0) for s in at]),
        "block_weights": w,
        "weights": scale[:, None] * v,
    }


def cca(cov: np.ndarray, p: int, n: int, ncomp: int | None = None, lambda_x: float = 0, lambda_y: float = 0) -> dict:
    """Canonical correlations from the covariance of (x, y); p features of x."""
    cxx, cyy, cxy = cov[:p, :p], cov[p:, p:], cov[:p, p:]
    q = len(cyy)
    lambda_x = 1e-3 * np.diag(cxx).mean() if lambda_x == 0 and p >= n else lambda_x
    lambda_y = 1e-3 * np.diag(cyy).mean() if lambda_y == 0 and q >= n else lambda_y

    def root(c: np.ndarray, ridge: float) -> np.ndarray:
        w, v = np.linalg.eigh(c + ridge * np.eye(len(c)))
        return (v / np.sqrt(np.maximum(w, 1e-10))) @ v.T

    ix, iy = root(cxx, lambda_x), root(cyy, lambda_y)
    u, s, vt = np.linalg.svd(ix @ cxy @ iy)
    k = min(ncomp or len(s), len(s))
    return {"cor": np.minimum(s[:k], 1), "xcoef": ix @ u[:, :k], "ycoef": iy @ vt.T[:, :k]}


def pls(g: np.ndarray, p: int, n: int, ncomp: int = 2) -> dict:
    """Two-block PLS with each block deflated by its own score, in sums of products alone. scores = centred features @ rotations."""
    k = min(ncomp, p, len(g) - p)
    gxx, gyy, gxy = g[:p, :p].copy(), g[p:, p:].copy(), g[:p, p:].copy()
    rx, ry = np.eye(p), np.eye(len(gyy))
    out = {"covariance": [], "correlation": [], "xweights": [], "yweights": [], "xrotation": [], "yrotation": []}
    for _ in range(k):
        u, s, vt = np.linalg.svd(gxy)
        w, c = u[:, 0], vt[0]
        sign = np.sign(w[np.abs(w).argmax()])
        w, c = w * sign, c * sign
        tt, uu = w @ gxx @ w, c @ gyy @ c
        out["covariance"].append(s[0] / (n - 1))
        out["correlation"].append(w @ gxy @ c / np.sqrt(tt * uu))
        out["xweights"].append(w)
        out["yweights"].append(c)
        out["xrotation"].append(rx @ w)
        out["yrotation"].append(ry @ c)
        # the score t = X w takes X to X (1 - w p'), p = X't / t't
        mx, my = np.eye(p) - np.outer(w, gxx @ w / tt), np.eye(len(c)) - np.outer(c, gyy @ c / uu)
        gxx, gyy, gxy = mx.T @ gxx @ mx, my.T @ gyy @ my, mx.T @ gxy @ my
        rx, ry = rx @ mx, ry @ my
    return {a: np.array(b) for a, b in out.items()}


def jive(g: np.ndarray, blocks: list[int], rank_joint: int = 1, rank_individual=1, scale: bool = True, max_iter: int = 1000, tol: float = 1e-8) -> dict:
    """Joint and individual structure; g: sums of products of the centred features.

    With X (observations x features) everything the alternation needs is of the
    form X M for a small matrix M: the joint part X J, the individual part of
    block k X A_k. So only M is iterated. joint = X @ J, individual = X @ A,
    joint scores = X @ S.
    """
    at, n = cut(blocks), len(g)
    ri = [rank_individual] * len(blocks) if np.isscalar(rank_individual) else list(rank_individual)
    fro = np.array([np.sqrt(max(np.trace(g[s, s]), 0)) for s in at])
    fro[fro == 0] = 1
    if scale:
        d = np.concatenate([np.full(b, 1 / f) for b, f in zip(blocks, fro)])
        g = g * np.outer(d, d)
    else:
        d = np.ones(n)
    each = [np.zeros((n, n)) for _ in blocks]  # column block k of the individual part, as X @ M
    place = [np.eye(n)[:, s] for s in at]
    joint, before, steps = np.zeros((n, n)), None, 0
    for steps in range(1, max_iter + 1):
        rest = np.eye(n) - sum(each)
        ev, v = psd_eigh(rest.T @ g @ rest)
        v, ev = v[:, :rank_joint], ev[:rank_joint]
        good = ev > 1e-12 * max(ev.max(), 1e-300)
        score = (rest @ v[:, good]) / np.sqrt(ev[good])  # unit scores are X @ score
        joint = rest @ v @ v.T
        for k, s in enumerate(at):
            m = place[k] - joint[:, s]
            m = m - score @ (score.T @ g @ m)
            w, u = psd_eigh(m.T @ g @ m)
            u = u[:, : ri[k]]
            each[k] = np.zeros((n, n))
            each[k][:, s] = m @ u @ u.T
        if before is not None:
            gap = joint - before
            size = np.trace(joint.T @ g @ joint)
            if np.trace(gap.T @ g @ gap) / max(size, np.finfo(float).eps) < tol:
                break
        before = joint
    total = [np.trace(g[s, s]) for s in at]
    share = lambda m, k, s: np.trace(m[:, s].T @ g @ m[:, s]) / total[k]
    jv = np.array([share(joint, k, s) for k, s in enumerate(at)])
    av = np.array([share(each[k], k, s) for k, s in enumerate(at)])
    return {"joint_share": jv, "individual_share": av, "residual_share": 1 - jv - av, "J": d[:, None] * joint, "A": d[:, None] * sum(each), "S": d[:, None] * score, "iterations": steps}


def coupled_nmf(x, y, rank: int, rng: np.random.Generator, max_iter: int = 500, tol: float = 1e-7) -> dict:
    """One start of the factorization X = W Hx, Y = W Hy by multiplicative updates."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if (x < 0).any() or (y < 0).any():
        raise ValueError("blocks must not be negative")
    eps = 1e-10
    w, hx, hy = rng.random((len(x), rank)), rng.random((rank, x.shape[1])), rng.random((rank, y.shape[1]))
    last = np.inf
    for it in range(1, max_iter + 1):
        w *= (x @ hx.T + y @ hy.T) / (w @ (hx @ hx.T + hy @ hy.T) + eps)
        ww = w.T @ w
        hx *= (w.T @ x) / (ww @ hx + eps)
        hy *= (w.T @ y) / (ww @ hy + eps)
        if it % 25 == 0 or it == max_iter:
            now = ((x - w @ hx) ** 2).sum() + ((y - w @ hy) ** 2).sum()
            if np.isfinite(last) and abs(last - now) < tol * (last + eps):
                break
            last = now
    rx, ry = ((x - w @ hx) ** 2).sum(), ((y - w @ hy) ** 2).sum()
    nx, ny = (x**2).sum(), (y**2).sum()
    return {"W": w, "Hx": hx, "Hy": hy, "vaf_x": 1 - rx / nx, "vaf_y": 1 - ry / ny, "vaf": 1 - (rx + ry) / (nx + ny), "resid": rx + ry, "iterations": it}


def factor_analysis(corr: np.ndarray, factors: int, steps: int = 5000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood loadings of a correlation matrix (varimax-rotated) and uniquenesses, by expectation and maximization with over-relaxation by restarts of scale."""
    p = len(corr)
    psi = np.clip(1 / np.diag(np.linalg.pinv(corr)) * (1 - 0.5 * factors / p), 0.005, 1)

    def loadings(psi: np.ndarray) -> np.ndarray:
        r = np.sqrt(psi)
        w, v = np.linalg.eigh(corr / np.outer(r, r))
        w, v = w[::-1][:factors], v[:, ::-1][:, :factors]
        return r[:, None] * v * np.sqrt(np.maximum(w - 1, 0))

    for _ in range(steps):
        load = loadings(psi)
        model = load @ load.T + np.diag(psi)
        inv = np.linalg.inv(model)
        b = load.T @ inv
        ezz = np.eye(factors) - b @ load + b @ corr @ b.T
        load = corr @ b.T @ np.linalg.inv(ezz)
        new = np.clip(np.diag(corr - load @ b @ corr), 0.005, 1)
        done = np.abs(new - psi).max() < tol
        psi = new
        if done:
            break
    return varimax(loadings(psi)), psi


def varimax(load: np.ndarray, steps: int = 1000, tol: float = 1e-8) -> np.ndarray:
    """Varimax rotation of rows scaled to unit length; columns in order of their sums of squares, each of positive sum."""
    p, k = load.shape
    if k < 2:
        return load * (np.sign(load.sum(0)) + (load.sum(0) == 0))
    h = np.sqrt((load**2).sum(1))
    h[h == 0] = 1
    z, r, last = load / h[:, None], np.eye(k), 0.0
    for _ in range(steps):
        a = z @ r
        u, s, vt = np.linalg.svd(z.T @ (a**3 - a * (a**2).mean(0)))
        r = u @ vt
        if s.sum() < last * (1 + tol):
            break
        last = s.sum()
    out = load @ r
    out = out[:, np.argsort(-(out**2).sum(0), kind="stable")]
    return out * np.where(out.sum(0) < 0, -1, 1)


def deviation_model(cov: np.ndarray, n: int, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Principal directions of a reference that hold `share` of its variance, and their deviations."""
    ev, v = psd_eigh(cov)
    k = max(1, int(np.searchsorted(np.cumsum(ev) / ev.sum(), share - 1e-12) + 1))
    return v[:, :k], np.maximum(np.sqrt(ev[:k]), 1e-9)
