"""Directed coupling of arrays: Granger causality, multivariate models, transfer entropy (numpy only)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from resonarium.functions.filters import dpss, hann

EPS = np.finfo(float).eps


def lagged(x: np.ndarray, order: int) -> np.ndarray:
    """Columns x[t-1] .. x[t-order] for t = order .. n-1."""
    return np.stack([x[order - k : len(x) - k] for k in range(1, order + 1)], 1)


def ridge_fit(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Least squares from sums of products with a ridge of 1e-8 of the largest; zeros where that is singular."""
    try:
        return np.linalg.solve(gram + np.eye(len(gram)) * 1e-8 * np.abs(np.diag(gram)).max(), cross)
    except np.linalg.LinAlgError:
        return np.zeros_like(cross)


def residual_variance(gram: np.ndarray, cross: np.ndarray, square: float, n: int) -> float:
    b = ridge_fit(gram, cross)
    return float((square - 2 * b @ cross + b @ gram @ b) / n)


def granger_from_gram(g: np.ndarray, n: int, order: int) -> float:
    """Causality from sums of products of (target, its lags, the driver's lags) over n rows."""
    own, full = np.arange(1, order + 1), np.arange(1, 2 * order + 1)
    var = [residual_variance(g[np.ix_(k, k)], g[k, 0], g[0, 0], n) for k in (own, full)]
    if min(var) < EPS:
        return 0.0
    return max(0.0, float(np.log(var[0] / var[1])))


def gram(driver: np.ndarray, target: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    z = np.column_stack([target[order:], lagged(target, order), lagged(driver, order)])
    return z.T @ z, len(z)


def spectral_granger_from_gram(g: np.ndarray, n: int, order: int, sr: float, freq_range, points: int = 128) -> float:
    """Band mean of the log ratio of the target's own-lag spectra in the two models; an approximation."""
    own, full = np.arange(1, order + 1), np.arange(1, 2 * order + 1)
    f = np.linspace(0, sr / 2, points)
    power = []
    for k in (own, full):
        b = ridge_fit(g[np.ix_(k, k)], g[k, 0])[:order]
        v = residual_variance(g[np.ix_(k, k)], g[k, 0], g[0, 0], n)
        h = 1 - np.exp(-2j * np.pi * np.outer(f, np.arange(1, order + 1)) / sr) @ b
        power.append(v / np.abs(h) ** 2)
    ok = (power[0] > EPS) & (power[1] > EPS)
    value = np.where(ok, np.maximum(0, np.log(np.where(ok, power[0], 1) / np.where(ok, power[1], 1))), 0)
    band = value[(f >= freq_range[0]) & (f <= freq_range[1])]
    return max(0.0, float(band.mean())) if len(band) else 0.0


def granger(x, y, sr: float, order: int = 5, freq_range=None) -> dict:
    n = min(len(x), len(y))
    if n <= 2 * order + 1:
        raise ValueError("the signals are too short for this order")
    x, y = (np.asarray(v, float)[:n] - np.mean(v[:n]) for v in (x, y))
    out = []
    for driver, target in ((x, y), (y, x)):
        g, rows = gram(driver, target, order)
        out.append(granger_from_gram(g, rows, order) if freq_range is None else spectral_granger_from_gram(g, rows, order, sr, freq_range))
    return {"gc_xy": out[0], "gc_yx": out[1], "net_gc": out[0] - out[1], "order": order, "method": "parametric"}


def segment_starts(n: int, size: int, overlap: float) -> np.ndarray:
    step = max(1, int(np.floor(size * (1 - overlap))))
    return np.arange(0, n - size + 1, step)


def default_segment(n: int, overlap: float) -> int:
    """The largest power of two up to 512 that leaves at least two segments."""
    size = 512
    while size > 16 and len(segment_starts(n, size, overlap)) < 2:
        size //= 2
    return size


def check_segments(n: int, size: int, n_fft: int, overlap: float, estimator: str, time_bandwidth: float) -> None:
    if not 0 <= overlap < 1:
        raise ValueError("overlap must lie in [0, 1)")
    if estimator not in ("multitaper", "welch"):
        raise ValueError(f"unknown estimator {estimator!r}")
    if size < 16 or size > n:
        raise ValueError("segment_length must lie between 16 and the signal's length")
    if n_fft % 2 or n_fft < size:
        raise ValueError("n_fft must be even and at least segment_length")
    if estimator == "multitaper" and not 1 < time_bandwidth < size / 2:
        raise ValueError("time_bandwidth must exceed 1 and lie below half the segment")
    if estimator == "welch" and len(segment_starts(n, size, overlap)) < 2:
        raise ValueError("two complete segments are needed")


@lru_cache(maxsize=8)
def tapers_of(estimator: str, size: int, time_bandwidth: float, n_tapers: int | None) -> np.ndarray:
    """Tapers by rows: Slepian ones, or one Hann window."""
    if estimator == "welch":
        return hann(size)[None, :]
    return dpss(size, time_bandwidth, int(np.floor(2 * time_bandwidth)) - 1 if n_tapers is None else n_tapers)


def cross_spectra(x, y, sr: float, estimator: str = "multitaper", n_fft=None, segment_length=None, overlap: float = 0.5, time_bandwidth: float = 4, n_tapers=None):
    """One-sided spectral matrices (bins x 2 x 2), Hermitian, averaged over segments and tapers."""
    n = len(x)
    size = default_segment(n, overlap) if segment_length is None else int(segment_length)
    n_fft = 1 << int(np.ceil(np.log2(max(2, size)))) if n_fft is None else int(n_fft)
    check_segments(n, size, n_fft, overlap, estimator, time_bandwidth)
    at, tapers = segment_starts(n, size, overlap), tapers_of(estimator, size, time_bandwidth, n_tapers)
    z = np.stack([np.asarray(x, float), np.asarray(y, float)])[:, at[:, None] + np.arange(size)]
    z = z - z.mean(-1, keepdims=True)
    f = np.fft.fft(z[:, :, None, :] * tapers, n_fft).reshape(2, -1, n_fft)
    if f.shape[1] < 2:
        raise ValueError("two realizations are needed")
    norm = sr * (tapers**2).sum(1)
    f = f / np.sqrt(np.tile(norm, len(at)))[None, :, None]
    s = np.einsum("arf,brf->fab", f, f.conj())[: n_fft // 2 + 1] / f.shape[1]
    s[1:-1] *= 2
    return (s + s.conj().transpose(0, 2, 1)) / 2, np.arange(n_fft // 2 + 1) * sr / n_fft


def regularized(s: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Eigenvalues below floor x mean power are raised to that; a matrix that is clearly indefinite is refused."""
    scale = np.einsum("fii->f", s).real / s.shape[1]
    if not (np.isfinite(scale).all() and (scale > 0).all()):
        raise ValueError("the spectral matrix has no positive power")
    values, vectors = np.linalg.eigh(s)
    if (values.min(1) < -max(100 * floor, 1e-8) * scale).any():
        raise ValueError("the spectral matrix is indefinite")
    values = np.maximum(values, (floor * scale)[:, None])
    out = (vectors * values[:, None, :]) @ vectors.conj().transpose(0, 2, 1)
    return (out + out.conj().transpose(0, 2, 1)) / 2


def two_sided(s: np.ndarray) -> np.ndarray:
    """The matrices of all bins: both ends doubled, negative frequencies transposed."""
    return np.concatenate([2 * s[:1], s[1:-1], 2 * s[-1:], s[1:-1][::-1].transpose(0, 2, 1)])


def wilson(s: np.ndarray, tolerance: float = 1e-8, most: int = 1000) -> dict:
    """Spectral factor of a two-sided matrix spectrum (bins x n x n): H, Sigma with S = H Sigma H*.

    Newton steps on all bins at once; raises ValueError where the input is not
    Hermitian or not positive, or the iteration fails.
    """
    n_fft, n, _ = s.shape
    star = lambda a: a.conj().transpose(0, 2, 1)
    slack = min(1e-6, max(100 * tolerance, 100 * EPS))
    if np.abs(s - star(s)).max() > slack * max(1, np.abs(s).max()):
        raise ValueError("the spectrum is not Hermitian")
    lag0 = np.fft.ifft(s, axis=0)[0].real
    try:
        start = np.linalg.cholesky((lag0 + lag0.T) / 2).T
    except np.linalg.LinAlgError as e:
        raise ValueError("the covariance is not positive definite") from e
    psi = np.repeat(start[None].astype(complex), n_fft, 0)
    for step in range(1, most + 1):
        try:
            inv = np.linalg.inv(psi)
        except np.linalg.LinAlgError as e:
            raise ValueError("a spectral factor is singular") from e
        g = inv @ s @ star(inv) + np.eye(n)
        causal = np.fft.ifft((g + star(g)) / 2, axis=0)
        causal[0] = np.triu(causal[0], 1) + np.diag(np.diag(causal[0])) / 2
        causal[n_fft // 2 :] = 0
        new = psi @ np.fft.fft(causal, axis=0)
        change = np.linalg.norm(new - psi) / max(np.linalg.norm(psi), EPS)
        psi = new
        if change < tolerance:
            break
    else:
        raise ValueError(f"the factorization did not converge (relative update {change:.3g})")
    error = np.linalg.norm(psi @ star(psi) - s) / max(np.linalg.norm(s), EPS)
    if not error <= min(0.05, max(0.02, 100 * tolerance)):
        raise ValueError(f"the factor rebuilds the spectrum with an error of {error:.3g}")
    a0 = np.fft.ifft(psi, axis=0)[0]
    if np.abs(a0.imag).max() > slack * max(1, np.abs(a0.real).max()):
        raise ValueError("the factor at lag zero is not real")
    a0 = a0.real
    return {"psi": psi, "H": psi @ np.linalg.inv(a0), "Sigma": a0 @ a0.T, "iterations": step, "reconstruction_error": float(error)}


def geweke(s: np.ndarray, h: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of causality 0 to 1 and 1 to 0 in the bins of s, h."""
    out = []
    for source, target in ((0, 1), (1, 0)):
        left = sigma[source, source] - sigma[0, 1] ** 2 / sigma[target, target]
        power = s[:, target, target].real
        own = power - left * np.abs(h[:, target, source]) ** 2
        if (power <= 0).any() or (own <= 0).any():
            raise ValueError("a power ratio is not positive")
        out.append(np.maximum(0, np.log(power / own)))
    return out[0], out[1]


def trapezoid_mean(value: np.ndarray, f: np.ndarray, band) -> float:
    k = (f >= band[0]) & (f <= band[1])
    if k.sum() < 2:
        raise ValueError("the band holds fewer than two bins")
    return float(np.trapezoid(value[k], f[k]) / (f[k][-1] - f[k][0]))


def granger_nonparametric(x, y, sr: float, freq_range=None, estimator: str = "multitaper", tolerance: float = 1e-8, most: int = 1000, floor: float = 1e-10, **how) -> dict:
    n = min(len(x), len(y))
    x, y = (np.asarray(v, float)[:n] for v in (x, y))
    if n < 32 or not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("32 finite samples are needed")
    x, y = x - x.mean(), y - y.mean()
    sx, sy = np.sqrt((x**2).mean()), np.sqrt((y**2).mean())
    if min(sx, sy) <= EPS:
        raise ValueError("a signal is constant")
    s, f = cross_spectra(x / sx, y / sy, sr, estimator, **how)
    full = two_sided(regularized(s, floor))
    w = wilson(full, tolerance, most)
    m = len(f)
    xy, yx = geweke(full[:m], w["H"][:m], w["Sigma"])
    band = (f[0], f[-1]) if freq_range is None else freq_range
    a, b = trapezoid_mean(xy, f, band), trapezoid_mean(yx, f, band)
    return {"gc_xy": a, "gc_yx": b, "net_gc": a - b, "spectrum_xy": xy, "spectrum_yx": yx, "frequencies": f, "method": "nonparametric", "iterations": w["iterations"]}


def mvar_from_gram(g: np.ndarray, n: int, channels: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (order x channels x channels) and residual covariance from sums of products of (now, lag 1, .., lag order)."""
    now, past = np.arange(channels), np.arange(channels, channels * (order + 1))
    b = np.linalg.solve(g[np.ix_(past, past)], g[np.ix_(past, now)])
    sigma = (g[np.ix_(now, now)] - b.T @ g[np.ix_(past, now)]) / max(1, n - order * channels)
    return b.T.reshape(channels, order, channels).transpose(1, 0, 2), (sigma + sigma.T) / 2


def mvar_gram(x: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """x: time x channels, demeaned."""
    z = np.concatenate([x[order - k : len(x) - k] for k in range(order + 1)], 1)
    return z.T @ z, len(z)


#: Orders that are tried when none is given.
MOST_ORDER = 20


def least_aic(grams, length: int, channels: int, most: int = MOST_ORDER) -> int:
    """Order of least AIC; grams(p) gives the sums of products for p lags and their number of rows."""
    scores = {}
    for p in range(1, min(most, (length - 1) // (channels + 1)) + 1):
        g, n = grams(p)
        try:
            _, sigma = mvar_from_gram(g, n, channels, p)
        except np.linalg.LinAlgError:
            continue
        sign, level = np.linalg.slogdet(sigma)
        if sign > 0:
            scores[p] = n * level + 2 * p * channels**2
    return min(scores, key=lambda p: scores[p]) if scores else 1


def best_order(x: np.ndarray, most: int = MOST_ORDER) -> int:
    """Order of least AIC of an array, time x channels."""
    return least_aic(lambda p: mvar_gram(x, p), len(x), x.shape[1], most)


def transfer(coef: np.ndarray, f: np.ndarray, sr: float) -> tuple[np.ndarray, np.ndarray]:
    """Per frequency the matrix A = 1 - sum of coefficients and its inverse H."""
    lags = np.arange(1, len(coef) + 1)
    a = np.eye(coef.shape[1]) - np.tensordot(np.exp(-2j * np.pi * np.outer(f, lags) / sr), coef, 1)
    return a, np.linalg.inv(a)


def dtf(h: np.ndarray, normalized: bool = True, full_frequency: bool = False) -> np.ndarray:
    """Directed transfer function (frequency x target x source)."""
    m = np.abs(h)
    if not (normalized or full_frequency):
        return m
    den = np.sqrt((m**2).sum(2, keepdims=True) if not full_frequency else (m**2).sum((0, 2), keepdims=True))
    return np.where(den > 0, m / np.where(den > 0, den, 1), 0)


def pdc(a: np.ndarray, sigma: np.ndarray, generalized: bool = True) -> np.ndarray:
    """Partial directed coherence (frequency x target x source); generalized weighs targets by 1 / their residual deviation."""
    m = np.abs(a) * (1 / np.sqrt(np.diag(sigma)) if generalized else np.ones(a.shape[1]))[None, :, None]
    den = np.sqrt((m**2).sum(1, keepdims=True))
    return np.where(den > 0, m / np.where(den > 0, den, 1), 0)


def embedded(source, target, k: int = 1, l: int = 1, delay: int = 1):  # noqa: E741
    """Rows (target's future; target's past, newest first; source's past, newest first)."""
    source, target = np.asarray(source, float), np.asarray(target, float)
    now = np.arange(max(k, l) - 1, len(target) - delay)
    return target[now + delay][:, None], np.stack([target[now - d] for d in range(k)], 1), np.stack([source[now - d] for d in range(l)], 1)


def binned(m: np.ndarray, bins: int) -> np.ndarray:
    """Equal-width bins of each column, right-closed, the first closed at both ends; one number for each row."""
    code = np.zeros(len(m), np.int64)
    for c in m.T:
        edges = np.linspace(c.min(), c.max(), bins + 1)
        code = code * bins + np.clip(np.searchsorted(edges, c, side="left") - 1, 0, bins - 1)
    return code


def te_histogram(source, target, k: int = 1, l: int = 1, delay: int = 1, bins: int = 8) -> float:  # noqa: E741
    """Transfer entropy in bits from counts."""
    a, b, c = (np.unique(binned(m, bins), return_inverse=True)[1] for m in embedded(source, target, k, l, delay))
    n = len(a)
    joint = {"abc": (a, b, c), "ab": (a, b), "bc": (b, c), "b": (b,)}
    count = {}
    for name, cols in joint.items():
        _, inverse, num = np.unique(np.stack(cols), axis=1, return_inverse=True, return_counts=True)
        count[name] = num[inverse]
    return float(np.mean(np.log2(count["abc"] * count["b"] / (count["ab"] * count["bc"])))) if n else 0.0


def digamma(x) -> np.ndarray:
    """Psi of positive arguments: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def te_ksg(source, target, k: int = 1, l: int = 1, delay: int = 1, knn: int = 4, block: int = 256) -> float:  # noqa: E741
    """Transfer entropy in nats by nearest neighbours in the maximum norm, in blocks of rows."""
    yf, yp, xp = embedded(source, target, k, l, delay)
    n, total = len(yf), 0.0
    for s in range(0, n, block):
        far = lambda m: np.abs(m[s : s + block, None, :] - m[None, :, :]).max(2)  # noqa: B023, E731
        df, dp, dx = far(yf), far(yp), far(xp)
        eps = np.partition(np.maximum(np.maximum(df, dp), dx), knn, axis=1)[:, knn][:, None]
        counts = [(d < eps).sum(1) for d in (dp, np.maximum(df, dp), np.maximum(dx, dp))]
        psi = [digamma(np.maximum(c, 1)) for c in counts]
        total += float((psi[0] - psi[1] - psi[2]).sum())
    return float(digamma(np.array(float(knn)))) + total / n


def transfer_entropy(x, y, k=1, l=1, delay=1, estimator="ksg", knn=4, bins=8, effective=False, n_surrogate=19, seed=0) -> dict:  # noqa: E741
    from resonarium.functions.resampling import iaaft, rng_of

    n = min(len(x), len(y))
    x, y = np.asarray(x, float)[:n], np.asarray(y, float)[:n]
    stat = (lambda a, b: te_ksg(a, b, k, l, delay, knn)) if estimator == "ksg" else (lambda a, b: te_histogram(a, b, k, l, delay, bins))
    xy, yx = stat(x, y), stat(y, x)
    out = {"te_xy": xy, "te_yx": yx, "net_te": xy - yx}
    if effective:
        null = np.array([[stat(iaaft(x, rng_of(seed, r, 0)), y), stat(iaaft(y, rng_of(seed, r, 1)), x)] for r in range(n_surrogate)])
        out |= {"eff_te_xy": xy - null[:, 0].mean(), "eff_te_yx": yx - null[:, 1].mean(), "null_sd_xy": null[:, 0].std(ddof=1), "null_sd_yx": null[:, 1].std(ddof=1)}
    return out
