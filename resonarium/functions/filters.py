"""Zero-phase filters, analytic signals, resampling and tapers over arrays (numpy only).

All take arrays whose last axis is time and work on many signals at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from resonarium.functions import recursive


def hann(n: int) -> np.ndarray:
    """Symmetric Hann window; one sample gives 1."""
    return np.ones(max(n, 0)) if n <= 1 else 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))


def hamming(n: int) -> np.ndarray:
    return np.ones(max(n, 0)) if n <= 1 else 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def window(spec, n: int) -> np.ndarray:
    """A window by name (hann, hanning, hamming), or n given weights."""
    if isinstance(spec, str):
        made = {"hann": hann, "hanning": hann, "hamming": hamming}.get(spec)
        if made is None:
            raise ValueError(f"unknown window {spec!r}")
        return made(n)
    w = np.asarray(spec, float)
    if w.shape != (n,):
        raise ValueError(f"a window of {n} weights is needed")
    return w


def _through_gain(x: np.ndarray, gain, pad: int) -> np.ndarray:
    """Multiplies spectra by a real gain after odd reflection at both ends."""
    n = x.shape[-1]
    pad = min(pad, n - 1)
    left = 2 * x[..., :1] - x[..., pad:0:-1]
    right = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    full = np.concatenate([left, x, right], -1) if pad > 0 else x
    size = 1 << int(np.ceil(np.log2(2 * full.shape[-1])))
    out = np.fft.irfft(np.fft.rfft(full, size) * gain(size), size)
    return out[..., pad : pad + n]


def _brick(x: np.ndarray, keep) -> np.ndarray:
    n = x.shape[-1]
    return np.fft.irfft(np.fft.rfft(x) * keep(np.arange(n // 2 + 1)), n)


def check_band(low: float, high: float, sr: float) -> None:
    if not (low > 0 and high > 0):
        raise ValueError("cutoffs must be positive")
    if low >= high:
        raise ValueError("the lower cutoff must be below the upper one")
    if high >= sr / 2:
        raise ValueError("the upper cutoff must be below half the sampling rate")


def relative(low: float | None, high: float, sr: float, clamp: bool) -> tuple[float | None, float]:
    """Cutoffs as shares of half the rate, held within 0.01 and 0.99 if `clamp`."""
    held = lambda v: None if v is None else min(max(v / (sr / 2), 0.01), 0.99) if clamp else v / (sr / 2)
    return held(low), held(high)


@lru_cache(maxsize=256)
def _system(order: int, low: float | None, high: float) -> recursive.System:
    return recursive.System(recursive.butterworth(order, low, high))


def bandpass(x: np.ndarray, low: float, high: float, sr: float, order: int = 4, kind: str = "butter", clamp: bool = True) -> np.ndarray:
    """Zero-phase band-pass. kind: butter or recursive (the same Butterworth gain), fir (20 x order taps) or fft (ideal, inclusive edges).

    butter and fir continue the signal by odd reflection; recursive runs its
    sections forward and backward from rest, with zeros after the end.
    """
    x = np.asarray(x, float)
    check_band(low, high, sr)
    if kind == "fft":
        f = lambda k: k * sr / x.shape[-1]
        return _brick(x, lambda k: (f(k) >= low) & (f(k) <= high))
    lo, hi = relative(low, high, sr, clamp)
    if kind == "recursive":
        return recursive.there_and_back(x, _system(order, lo, hi), recursive.padding(order, True))
    if kind == "butter":
        w1, w2 = np.tan(np.pi * lo / 2), np.tan(np.pi * hi / 2)

        def gain(size: int) -> np.ndarray:
            w = np.tan(np.pi * np.arange(size // 2 + 1) / size)
            with np.errstate(all="ignore"):
                level = (w * w - w1 * w2) / (w * (w2 - w1))
                out = 1 / (1 + level ** (2 * order))
            return np.nan_to_num(out, nan=0.0)

        slow = int(np.ceil(6 / max(hi - lo, 1e-3)))
        return _through_gain(x, gain, max(3 * (2 * order + 1), slow))
    if kind == "fir":
        taps = 20 * order
        m = np.arange(taps + 1) - taps / 2
        h = (hi * np.sinc(hi * m) - lo * np.sinc(lo * m)) * hamming(taps + 1)
        mid = (lo + hi) / 2
        h = h / np.abs(np.sum(h * np.exp(-1j * np.pi * mid * m)))
        return _through_gain(x, lambda size: np.abs(np.fft.rfft(h, size)) ** 2, 3 * taps)
    raise ValueError(f"unknown filter {kind!r}")


def lowpass(x: np.ndarray, cutoff: float, sr: float, order: int = 8, kind: str = "butter") -> np.ndarray:
    """Zero-phase low-pass; a cutoff at or above half the rate changes nothing."""
    x = np.asarray(x, float)
    if cutoff >= sr / 2:
        return x
    if kind == "fft":
        return _brick(x, lambda k: k * sr / x.shape[-1] <= cutoff)
    _, hi = relative(None, cutoff, sr, True)
    if kind == "recursive":
        return recursive.there_and_back(x, _system(order, None, hi), recursive.padding(order, False))
    w0 = np.tan(np.pi * hi / 2)

    def gain(size: int) -> np.ndarray:
        return 1 / (1 + (np.tan(np.pi * np.arange(size // 2 + 1) / size - 1e-15) / w0) ** (2 * order))

    return _through_gain(x, gain, 3 * (order + 1) + int(np.ceil(3 / w0)))


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal with its Hilbert transform as imaginary part."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    if n == 0:
        return x.astype(complex)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def band_analytic(x: np.ndarray, low: float, high: float, sr: float, order: int = 4, kind: str = "butter") -> np.ndarray:
    return analytic(bandpass(x, low, high, sr, order, kind))


def half_even(v: float) -> int:
    """Rounds halves to the even neighbour."""
    return int(np.round(v))


def resample_linear(x: np.ndarray, n: int) -> np.ndarray:
    """n points on a grid that has both ends in common with x."""
    x = np.asarray(x, float)
    old = x.shape[-1]
    u = np.linspace(0, old - 1, n) if n > 1 else np.zeros(n)
    k = np.minimum(np.floor(u).astype(int), max(old - 2, 0))
    w = u - k
    return x[..., k] * (1 - w) + x[..., np.minimum(k + 1, old - 1)] * w


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y); linear beyond the ends."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    diag, rhs, upper = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope), h[1:-1]
    c, d = np.zeros(n - 2), np.zeros(n - 2)
    for i in range(n - 2):
        low = h[i] if i else 0.0
        den = diag[i] - low * (c[i - 1] if i else 0.0)
        c[i] = upper[i] / den if i < n - 3 else 0.0
        d[i] = (rhs[i] - low * (d[i - 1] if i else 0.0)) / den
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = d[i] - c[i] * m[i + 2]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[k]
    b = slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6
    inside = y[k] + t * (b + t * (m[k] / 2 + t * (m[k + 1] - m[k]) / (6 * h[k])))
    end = slope[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6
    return np.where(at < x[0], y[0] + (at - x[0]) * b, np.where(at > x[-1], y[-1] + (at - x[-1]) * end, inside))


def resample_fft(x: np.ndarray, n: int) -> np.ndarray:
    """Resampling by cutting or padding the spectrum; amplitudes are kept and an even-length end bin is shared."""
    x = np.asarray(x, float)
    old = len(x)
    if n == old:
        return x.copy()
    spectrum, out = np.fft.fft(x), np.zeros(n, complex)
    m = min(n, old)
    half = (m + 1) // 2
    out[:half] = spectrum[:half]
    if half > 1:
        out[-(half - 1) :] = spectrum[-(half - 1) :]
    if m % 2 == 0:
        k = m // 2
        if n > old:
            out[k] = out[-k] = spectrum[k] / 2
        else:
            out[k] = (spectrum[k] + spectrum[-k]) / 2
    return np.fft.ifft(out).real * n / old


def to_rate(x: np.ndarray, sr: float, target: float, method: str = "linear", kind: str = "butter") -> np.ndarray:
    """A signal at another rate, low-passed at 0.9 of half the target before it is thinned."""
    x = np.asarray(x, float)
    if abs(sr - target) < 1e-6:
        return x
    if target < sr:
        x = lowpass(x, 0.9 * target / 2, sr, kind=kind)
    n = half_even(len(x) / sr * target)
    if method == "linear":
        return resample_linear(x, n)
    if method == "spline":
        return natural_spline(np.linspace(0, 1, len(x)), x, np.linspace(0, 1, n))
    if method == "fft":
        return resample_fft(x, n)
    raise ValueError(f"unknown method {method!r}")


def at_rate(y, sr_y: float, sr_x: float, kind: str = "butter") -> np.ndarray:
    """A signal of rate sr_y at rate sr_x: low-passed first where it is faster, then linear in time."""
    y = np.asarray(y, float)
    if sr_x < sr_y:
        y = lowpass(y, 0.9 * sr_x / 2, sr_y, kind=kind)
    span = (len(y) - 1) / sr_y
    return np.interp(np.linspace(0, span, half_even(span * sr_x) + 1), np.arange(len(y)) / sr_y, y)


def match_pair(x, y, sr_x: float, sr_y: float, kind: str = "butter") -> tuple[np.ndarray, np.ndarray]:
    """y at the rate of x, both cut to the shorter length; signals of equal rate are left as they are."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if sr_x == sr_y:
        return x, y
    y = at_rate(y, sr_y, sr_x, kind)
    m = min(len(x), len(y))
    return x[:m], y[:m]


def dpss(n: int, nw: float, k: int | None = None) -> np.ndarray:
    """The k Slepian tapers of most concentration (k x n), each of unit norm, first element not negative.

    From the tridiagonal matrix that shares them as eigenvectors. Beyond 1024
    points, tapers of a shorter window are stretched and refined by
    Rayleigh-quotient iteration, which solves tridiagonal systems only.
    """
    k = min(int(2 * nw - 1) if k is None else k, n)
    if n <= 1024:
        t = np.arange(n)
        diag = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * nw / n)
        off = t[1:] * (n - t[1:]) / 2
        _, v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
        out = v[:, ::-1][:, :k].T
    else:
        t = np.arange(n)
        diag = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * nw / n)
        off = t[1:] * (n - t[1:]) / 2
        out = np.array([np.interp(np.linspace(0, 1, n), np.linspace(0, 1, 1024), v) for v in dpss(1024, nw, k)])
        for i in range(k):
            v = out[i] / np.linalg.norm(out[i])
            for _ in range(4):
                av = diag * v
                av[:-1] += off * v[1:]
                av[1:] += off * v[:-1]
                mu = v @ av
                if np.linalg.norm(av - mu * v) < 1e-9 * abs(mu):
                    break
                v = _tridiagonal_solve(diag - mu, off, v)
                v /= np.linalg.norm(v)
            out[i] = v
    return out * np.where(out[:, :1] < 0, -1, 1)


def _tridiagonal_solve(diag: np.ndarray, off: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = len(diag)
    c, d = np.zeros(n), np.zeros(n)
    tiny = 1e-12 * np.abs(diag).max()
    for i in range(n):
        low = off[i - 1] if i else 0.0
        den = diag[i] - low * (c[i - 1] if i else 0.0)
        den = den if abs(den) > tiny else tiny
        c[i] = off[i] / den if i < n - 1 else 0.0
        d[i] = (b[i] - low * (d[i - 1] if i else 0.0)) / den
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d
