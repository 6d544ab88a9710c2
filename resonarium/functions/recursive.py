"""Recursive filters as linear systems: Butterworth sections, blocks of samples, and maps of states.

A cascade of second-order sections is one system s' = A s + B x, y = C s + D x
with two states a section. Over a run of samples it is an affine map of states,
s_out = A**n s_in + b, so runs can be worked on apart and put together after.
"""

from __future__ import annotations

import numpy as np

#: Samples that one matrix product takes.
BLOCK = 64


def butterworth(order: int, low: float | None, high: float) -> np.ndarray:
    """Sections (K x 6: b0 b1 b2 1 a1 a2) of a low-pass (low is None) or a band-pass; cutoffs as shares of half the rate."""
    if order < 1:
        raise ValueError("the order must be positive")
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    upper = [p for p in poles if p.imag > 1e-9]
    real = order % 2 == 1
    to_z = lambda s: (1 + s) / (1 - s)  # noqa: E731  the bilinear map
    out = []
    if low is None:
        w = np.tan(np.pi * high / 2)
        for p in upper:
            z = to_z(w * p)
            out.append([1, 2, 1, 1, -2 * z.real, abs(z) ** 2])
        if real:
            out.append([1, 1, 0, 1, -to_z(-w), 0])
        at = 1.0 + 0j
    else:
        w1, w2 = np.tan(np.pi * low / 2), np.tan(np.pi * high / 2)
        width, middle = w2 - w1, w1 * w2
        for p in upper:
            root = np.sqrt((p * width) ** 2 - 4 * middle + 0j)
            for z in (to_z((p * width + root) / 2), to_z((p * width - root) / 2)):
                out.append([1, 0, -1, 1, -2 * z.real, abs(z) ** 2])
        if real:
            root = np.sqrt(width**2 - 4 * middle + 0j)
            z1, z2 = to_z((-width + root) / 2), to_z((-width - root) / 2)
            out.append([1, 0, -1, 1, -(z1 + z2).real, (z1 * z2).real])
        at = np.exp(2j * np.arctan(np.sqrt(middle)))
    out = np.array(out, float)
    powers = at ** -np.arange(3)
    out[:, :3] /= np.abs(out[:, :3] @ powers / (out[:, 3:] @ powers))[:, None]
    return out


class System:
    """The cascade of sections as one linear system."""

    def __init__(self, sections: np.ndarray):
        d = 2 * len(sections)
        a, b, c, gain = np.zeros((d, d)), np.zeros(d), np.zeros(d), 1.0
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            own, into = slice(2 * i, 2 * i + 2), np.array([b1 - a1 * b0, b2 - a2 * b0])
            a[own, own] = [[-a1, 1], [-a2, 0]]
            a[own, : 2 * i] = np.outer(into, c[: 2 * i])
            b[own] = into * gain
            c[: 2 * i] *= b0
            c[2 * i] = 1
            gain *= b0
        self.a, self.b, self.c, self.gain, self.size = a, b, c, gain, d
        self._powers: dict[int, np.ndarray] = {}
        self._blocks: dict[int, tuple] = {}

    def power(self, n: int) -> np.ndarray:
        """A**n: what is left of a state after n samples."""
        if n not in self._powers:
            self._powers[n] = np.linalg.matrix_power(self.a, n)
        return self._powers[n]

    def block(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """H (n x d), T (n x n), G (d x n): y = H s + T x and s' = A**n s + G x."""
        if n not in self._blocks:
            h, g = np.zeros((n, self.size)), np.zeros((self.size, n))
            row, column = self.c.copy(), self.b.copy()
            for i in range(n):
                h[i], g[:, n - 1 - i] = row, column
                row, column = row @ self.a, self.a @ column
            answer = np.concatenate([[self.gain], h[: n - 1] @ self.b])
            t = np.zeros((n, n))
            for i in range(n):
                t[i:, i] = answer[: n - i]
            self._blocks[n] = h, t, g
        return self._blocks[n]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Filtered x (last axis is time) and the state after it."""
        x = np.asarray(x, float)
        s = np.zeros((*x.shape[:-1], self.size)) if state is None else np.asarray(state, float)
        y = np.empty_like(x)
        for at in range(0, x.shape[-1], BLOCK):
            part = x[..., at : at + BLOCK]
            m = part.shape[-1]
            h, t, g = self.block(m)
            y[..., at : at + m] = s @ h.T + part @ t.T
            s = s @ self.power(m).T + part @ g.T
        return y, s

    def fading(self, state: np.ndarray, n: int) -> np.ndarray:
        """What a state alone adds to the n samples after it."""
        return self.run(np.zeros(n), state)[0]

    def turning(self, pad: int) -> np.ndarray:
        """The map from the state at the end of a signal to that in which the way back begins, `pad` zeros beyond it."""
        h, _, g = self.block(pad)
        return g @ h[::-1]


def padding(order: int, band: bool) -> int:
    """Zeros after a signal before the way back: twice the number of coefficients of the whole filter."""
    return 2 * ((2 if band else 1) * order + 1)


def there_and_back(x: np.ndarray, system: System, pad: int) -> np.ndarray:
    """Forward from rest through x and `pad` zeros, then backward from rest; no phase is left."""
    x = np.asarray(x, float)
    y, s = system.run(x)
    back, _ = system.run(y[..., ::-1], s @ system.turning(pad).T)
    return back[..., ::-1]
