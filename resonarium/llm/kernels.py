"""Array kernels over Arrow text columns: words, word fingerprints, window fingerprints.

All work on the raw UTF-8 bytes of many texts at once. Fingerprints of words of
up to LONG bytes and of windows are 64-bit polynomial sums of fixed random
values, those of longer words are XXH3: equal sequences always agree, different
ones with probability near 2**-57 a pair. (Sums lose a bit with each doubling of
the length, so they are not used for long words.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of a word, above which its fingerprint is no polynomial sum.
LONG = 64

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
P = np.uint64(int(_RNG.integers(0, 2**61)) * 8 + 3)
Q = np.uint64(int(_RNG.integers(0, 2**61)) * 8 + 5)
MIX = np.uint64(int(_RNG.integers(0, 2**62)) * 4 + 1)
P_INV, Q_INV = np.uint64(pow(int(P), -1, 2**64)), np.uint64(pow(int(Q), -1, 2**64))
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    for which in (int(base),):
        have = _POWERS.get((which, 0))
        if have is None or len(have) < n:
            a = np.full(max(n, 1), base, np.uint64)
            a[0] = 1
            have = _POWERS[(which, 0)] = np.cumprod(a, dtype=np.uint64)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each text (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]  # a word never spans two texts
    begin[cut] = inside[cut]
    stop[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_CODE[data] * powers(P, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(P_INV, n)[starts]
    out = mixed(h + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        import xxhash

        out[long] = [xxhash.xxh3_64_intdigest(data[i:j].tobytes()) for i, j in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def window_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of `size` words starting at each word; the last size-1 are missing."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * powers(Q, n), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * powers(Q_INV, n)[: n - size + 1])


def within(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which window starts have their whole window in one text; first: as from word_bounds."""
    ok = np.zeros(max(0, n - size + 1), bool)
    room = np.diff(first) - size + 1
    starts, room = first[:-1][room > 0], room[room > 0]
    if len(starts):
        mark = np.zeros(len(ok) + 1, np.int32)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + room, -1)
        ok = np.cumsum(mark[:-1]) > 0
    return ok


def spread(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words beginning at one of `starts`."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + size, n), -1)
    return np.cumsum(mark[:-1]) > 0


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts texts into runs of at most `most` bytes (one text at least)."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def release() -> None:
    """Gives freed memory back to the system: idle workers wait for their next task beside a full JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it keeps what it has


def batch_slices(batches, column: str, most: int):
    """Yields (batch, i, j): row runs whose texts in `column` hold at most `most` bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        _, offsets = buffers(col)
        for i, j in slices(offsets, most):
            yield b.slice(i, j - i)
        del b, col, offsets
        release()
