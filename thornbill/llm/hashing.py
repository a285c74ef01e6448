"""Rolling hashes over code points, vectorised per text."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x + _ODD).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE, np.uint64)])


_POWERS = Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rolling:
    """Hashes of any stretches of one sequence of code points, in constant time each."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        _POWERS.reach(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64)) * _POWERS.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the stretches from ``start`` up to ``end``; equal stretches have equal hashes wherever they are."""
        return mix((self.sums[end] - self.sums[start]) * _POWERS.down[start] + (end - start).astype(np.uint64))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive keys, from running minima of blocks in both directions."""
    n = len(keys)
    if n < width:
        return keys[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
