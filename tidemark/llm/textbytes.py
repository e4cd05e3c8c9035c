"""Texts as one byte array: words, lines and rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: UTF-8 bytes handled together; a longer text is handled alone. The arrays of a
#: group take about 60 times as much.
GROUP_BYTES = 256 << 10

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(pairs: list[tuple[int, int]], outside: bool) -> np.ndarray:
    out = np.full(256, outside)
    for lo, hi in pairs:
        out[lo : hi + 1] = not outside
    return out


#: Bytes of words without white space, and of words of letters and digits. Every
#: byte of a character beyond ASCII belongs to a word in both.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)], True)
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], True)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Random 64-bit value of each byte.
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def groups(raws: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of texts whose bytes stay under the limit together."""
    at = size = 0
    for i, raw in enumerate(raws):
        if i > at and size + len(raw) > limit:
            yield at, i
            at, size = i, 0
        size += len(raw)
    if at < len(raws):
        yield at, len(raws)


def encode(texts: list[str | None]) -> list[bytes]:
    return [(x or "").encode() for x in texts]


def pack(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with one newline after each text, and where each text begins.

    The last entry of the second array is the length of the first."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    sizes = np.fromiter((len(x) + 1 for x in raws), np.int64, len(raws))
    return data, np.concatenate(([0], np.cumsum(sizes)))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True; the last element must be False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


_POWERS: dict[str, np.ndarray] = {}
#: Powers up to this many bytes are kept by a worker; more are made for one use.
_KEPT_POWERS = 1 << 21


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _KEPT_POWERS:
        return _make_powers(n)
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = _make_powers(min(_KEPT_POWERS, 1 << n.bit_length()))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hash of any byte range in constant time: polynomial prefix sums mod 2**64."""

    def __init__(self, data: np.ndarray):
        up, down = _powers(len(data) + 1)
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _VALUES[data]
        values *= down[:-1]
        np.cumsum(values, out=self.sums[1:])

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.up[starts] + (stops - starts).astype(np.uint64) * _ODD)

    def windows(self, size: int) -> np.ndarray:
        """Of the ``size`` bytes from each position on, as far as they reach."""
        n = max(0, len(self.sums) - size)
        salt = np.uint64(size * int(_ODD) & (1 << 64) - 1)
        return mix((self.sums[size:] - self.sums[:n]) * self.up[:n] + salt)


def chain(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` hashes in a row, from each position on."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(31) + h[k : k + n] + np.uint64(k + 1))
    return out
