"""Hashed bitmaps of sets, and the bound on overlaps that they give.

A set of n elements has the bit of each element's hash in a bitmap of about ``BITS_EACH`` n bits. Two sets whose bitmaps
differ in h bits differ in at least h elements, so they share at most (a + b - h) / 2: pairs that need more are ruled
out without their elements. The width is a power of two, so a wide bitmap folds to a narrower one.
"""

from __future__ import annotations

import numpy as np

#: Bits for each element, rounded up to a power of two within the bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 4, 256, 16_384
#: Rows compared with the others at once, and 64-bit words of such a comparison, at most.
STRIP, STRIP_WORDS = 32, 2_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (public-domain splitmix constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def width(size: int) -> int:
    """Bits of a bitmap for sets of up to ``size`` elements."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * size - 1).bit_length()))


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set of 64-bit hashes."""
    grid = np.zeros((len(sets), bits), bool)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grid[rows, (mix(np.concatenate(sets)) % _U(bits)).astype(np.int64)] = True
    return np.packbits(grid, axis=1).view(np.uint64)


def signature(own: np.ndarray) -> bytes:
    return bitmaps([own], width(len(own))).tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures at the width of the narrowest, as rows."""
    words = min(map(len, signatures)) // 8
    return np.array([np.bitwise_or.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), axis=0) for s in signatures])


def needed(a: np.ndarray | int, b: np.ndarray | int, gap: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of sizes a and b whose bitmaps differ in ``gap`` bits may reach ``percent`` of their union."""
    return ((a + b - gap) // 2) * (100 + percent) >= percent * (a + b)


def may_link(one: bytes, two: bytes, a: int, b: int, percent: int) -> bool:
    """Whether two sizes and signatures leave room for a link."""
    if 100 * min(a, b) < percent * max(a, b):
        return False
    x, y = folded([one, two])
    return bool(needed(a, b, int(np.bitwise_count(x ^ y).sum()), percent))


def candidates(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that sizes and bitmaps can't rule out; sizes a and b ascend."""
    out = []
    step = max(1, min(STRIP, STRIP_WORDS // max(1, right.size)))
    for start in range(0, len(a), step):
        own = a[start : start + step]
        low = np.searchsorted(b, -(-percent * own[0] // 100), side="left")
        high = np.searchsorted(b, own[-1] * 100 // percent, side="right")
        if low < high:
            gap = np.bitwise_count(left[start : start + step, None, :] ^ right[None, low:high, :]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(needed(own[:, None], b[None, low:high], gap, percent))
            out.append((i + start, j + low))
    return out


def tile_candidates(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Pairs of v, of different labels, among ``rows`` ({v, label, size, bits}) that sizes and bitmaps can't rule out."""
    rows = sorted(rows, key=lambda r: r["size"])
    sizes = np.array([r["size"] for r in rows], np.int64)
    labels, v = (np.array([r[c] for r in rows], np.int64) for c in ("label", "v"))
    maps = folded([r["bits"] for r in rows])
    out = []
    for i, j in candidates(sizes, sizes, maps, maps, percent):
        apart = (i < j) & (labels[i] != labels[j])
        out += zip(np.minimum(v[i], v[j])[apart].tolist(), np.maximum(v[i], v[j])[apart].tolist())
    return out
