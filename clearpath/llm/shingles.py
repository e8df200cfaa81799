"""Shingle sets of whole texts, MinHash bands and odd sketches, in arrays."""

from __future__ import annotations

import numpy as np

HASHES = 192
SKETCH_BITS = 1024
SKETCH_LONGS = SKETCH_BITS // 64

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = _U(0x9E3779B97F4A7C15)
_A, _B, _C = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
#: Chance that a pair at the limit shares no band.
MISSED = 3e-7
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def multipliers(size: int) -> list[np.uint64]:
    """An odd factor for each word of a shingle."""
    return ([_A, _B, _C] + [_U(int(x) | 1) for x in mix(np.arange(3, max(3, size), dtype=np.uint64) * _P)])[:size]


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``size`` words
    (A-Z lower-cased); one hash of the whole sequence if it has fewer words."""
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower changes A-Z only
    b = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    text_starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]  # the last byte is a space
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(texts)
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _P))
    h = mix(np.add.reduceat((b[~space].astype(np.uint64) + _U(1)) * powers[place], offsets) + lengths.astype(np.uint64))
    first = np.searchsorted(starts, text_starts)
    factors = multipliers(size)
    total = lambda x, n, count: sum((x[i : i + count] * factors[i] for i in range(n)), np.zeros(count, np.uint64))
    shingle = mix(total(h, size, len(h) - size + 1)) if len(h) >= size else none
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(shingle[a : z - size + 1]))
        else:
            out.append(mix(total(h[a:z], z - a, 1) + _U(z - a)) if z > a else none)
    return out


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    return int(s.sum(dtype=np.uint64)).to_bytes(8, "little") + int(mix(s * _C + _U(len(s))).sum(dtype=np.uint64)).to_bytes(8, "little")


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set."""
    x = (s >> _U(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024, None] * _MULT + _ADD).min(axis=0), out=out)
    return out


def band_rows(similarity: float) -> int:
    """Minima a band: as many as leave a pair of this similarity without a shared band
    with probability MISSED at most."""
    return max([1, *(r for r in range(1, HASHES + 1) if (1 - similarity**r) ** (HASHES // r) <= MISSED)])


def bands(m: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band of ``rows`` minima; keys of different bands differ."""
    n = len(m) // rows
    x = m[: n * rows].reshape(n, rows).astype(np.uint64)
    key = np.arange(n, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * _P + x[:, i])
    return key.view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples (place, minimum), as longs."""
    at = mix(m.astype(np.uint64) * _P + np.arange(HASHES, dtype=np.uint64)) >> _U(64 - (SKETCH_BITS.bit_length() - 1))
    parity = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def sketch_limit(similarity: float, deviations: float) -> int:
    """Differing bits up to which two sketches may belong to sets of at least
    ``similarity``: the expected number of differing samples, and so many standard
    deviations of the sampling more, folded into SKETCH_BITS parities."""
    differ = HASHES * (1 - similarity) + deviations * (HASHES * similarity * (1 - similarity)) ** 0.5
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-4 * differ / SKETCH_BITS)) + deviations))


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """len(left) x len(right) exact sizes of intersections, by products of 0/1
    matrices over the shingles that both sides have, some columns at a time."""
    l, r = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(l, r)
    l_row, r_row = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out.astype(np.int64)
    l_at, r_at = np.searchsorted(common, l), np.searchsorted(common, r)
    l_in, r_in = common[np.minimum(l_at, len(common) - 1)] == l, common[np.minimum(r_at, len(common) - 1)] == r
    l_row, l_at, r_row, r_at = l_row[l_in], l_at[l_in], r_row[r_in], r_at[r_in]
    total = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(common), columns):
        z = min(a + columns, len(common))
        x, y = np.zeros((len(left), z - a), np.float32), np.zeros((len(right), z - a), np.float32)
        k = (l_at >= a) & (l_at < z)
        x[l_row[k], l_at[k] - a] = 1
        k = (r_at >= a) & (r_at < z)
        y[r_row[k], r_at[k] - a] = 1
        total += (x @ y.T).astype(np.int64)
    return total
