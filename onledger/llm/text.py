"""Vectorised helpers on byte buffers: word spans, polynomial hashes of any span, covered lengths. Used inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
ODD = U(0x9E3779B97F4A7C15)
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)

SLAB = 1 << 20
PART = 64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x):
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


#: Two independent 64-bit codes for each byte value.
CODES = tuple(mix(np.arange(256, dtype=U) * ODD + U(seed)) for seed in (11, 977))


_POWERS: dict = {}


def powers(which: int, n: int):
    """The first n powers of a base and of its inverse; tables up to a fixed length are made once per worker."""
    if which not in _POWERS or n > len(_POWERS[which][0]):
        made = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            power = np.full(max(n, 4096), U(base))
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            made.append(power)
        if n > 2 * SLAB:
            return made
        _POWERS[which] = made
    return [p[:n] for p in _POWERS[which]]


class Prefix:
    """Hashes of arbitrary spans of a sequence of 64-bit codes: polynomial modulo 2**64 with an odd base, then mixed.

    Such a polynomial is sound for short spans only: sequences of 1 024 and more items exist that collide under every odd base.
    So spans above PART items are digested by BLAKE2 instead. ``windows`` is for widths up to PART, or where a collision does no
    harm; see ``sound_windows`` for others.
    """

    def __init__(self, codes, which: int = 0):
        n = len(codes)
        power, self.inverse = powers(which, n + 1)
        self.codes, self.which = codes, which
        self.total = np.zeros(n + 1, U)
        np.cumsum(codes * power[:n], out=self.total[1:])

    def spans(self, start, end):
        raw = (self.total[end] - self.total[start]) * self.inverse[start]
        out = mix(raw + (end - start).astype(U) * ODD)
        for i in np.flatnonzero(end - start > PART).tolist():
            digest = hashlib.blake2b(self.codes[start[i]:end[i]].tobytes(), digest_size=8, salt=bytes([self.which]))
            out[i] = int.from_bytes(digest.digest(), "little")
        return out

    def windows(self, width: int):
        """Hash of every span of the given width, by start."""
        n = len(self.total) - 1
        if n < width:
            return np.zeros(0, U)
        length = U(width * int(ODD) % (1 << 64))
        return mix((self.total[width:] - self.total[:n - width + 1]) * self.inverse[:n - width + 1] + length)


def sound_windows(codes, width: int, which: int = 0):
    """Hash of every window of the given width, by start, without polynomials of more than PART items.

    A wider window is hashed as the sequence of its parts of PART items and, for what is left, its last part; each level is
    mixed before the next, which no sequence of codes undoes.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    parts = Prefix(codes, which).windows(min(width, PART))
    if width <= PART:
        return parts
    lines = -(-len(parts) // PART)
    grid = np.zeros(lines * PART, U)
    grid[:len(parts)] = parts
    over = sound_windows(np.ascontiguousarray(grid.reshape(lines, PART).T).ravel(), width // PART, which)  # parts that follow each other side by side
    start = np.arange(n)
    return mix(over[start % PART * lines + start // PART] * ODD + mix(parts[width - PART:] ^ U(width)))


def word_spans(buffer, space=SPACE):
    """Starts and ends of the maximal runs of bytes that are no white space."""
    inside = ~space[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_codes(buffer, which: int = 0, spans=None):
    """One 64-bit code for each word of a byte buffer, worked out about a megabyte at a time."""
    start, end = word_spans(buffer) if spans is None else spans
    out, at = np.empty(len(start), U), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLAB, "right")))
        lo, hi = start[at], end[to - 1]
        out[at:to] = Prefix(CODES[which][buffer[lo:hi]], which).spans(start[at:to] - lo, end[at:to] - lo)
        at = to
    return out


def cover(starts, width: int, n: int):
    """Marks over n positions that any [start, start + width) covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(np.asarray(starts) + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def as_bytes(text) -> np.ndarray:
    return np.frombuffer(text or b"", np.uint8)
