"""Word and window hashes of whole batches of texts, computed from their bytes at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of the two window polynomials and of the polynomial over a word's bytes (fixed by the first).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTE_BASE = 0xD6E8FEB86659FD93
SPACES = b"\t\n\x0b\x0c\r "


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A mixed number for each byte value, and which bytes are white space.
BYTES = mixed(np.arange(1, 257, dtype=U) * U(BASES[0]))
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
#: Bytes that one running sum covers; a longer word has one of its own.
BLOCK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of BYTE_BASE and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BYTE_BASE, pow(BYTE_BASE, -1, 1 << 64))):
            row = np.full(size, base, U)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return [p[:n] for p in _powers]


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row, where their words start and end in it, and the number of words before each text and after the last."""
    joined = b"\n".join([b"", *texts, b""])
    edge = np.diff(IS_SPACE[np.frombuffer(joined, np.uint8)].view(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    return joined, start, end, np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts)]))


def span_hashes(joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word's hash is a polynomial of its bytes: the difference of two running sums, moved back to power 0."""
    raw = np.frombuffer(joined, np.uint8)
    out, i = [np.empty(0, U)], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        at, stop = start[i:j] - start[i], end[i:j] - start[i]
        own = raw[start[i] : end[j - 1]]
        up, down = powers(len(own))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[own] * up, dtype=U)])
        out.append(mixed((sums[stop] - sums[at]) * down[at] + (stop - at).astype(U)))
        i = j
    return np.concatenate(out)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' words in a row, and the number of words before each text and after the last."""
    joined, start, end, first = word_spans(texts)
    return span_hashes(joined, start, end), first


def window_hashes(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of `width` word hashes: the polynomial in BASES[which], by doubling, then mixed."""
    if len(h) < width:
        return np.empty(0, U)
    if which:
        h = mixed(h + U(which))
    base, out, done, power, have = BASES[which], None, 0, h, 1
    # power: hashes of runs of `have` words; out: of the first `done` words of the window
    with np.errstate(over="ignore"):
        while True:
            if width & have:
                out = power if out is None else out[: len(power) - done] * U(pow(base, have, 1 << 64)) + power[done : done + len(out)][: len(power) - done]
                done += have
            if done == width:
                return mixed(out[: len(h) - width + 1] + U(width))
            power = power[:-have] * U(pow(base, have, 1 << 64)) + power[have:]
            have *= 2


def distinct(v: np.ndarray) -> np.ndarray:
    v = np.sort(v)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; fewer words than `width` make one shingle, none make none."""
    h, first = hashed(texts)
    v = window_hashes(h, width)
    return [distinct(v[a : b - width + 1] if b - a >= width else window_hashes(h[a:b], b - a) if b > a else v[:0]) for a, b in zip(first.tolist(), first[1:].tolist())]
