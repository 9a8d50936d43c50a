"""Word shingles of whole texts as sorted arrays of 64-bit hashes, and their minhashes, a batch of texts at a time.

A word is a run of bytes other than ASCII white space after lowering A-Z. Bytes have fixed random 64-bit values, a word's
hash is a polynomial in them modulo 2**64, a shingle's a multilinear form of its words' mixed hashes.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
GROUP = 1 << 20  # bytes of text hashed together
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, GROUP + 4096)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and per text the position of its first word (one more at the end)."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.lower(), np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    fwd, back = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * fwd[: len(raw)], dtype=np.uint64)])
    words = mix((total[ends] - total[starts]) * back[starts])
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, at)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all texts, repeated ones too, and per text the position of its first (one more at the end)."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    n_out = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    offs = np.concatenate([[0], np.cumsum(n_out)])
    full = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        full += words[k : k + len(full)] * _COEF[k]
    which = np.repeat(np.arange(len(texts)), n_out)
    src = np.arange(offs[-1]) - offs[which] + at[:-1][which]
    out = np.zeros(offs[-1], np.uint64)
    long = (counts >= WIDTH)[which]
    out[long] = full[src[long]]
    for t in np.nonzero((counts > 0) & (counts < WIDTH))[0]:
        w = words[at[t] : at[t + 1]]
        out[offs[t]] = np.append(w * _COEF[: len(w)], _SHORT[len(w)]).sum(dtype=np.uint64)
    return mix(out), offs


def grouped(texts):
    """Texts (None: empty) as bytes, in runs of about ``GROUP`` bytes."""
    run, size = [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and size + len(b) > GROUP:
            yield run
            run, size = [], 0
        run.append(b)
        size += len(b)
    if run:
        yield run


def sets(texts):
    """Per text the sorted array of its distinct shingle hashes."""
    for run in grouped(texts):
        sh, offs = shingles(run)
        for i in range(len(run)):
            yield np.unique(sh[offs[i] : offs[i + 1]])


def minhashes(sh: np.ndarray, offs: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """(texts, functions) minima; texts without shingles get the largest value."""
    n = len(offs) - 1
    out = np.full((n, len(mult)), np.iinfo(np.uint64).max, np.uint64)
    some = np.nonzero(np.diff(offs) > 0)[0]
    if len(some):
        for k in range(len(mult)):
            out[some, k] = np.minimum.reduceat(sh * mult[k] + add[k], offs[:-1][some])
    return out
