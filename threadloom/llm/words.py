"""Words and word shingles of whole Arrow batches as arrays: no Python step for a word.

A word is a run of ASCII letters, digits and underscores or of non-ASCII characters, in lower case. Its hash is
a polynomial over its bytes, taken from one running sum over the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffer

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
#: Powers that a worker keeps between batches, 32 MB; those for a longer text go with it.
KEPT = 1 << 22
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept up to KEPT of them, and doubled when more are asked for."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, (n + 1).bit_length())
        have = np.ones(size, np.uint64)
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        if size <= KEPT:
            _powers[base] = have
    return have[: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each flat[start:end]; equal spans have equal hashes wherever they lie."""
    run = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[flat] * powers(BASE, len(flat))[:-1], out=run[1:])
    return mixed((run[ends] - run[starts]) * powers(INVERSE, len(flat))[starts] + (ends - starts).astype(np.uint64))


def spans_of(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true flags; no run crosses an offset."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, flags[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    starts = np.flatnonzero(flags & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, flags[1:]
    after[cuts - 1] = False
    return starts, np.flatnonzero(flags & ~after) + 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of a batch, the first word of each text (one more than texts), and the lower-case bytes."""
    flat, offsets = text_buffer(pc.utf8_lower(column))
    starts, ends = spans_of(IS_WORD[flat], offsets)
    hashes = span_hashes(flat, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, starts, ends, np.searchsorted(starts, offsets), flat


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and where those of each text start; a shorter text is one run of all its words, one without words has none."""
    counts = np.diff(first)
    runs = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(runs)])
    n = int(at[-1])
    place = np.arange(n) - np.repeat(at[:-1], runs) + np.repeat(first[:-1], runs)
    last = np.repeat(first[1:], runs)
    out = np.zeros(n, np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(place + k < last, padded[place + k], np.uint64(0))
    return mixed(out), at
