"""The fixed random stream of the resampling analyses."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np

#: s -> s * FACTOR + STEP modulo 2**32, read as s / 2**32: fixed values.
FACTOR, STEP = 1664525, 1013904223
#: States that are held at once: they stay in a core's cache.
PART = 1 << 15


def lcg_state(seed: int, steps: int) -> int:
    """The state after so many steps, by doubling: k steps at once are again a linear step."""
    a, b, s = FACTOR, STEP, seed & 0xFFFFFFFF
    while steps:
        if steps & 1:
            s = (s * a + b) & 0xFFFFFFFF
        a, b = a * a & 0xFFFFFFFF, (a * b + b) & 0xFFFFFFFF
        steps >>= 1
    return s


def lcg_stream(seed: int, n: int, skip: int = 0) -> np.ndarray:
    """n values of the stream after the first `skip`, bit for bit."""
    out = np.empty(n, dtype=np.uint64)
    if not n:
        return out.astype(float)
    mask = np.uint64(0xFFFFFFFF)
    out[0] = (lcg_state(seed, skip) * FACTOR + STEP) & 0xFFFFFFFF
    have, a, b = 1, FACTOR, STEP
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = (out[:more] * np.uint64(a) + np.uint64(b)) & mask
        a, b = a * a & 0xFFFFFFFF, (a * b + b) & 0xFFFFFFFF
        have += more
    return out / 2.0**32


def lcg_jumps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and steps that lead from a state to each of the n states after it."""
    a, b = np.empty(n, np.uint32), np.empty(n, np.uint32)
    a[:1], b[:1] = FACTOR, STEP
    have = 1
    while have < n:
        more = min(have, n - have)
        a[have : have + more], b[have : have + more] = a[:more] * a[have - 1], a[:more] * b[have - 1] + b[:more]
        have += more
    return a, b


@functools.lru_cache(1)
def _part_jumps() -> tuple[np.ndarray, np.ndarray]:
    return lcg_jumps(PART)


def lcg_states(seed: int, n: int, skip: int = 0) -> Iterator[np.ndarray]:
    """The n states after the first `skip`, in parts of at most PART; a part is overwritten by the next one."""
    a, b = _part_jumps()
    held, at = np.empty(PART, np.uint32), np.uint32(lcg_state(seed, skip))
    for first in range(0, n, PART):
        k = min(PART, n - first)
        part = np.multiply(a[:k], at, out=held[:k])
        part += b[:k]
        at = part[-1].copy()
        yield part


def bound(u: float) -> int:
    """A number of the stream is below u if and only if its state is below this."""
    return min(1 << 32, max(0, math.ceil(u * 2.0**32)))


def count_below(part: np.ndarray, limit: int) -> int:
    return len(part) if limit > 0xFFFFFFFF else int(np.count_nonzero(part < np.uint32(limit)))
