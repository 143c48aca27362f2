"""Words and word windows of many texts at once, as 64-bit hashes in flat numpy arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD1342543DE82EF95)
#: Bytes of text that go through numpy at once.
CHUNK_BYTES = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ h >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> _U(27)) * _U(0x94D049BB133111EB)
    return h ^ h >> _U(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_tables: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        _tables[base] = _powers(base, max(n, CHUNK_BYTES + 1))
    return _tables[base]


def chunks(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES each; a longer text is a range of its own."""
    out, start, size = [], 0, 0
    for k, x in enumerate(texts):
        if k > start and size + len(x) > CHUNK_BYTES:
            out.append((start, k))
            start, size = k, 0
        size += len(x)
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def word_hashes(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, text number, first byte and end byte (in the returned bytes) of every word of all texts; the bytes.

    Words are runs of anything but ASCII blanks; lower turns A-Z to a-z. The hash is a polynomial of the bytes
    modulo 2**64, read off running sums, then mixed.
    """
    raw = np.frombuffer(b" ".join([x.encode("utf-8", "surrogatepass") for x in texts]) + b" ", dtype=np.uint8)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.r_[True, blank].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) < len(start):
        end = np.r_[end, len(raw)]
    sums = np.r_[_U(0), np.cumsum((raw.astype(_U) + _U(1)) * _table(_BASE, len(raw) + 1)[: len(raw)], dtype=_U)]
    h = (sums[end] - sums[start]) * _table(_INVERSE, len(raw) + 1)[start]
    h = mix(h + (end - start).astype(_U) * _STEP)
    # Text k ends at the blank that was put behind it.
    sizes = np.array([len(x.encode("utf-8", "surrogatepass")) + 1 for x in texts], dtype=np.int64)
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    return h, text, start, end, raw


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; windows may cross texts, which the caller sorts out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.full(n, k, dtype=_U)
    for j in range(k):
        out = out * _STEP + h[j : n + j]
        out ^= out >> _U(32)
    return mix(out)
