"""Word and shingle hashes for the Python tasks of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash

# --- fixed values: odd multipliers of the mixing steps (our choice) ---------
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 400_000         # per worker; only speed depends on it
# ---------------------------------------------------------------------------


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()


def split_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words of a UTF-8 text: bytes.split() cuts at exactly space, \\t, \\n,
    \\v, \\f and \\r; bytes.lower() changes A-Z alone."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser; every seed gives another order of the same values."""
    x = x + np.uint64((seed * int(STEP)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * STEP + b
    x ^= x >> np.uint64(29)
    return x


def window_hashes(wh: np.ndarray, *ks: int) -> list[np.ndarray]:
    """Hash of every run of ``k`` words (ordered, 64 bits) for each ``k``,
    put together from runs of 1, 2, 4, ... words."""
    runs = {1: wh}
    while max(runs) * 2 <= max(ks):
        k = max(runs)
        r = runs[k]
        runs[2 * k] = _joined(r[:max(0, len(r) - k)], r[k:])
    out = []
    for k in ks:
        n = len(wh) - k + 1
        if n <= 0:
            out.append(np.empty(0, np.uint64))
            continue
        acc, at = None, 0
        for p in sorted(runs, reverse=True):
            if k & p:
                r = runs[p][at:at + n]
                acc = r if acc is None else _joined(acc, r)
                at += p
        out.append(mix(acc, k))
    return out


def shingle_set(text: bytes | None, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; a text with fewer words has its
    whole word sequence as its only shingle, one without words has none."""
    ws = split_words(text, lower)
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=k)], np.uint64)
    return np.unique(window_hashes(word_hashes(ws), k)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def set_digest(u: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(u.tobytes())
    return signed(d >> 64), signed(d & ((1 << 64) - 1))
