"""Shingle sets and fast similarity sketching (numpy core of the near-dedup).

The sketch follows the published scheme of hashed bin placement in rounds: in
round ``i < t`` every element falls into one random bin of ``t`` with a value
in ``[i, i + 1)``; in round ``i >= t`` every element is placed into bin
``i - t``. A coordinate is the least value that its bin ever received. After at
most ``2 t`` rounds every coordinate is filled, and since later rounds only
bring larger values, the rounds stop as soon as no bin is empty: about
``t log t + n`` hash values instead of ``t n``, with the concentration of ``t``
independent MinHash values.
"""

from __future__ import annotations

import numpy as np
import xxhash

from barspark.llm.common import Memo, mix, words

SHINGLE = 5
_LOW = np.uint64(0xFFFFFFFF)
_word_hashes = Memo(120_000)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles.

    A-Z is lower-cased. With fewer words the whole sequence is one shingle;
    without words the set is empty. The length of the text's word sequence is
    part of that short shingle's hash, so it cannot equal a full one.
    """
    found = words(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []
    if not found:
        return np.empty(0, np.uint64)
    memo = _word_hashes
    memo.room(len(found))
    for w in set(found):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    k = min(size, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n], j + 1)
    return np.unique(out)


def forget_words() -> None:
    """Free this worker's hashes of words; a later task computes them again."""
    _word_hashes.clear()


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a non-empty set: round (high half) and value (low)."""
    n = len(elements)
    least = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    first = 0
    while first < 2 * t:
        rounds = min(max(1, 1 + 2 * t // n), 2 * t - first, max(1, 65_536 // n))
        if first < t:
            rounds = min(rounds, t - first)
        for i in range(first, first + rounds) if n > 64 else ():
            h = mix(elements, 0x5851F42D4C957F2D * (i + 1))
            _place(least, h, np.uint64(i), t, i)
        if n <= 64:
            seeds = np.arange(first + 1, first + rounds + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):  # the hash of the loop above: sets of any size must agree
                h = mix(elements[None, :] ^ (seeds * np.uint64(0x5851F42D4C957F2D))[:, None], 0)
            where = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            if first >= t:
                where = np.broadcast_to(np.arange(first - t, first - t + rounds, dtype=np.uint64)[:, None], h.shape)
            value = ((seeds - np.uint64(1))[:, None] << np.uint64(32)) | (h & _LOW)
            np.minimum.at(least, where.ravel().astype(np.int64), value.ravel())
        first += rounds
        if least.max() != np.iinfo(np.uint64).max:
            break
    return least


def _place(least: np.ndarray, h: np.ndarray, i: np.uint64, t: int, number: int) -> None:
    if number >= t:
        where = number - t
        least[where] = min(least[where], (i << np.uint64(32)) | (h & _LOW).min())
        return
    where = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, where, (i << np.uint64(32)) | (h & _LOW))


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of ``rows`` coordinates."""
    c = coordinates[: bands * rows].reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c[:, j], 101 + j)
    return out.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
