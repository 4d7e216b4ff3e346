"""Word shingles of whole Arrow text columns, hashed by array operations.

Words are runs of bytes without ``[\\x20\\x09-\\x0D]``, A-Z in lower case. A word's hash
is a polynomial of its bytes, read off one running sum over the column's bytes; words
over LONG bytes are hashed by themselves. A shingle's hash mixes its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text in one round of array operations; a longer text makes a round of its own.
ROUND = 1 << 20
#: Bytes up to which a word's hash is the polynomial: longer ones could be built to collide.
LONG = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8) + np.isin(np.arange(256), np.arange(65, 91)).astype(np.uint8) * np.uint8(32)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix; different seeds give different orders."""
    x = (x ^ np.uint64(seed)) * MIX
    x ^= x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


BYTE = mix(LOWER.astype(np.uint64) + np.uint64(1), 3)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE modulo 2^64, and of its inverse."""
    one = [np.cumprod(np.full(n, b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return tuple(np.r_[np.uint64(1), x[:-1]] for x in one)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end, and the words before each text (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # where a run ends or begins
    edge[1:n] = word[1:] != word[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    start, end = edge.copy(), edge
    start[0] = end[n] = True
    start[inner] = end[inner] = True
    start[:n] &= word
    start[n] = False
    end[1:] &= word
    end[0] = False
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    up, down = powers(max(ROUND, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:n], out=total[1:])
    found = (total[e] - total[s]) * down[s]
    for k in np.flatnonzero(e - s > LONG):
        import xxhash

        found[k] = xxhash.xxh3_64_intdigest(LOWER[data[s[k] : e[k]]].tobytes())
    found = mix(found, 5)
    return found, np.searchsorted(s, bounds)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles (repeats included), text after text, and the shingles before each text.

    A text with fewer words than ``width`` has one shingle of all its words, one
    without words none.
    """
    n_words = np.diff(firsts)
    sizes = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    places = np.r_[0, np.cumsum(sizes)]
    out = np.zeros(places[-1], np.uint64)
    for size in np.unique(np.minimum(n_words[n_words > 0], width)):  # texts shorter than the width have a size of their own
        own = np.minimum(n_words, width) == size
        n = np.where(own, sizes, 0)
        at = np.repeat(firsts[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())  # where each shingle begins
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h += words[at + k]
            h *= MIX
            h ^= h >> np.uint64(29)
        out[np.repeat(places[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] = h
    return out, places


def rounds(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, shingle hashes, places) for runs of rows of about ROUND bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ROUND, "right")) - 1)
        own = offsets[first : last + 1]
        part = data[own[0] : own[-1]] if own[-1] > own[0] else np.zeros(0, np.uint8)
        yield first, last - first, *shingle_hashes(*word_hashes(part, own - own[0]), width)
        first = last


def distinct(keys: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct keys of each text; ``keys`` is sorted in place."""
    for a, b in zip(places[:-1], places[1:]):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[places[:-1][places[:-1] < len(keys)]] = True
    before = np.r_[0, np.cumsum(new)]
    kept, at = keys[new], before[places]
    return [kept[a:b] for a, b in zip(at[:-1], at[1:])]
