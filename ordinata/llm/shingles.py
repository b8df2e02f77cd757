"""64-bit hashes of words and of word shingles, computed for many texts at once with numpy.

Words are runs of bytes other than white space (0x20, 0x09 to 0x0D) of the UTF-8 text. A word's polynomial hash modulo
2^64 comes from prefix sums over the bytes, so a text costs a few vector operations however many words it has; hashes
pass a finalising mix before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; a longer text is cut between two words.
SEGMENT = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalising mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a byte array that begins and ends between words."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    powers, inverses = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverses[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _cuts(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SEGMENT:
        stop = at + SEGMENT
        while stop < len(text) and not _SPACE[text[stop]]:
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:]


def word_hashes(texts: list[str | None], lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(position in ``texts``, hashes of its words in order), for every text in order; nulls have no words."""
    group: list[bytes] = []
    size = first = 0

    def grouped() -> Iterator[tuple[int, np.ndarray]]:
        joined = b"\n".join(group)
        data = np.frombuffer(joined, np.uint8)
        hashes, starts = _segment_words(_LOWER[data] if lower else data)
        bounds = np.cumsum([0] + [len(t) + 1 for t in group])
        at = np.searchsorted(starts, bounds)
        for k in range(len(group)):
            yield first + k, hashes[at[k] : at[k + 1]]

    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > SEGMENT:
            if group:
                yield from grouped()
            parts = [_segment_words(_LOWER[d] if lower else d)[0] for cut in _cuts(raw) for d in (np.frombuffer(cut, np.uint8),)]
            yield k, np.concatenate(parts)
            group, size, first = [], 0, k + 1
            continue
        group.append(raw)
        size += len(raw) + 1
        if size > SEGMENT:
            yield from grouped()
            group, size, first = [], 0, k + 1
    if group:
        yield from grouped()


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, by position; fewer words give none."""
    size = len(words) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[k : k + size]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of shingles of ``n`` words; a shorter text is one shingle, no words are none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(ngram_hashes(words, min(n, len(words))))
