"""Hashes of word shingles, for many texts at once, on their UTF-8 bytes.

Words are what lies between ASCII white space. A word's hash is a polynomial over a random table
of byte values, mixed; with `fold`, A-Z count as a-z. A shingle's hash is a mixed sum of its
words' hashes with a multiplier for each place. Hashes have 64 bits and depend on nothing but the
words, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
BASE = np.uint64(0x9E3779B97F4A7C13)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
LONG_WORD = 64
#: Bytes of text for which powers are kept between calls.
KEPT = 1 << 19
_kept = [np.zeros(0, dtype=np.uint64)] * 2


def _random(label: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(f"{label} {i}".encode(), digest_size=8).digest() for i in range(n)), dtype=np.uint64)


GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
EXACT = np.where(GAP, 0, _random("byte", 256) | np.uint64(1)).astype(np.uint64)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]
PLACES = _random("place", 64) | np.uint64(1)
SHORT = _random("short", 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; those for slices of usual length are kept."""
    if len(_kept[0]) < n:
        made = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, KEPT) - 1, x)]) for x in (BASE, INVERSE))
        if n > KEPT:
            return made
        _kept[:] = made
    return _kept[0][:n], _kept[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of the text it lies in. offsets: where texts begin, and the end."""
    data = data[: offsets[-1]]
    gap = GAP[data]
    open_ = np.empty(len(data), dtype=bool)
    open_[:1] = True
    open_[1:] = gap[:-1]
    begins = offsets[:-1]
    open_[begins[begins < len(data)]] = True
    starts = np.flatnonzero(open_ & ~gap)
    starts = starts[starts >= offsets[0]]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    size = np.diff(np.r_[starts, len(data)])
    # the polynomial of a stretch is a difference of running totals, moved to power 0: products wrap, so this is exact
    powers, inverses = _powers(len(data) - starts[0])
    total = np.zeros(len(data) - starts[0] + 1, dtype=np.uint64)
    np.cumsum((FOLDED if fold else EXACT)[data[starts[0] :]] * powers, out=total[1:])
    begin = starts - starts[0]
    hashes = (total[begin + np.minimum(size, LONG_WORD)] - total[begin]) * inverses[begin]
    # the rest of a long word, without its trailing gap
    for k in np.flatnonzero(size > LONG_WORD):
        word = data[starts[k] : starts[k] + size[k]]
        stop = np.flatnonzero(GAP[word])
        word = word[: stop[0]] if len(stop) else word
        if len(word) > LONG_WORD:
            raw = word.tobytes()
            hashes[k] ^= np.frombuffer(hashlib.blake2b(raw.lower() if fold else raw, digest_size=8).digest(), dtype=np.uint64)[0]
    return mix(hashes), owner


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in the order of the texts, where each text's begin (and the end), and words of each text.

    A text with fewer words than a shingle has one hash, of all its words; one without words has none.
    """
    n_texts = len(offsets) - 1
    w, owner = word_hashes(data, offsets, fold)
    n_words = np.bincount(owner, minlength=n_texts)
    first = np.r_[0, np.cumsum(n_words)[:-1]]
    n = len(w) - words + 1
    if n > 0:
        total = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            total += w[k : k + n] * PLACES[k]
        whole = owner[:n] == owner[words - 1 :]
        out, at = mix(total[whole]), owner[:n][whole]
    else:
        out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        totals = SHORT[n_words[short]].copy()
        for k in range(words - 1):
            has = n_words[short] > k
            totals[has] += w[first[short[has]] + k] * PLACES[k]
        at = np.r_[at, short]
        out = np.r_[out, mix(totals)]
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, np.r_[0, np.cumsum(np.bincount(at, minlength=n_texts))], n_words


def text_buffers(column, most: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (from row, to row, bytes, offsets) of an Arrow string column, of about `most` bytes; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from .bpe_count import text_slices

    column = pc.fill_null(column, "").cast(pa.large_string())
    for a, b in text_slices(pc.binary_length(column).to_pylist(), most):
        part = column.slice(a, b - a)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], dtype=np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
        yield a, b, data[offsets[0] : offsets[-1]], offsets - offsets[0]
