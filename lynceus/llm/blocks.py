"""Blocks of rows that are multiplied with themselves in numpy: what the similarity joins have in common."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

#: Pairs that are looked at together.
PAIRS = 1 << 20


def whole_units(batches, names: Sequence[str], keys: Sequence[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns (by name) of Arrow batches sorted by keys, and the bounds of the units: runs of rows with equal keys.

    Each unit comes whole, also where it lies across batches.
    """
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            new = {n: values(batch.column(n)) for n in names}
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in names}
        if held is None:
            continue
        changes = np.flatnonzero(np.logical_or.reduce([np.diff(held[n]) != 0 for n in keys])) + 1
        whole = len(held[keys[0]]) if batch is None else int(changes[-1]) if len(changes) else 0
        if whole:
            yield {n: v[:whole] for n, v in held.items()}, np.r_[0, changes[changes < whole], whole]
            held = {n: v[whole:] for n, v in held.items()}


def values(column) -> np.ndarray:
    """A column of numbers, or one of binary values of one length as rows of bytes."""
    import pyarrow as pa

    if not pa.types.is_binary(column.type):
        return np.asarray(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.uint8)


def pairs_within(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays i, j of all pairs i < j that lie between the same two bounds, about PAIRS at a time."""
    begin, end = bounds[:-1], bounds[1:]
    row = np.arange(bounds[-1])
    after = np.repeat(end, end - begin) - row - 1  # rows of its unit that come after each row
    total = np.cumsum(after)
    start = 0
    while start < len(row):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        n = after[start:stop]
        i = np.repeat(row[start:stop], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges, taken in their order, join parts of n nodes that were not joined before."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            out.append(k)
            if len(out) == n - 1:
                break
    return out
