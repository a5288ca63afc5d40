import numpy as np
import pyarrow as pa
import pytest

from lynceus.llm import blocks as B


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_pairs_within(monkeypatch, most):
    monkeypatch.setattr(B, "PAIRS", most)
    bounds = np.array([0, 3, 3, 4, 9])
    got = [(a, b) for i, j in B.pairs_within(bounds) for a, b in zip(i.tolist(), j.tolist())]
    assert sorted(got) == [(i, j) for s, e in zip(bounds, bounds[1:]) for i in range(s, e) for j in range(i + 1, e)]
    assert list(B.pairs_within(np.zeros(1, np.int64))) == []


def test_units_come_whole_across_batches():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 12, 60))
    value = np.arange(60)
    cuts = [0, 1, 5, 5, 17, 40, 60]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(value[a:b])], names=["k", "v"]) for a, b in zip(cuts, cuts[1:])]
    units = [tuple(held["v"][a:b].tolist()) for held, bounds in B.whole_units(batches, ("k", "v"), ("k",)) for a, b in zip(bounds, bounds[1:])]
    assert units == [tuple(value[key == k].tolist()) for k in np.unique(key)]
    assert list(B.whole_units([], ("k",), ("k",))) == []


def test_spanning():
    assert B.spanning(5, np.array([0, 1, 0, 3, 4]), np.array([1, 2, 2, 4, 3])) == [0, 1, 3]
