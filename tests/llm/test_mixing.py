import math
import random
from collections import Counter, defaultdict

import pytest

from lynceus.llm import mixing as M


def brute_exponent(tokens, entropy, repeats):
    total = sum(tokens)

    def fine(t):
        w = [(x / total) ** t for x in tokens]
        s = sum(w)
        h = -sum(x / s * math.log(x / s) for x in w)
        return h <= entropy * math.log(len(tokens)) + 1e-12 and (max(tokens) / min(tokens)) ** (1 - t) <= repeats + 1e-12

    if fine(0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fine(mid) else (mid, high)
    return high


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40])) if i % 50 else None, source, i, "x"))
    rows += [(None, "a b", "s1", 0, "x"), (4, "dup", "s2", 0, "x"), (4, "dup", "s2", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens long, row string").repartition(4)


@pytest.mark.parametrize("entropy,repeats", [(0.95, 2.0), (0.8, 100.0), (1.0, 1e9), (0.1, 3.0), (0.99, 1.5)])
def test_exponent(docs, entropy, repeats):
    by_source = docs.selectExpr("coalesce(source, '') AS src", "cast(size(array_remove(split(coalesce(text, ''), ' '), '')) + 1 AS long) AS tokens").groupBy("src").agg({"tokens": "sum", "*": "count"}).toDF("src", "tokens", "docs")
    tokens = [r.tokens for r in by_source.collect()]
    assert abs(M.exponent(by_source, entropy, repeats) - brute_exponent(tokens, entropy, repeats)) < 1e-6


@pytest.mark.parametrize("budget,block", [(None, 16), (None, 2048), (3000, 16), (200, 8), (40_000, 50)])
def test_passes_and_quotas(docs, budget, block):
    got = M.drawn(docs, budget=budget, block_docs=block).collect()
    sizes, n = defaultdict(int), Counter()
    longest = 0
    for r in docs.collect():
        k = len((r.text or "").split()) + 1
        sizes[r.source] += k
        n[r.source] += 1
        longest = max(longest, k)
    t = brute_exponent(list(sizes.values()), M.ENTROPY, M.REPEATS)
    raised = {s: x**t for s, x in sizes.items()}
    if budget is None:
        quota = {s: raised[s] * max(x ** (1 - t) for x in sizes.values()) for s in sizes}
    else:
        quota = {s: budget * raised[s] / sum(raised.values()) for s in sizes}
    took, rows = defaultdict(int), defaultdict(lambda: defaultdict(list))
    for r in got:
        took[r.source] += r.n_tokens
        rows[r.source][r["pass"]].append(r)
    for s in sizes:
        assert quota[s] - longest - 2 <= took[s] <= quota[s] + 1
        full = int((quota[s] + 0.5) // sizes[s])
        for p in range(full):
            assert len(rows[s][p]) == n[s]
        for p in rows[s].values():
            assert len({(r.block_rank, r.place) for r in p}) == len(p)
    if budget is None:
        assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
        again = M.remixed(docs, block_docs=block)
        assert again.columns == docs.columns
        assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in got)


def test_passes_differ_in_order(docs):
    got = M.drawn(docs, budget=60_000, block_docs=16).where("source = 'hot'").collect()
    order = lambda p: [r.doc_id for r in sorted((r for r in got if r["pass"] == p), key=lambda r: (r.block_rank, r.place))]
    assert order(0) != order(1) and sorted(order(0)) == sorted(order(1))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.drawn(none).count() == 0 and M.remixed(none).count() == 0


def test_equal_rows_fill_many_blocks(spark):
    rows = spark.range(5000).selectExpr("5L AS doc_id", "'same text' AS text", "'s' AS source").repartition(3)
    sizes = [r["count"] for r in M.drawn(rows, block_docs=64).groupBy("block_rank").count().collect()]
    assert sum(sizes) == 5000 and len(sizes) > 60 and max(sizes) < 200
    assert M.remixed(rows, block_docs=64).count() == 5000


def test_stretches_leave_the_order_as_it_is(docs, monkeypatch):
    want = sorted(map(tuple, M.drawn(docs, budget=3000, block_docs=4).collect()), key=str)
    monkeypatch.setattr(M, "STRETCH", 3)
    assert sorted(map(tuple, M.drawn(docs, budget=3000, block_docs=4).collect()), key=str) == want


def test_a_very_long_text_is_one_document(spark):
    rows = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "w " * 300_000, "b"), (3, "w", "b")], "doc_id long, text string, source string")
    got = M.drawn(rows).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 400_001, 2: 300_001, 3: 2}
