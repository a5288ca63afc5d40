import random
import re

import pytest

from lynceus.llm import ngram_join as N
from lynceus.llm.components import components


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    # equal ids are one node
    return sorted(((d, len(s), d if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeXY", k=rng.randint(1, 3)))
    hot = [word() for _ in range(30)]
    texts = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([4, 7, 25, 80, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 14])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy += hot
            texts.append(rng.choice([" ", "\n", "\t\x0b "]).join(copy))
    texts += [" ".join(hot + [word() for _ in range(5)]) for _ in range(10)]
    texts += [None, "", " \n", "one", "ONE", "two words", "x" * 200 + " y", "X" * 200 + " y", "x" * 199 + "z y"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,hot", [(1, 64), (2, 2)])
def test_matches_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "BLOCK", 64 if hot > 2 else 4)
    rows = list(enumerate(corpus(seed), start=100)) + [(None, "one"), (None, None)]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, node string, n int").repartition(5)
    got = sorted((tuple(r) for r in N.linked(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert N.linked(none).count() == 0
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B c d e f"), (9, "z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in N.linked(docs).collect()) == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 1, 9)]


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(1, None), (None, 2), (7, 7), (300, 299), (299, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_very_long_texts(spark):
    """A text of many words, near copies of it, and one of a single word over and over."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    long_ = [word() for _ in range(40_000)]
    near = long_[:]
    for k in rng.sample(range(len(near)), 300):
        near[k] = word()
    far = long_[:20_000] + [word() for _ in range(20_000)]
    rows = [(1, " ".join(long_)), (2, " ".join(near)), (3, " ".join(far)), (4, "w " * 200_000), (5, "w " * 100_000), (6, "x" * 300_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][1] for i in range(1, 7)] == [1, 1, 3, 4, 4, 6]
    assert got[1][0] == 39_996 and got[4][0] == 1 and got[6][0] == 1


def test_product_accumulates_overlaps_as_brute_force_does(spark):
    rng = random.Random(22)
    rows = [(c, n, 10 + n % 3, n // 2) for c in range(40) for n in rng.sample(range(12), rng.randint(2, 8))]
    got = {(r.a, r.b) for r in N.multiplied(spark.createDataFrame(rows, "shingle long, node long, n long, label long").repartition(3), 80).collect()}
    columns = {}
    for c, n, _, _ in rows:
        columns.setdefault(c, set()).add(n)
    want = set()
    for a in range(12):
        for b in range(a + 1, 12):
            na, nb = 10 + a % 3, 10 + b % 3
            c = sum({a, b} <= s for s in columns.values())
            rest = max(-(-80 * n // 100) - 1 for n in (na, nb))
            if c and a // 2 != b // 2 and 100 * min(na, nb) >= 80 * max(na, nb) and 180 * (c + rest) >= 80 * (na + nb):
                want.add((a, b))
    assert got == want and want
