import numpy as np

from lynceus.llm import pivot_index as P


def brute(rows, cosine=0.9):
    good = [v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    u = np.array([P.unit(np.array([v], float))[0] if g else np.zeros(16) for (_, v), g in zip(rows, good)])
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(hit)):
        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return hit.sum(), sorted(((d, int(h.sum()), d if d is None else least[find(i)]) for i, ((d, _), h) in enumerate(zip(rows, hit))), key=str)


def corpus(rng):
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 60, 300)] + rng.normal(scale=0.12, size=(300, 16))
    hot = base[0] + rng.normal(scale=0.05, size=(150, 16))
    copies = np.repeat(base[5:6] * 3, 40, axis=0)
    vectors = [list(map(float, v)) for v in np.r_[base, near, hot, copies, copies]]
    vectors += [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, [1e300] * 16, [1e-300] * 16]
    return vectors


def test_matches_brute_force(spark):
    rows = list(enumerate(corpus(np.random.default_rng(3)), start=10)) + [(None, [1.0] * 16)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, members int, node string")
    got = P.near_duplicates(frame, block=64).collect()
    links, want = brute(rows)
    assert sum(r.n_links for r in got) >= 0.97 * links
    have = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    by_id = {d: (n, c) for d, n, c in want}
    assert all(r.n_links <= by_id[r.vec_id][0] for r in got)
    assert np.mean([(r.n_links, r.component_id) == by_id[r.vec_id] for r in got]) > 0.95
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    assert have[None].n_links == 0 and have[None].component_id is None
    # with every pivot near, all pairs meet and the result is exact
    exact = P.near_duplicates(frame, pivots=4, nearest=4, block=100).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in exact), key=str) == want


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert P.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in P.near_duplicates(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_near_the_threshold_and_pairs_met(spark):
    """Pairs planted at cosines of 0.9 to 0.95, in floats; with more vectors a smaller share of all pairs meets."""
    rng = np.random.default_rng(8)
    dim, n = 64, 3000
    base = P.unit(rng.normal(size=(n, dim)))
    side = rng.normal(size=(500, dim))
    side = P.unit(side - (side * base[:500]).sum(axis=1, keepdims=True) * base[:500])
    c = rng.uniform(0.9005, 0.95, size=(500, 1))
    v = np.r_[base, c * base[:500] + np.sqrt(1 - c * c) * side].astype(np.float32)
    u = P.unit(v.astype(np.float64))
    want = int((u @ u.T >= 0.9).sum()) - len(v)
    assert want >= 1000
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    for pivots in (P.PIVOTS, 4 * P.PIVOTS):
        got = P.near_duplicates(frame, pivots=pivots).agg({"n_links": "sum"}).first()[0]
        assert 0.95 * want <= got <= want, (pivots, got, want)
    share = []
    for pivots in (P.PIVOTS, 2 * P.PIVOTS):
        near = [set(r) for r in np.argsort(-(u[:1000] @ P.apart(u[1000:], pivots).T), axis=1)[:, : P.nearest_of(pivots)].tolist()]
        share.append(sum(len(a & b) >= 2 for i, a in enumerate(near) for b in near[:i]))
    assert share[1] < 0.75 * share[0], share
    assert P.pivots_for(1000) == P.PIVOTS and P.pivots_for(4 * P.PIVOTS_FROM) == 2 * P.PIVOTS


def test_chains_of_links_make_one_component(spark):
    angle = np.arccos(0.93)
    v = [[float(np.cos(k * angle)), float(np.sin(k * angle)), 0.0] for k in range(5)]
    got = P.near_duplicates(spark.createDataFrame(list(enumerate(v, start=3)), "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 1, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 2, 3, False), (7, 1, 3, False)]
