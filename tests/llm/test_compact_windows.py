import random

import numpy as np

from lynceus.llm import compact_windows as C


def test_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 40, 60).astype(np.uint64)
    begins, ends, least = np.array([0, 25]), np.array([25, 60]), 5
    low, at, high = C.compact_windows(values, begins, ends, least)
    for b, e in zip(begins, ends):
        for i in range(b, e):
            for j in range(i + least, e + 1):
                cover = [(x, y, z) for x, y, z in zip(low, at, high) if x <= i <= y < j <= z]
                assert len(cover) == 1 and values[cover[0][1]] == values[i:j].min()


def test_longest_stretches_match_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 7)
        scores = np.array([rng.choice([1, 2, 4]) if k % 2 == 0 else -rng.choice([1, 3, 5]) for k in range(2 * n - 1)])
        fine = [(a, b) for a in range(0, 2 * n - 1, 2) for b in range(a, 2 * n - 1, 2) if scores[a : b + 1].sum() >= 0]
        want = [s for s in fine if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in fine)]
        assert C.longest_stretches(scores) == want


def test_finds_every_exact_repeat_within_edited_copies(spark):
    """Texts edited all over are unlike as a whole, but share passages word for word."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    rows, texts = [], []
    for g in range(12):
        base = [word() for _ in range(500)]
        for _ in range(4):
            copy = []
            for k, w in enumerate(base):
                copy.append(word() if k % rng.choice([9, 30, 130]) == 7 else w)
                if rng.random() < 0.01:
                    copy.append(word())
            texts.append(copy)
            rows.append((len(rows), " ".join(copy)))
    seen, repeats = {}, set()
    for d, w in enumerate(texts):
        for i in range(len(w) - 49):
            o = seen.setdefault(tuple(w[i : i + 50]), d)
            if o != d:
                repeats |= {o, d}
    assert len(repeats) >= 10
    got = {r.doc_id for r in C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert repeats <= got


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    planted, docs = {}, {}
    hot = text(70)
    for i in range(40):
        before = text(rng.randint(0, 120))
        docs[i] = before + hot + text(rng.randint(0, 80))
        planted[i] = [(len(before), len(before) + 70)]
    for i in range(40, 60):
        docs[i] = text(rng.randint(1, 400))
    for i in range(60, 80, 2):
        p = text(80)
        q = p[:]
        q[rng.randint(30, 50)] = "changed"
        a, b = text(rng.randint(0, 50)), text(rng.randint(0, 50))
        docs[i], docs[i + 1] = a + p + text(30), b + q + text(10)
        planted[i], planted[i + 1] = [(len(a), len(a) + 80)], [(len(b), len(b) + 80)]
    short = text(40)
    for i in range(80, 84):
        docs[i] = text(60) + short + text(60)  # too short to be a passage
    copy = text(90)
    for i in range(84, 88):
        docs[i], planted[i] = copy, [(0, 90)]
    return {i: " ".join(w) for i, w in docs.items()}, planted


def test_finds_planted_passages_and_nothing_else(spark):
    docs, planted = corpus(4)
    rows = [(i, t, 1, "x") for i, t in docs.items()] + [(None, docs[0], 1, "x"), (200, None, 1, "x"), (201, "", 1, "x"), (3, docs[3], 1, "x")]
    got = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, node int, key string").repartition(3)).collect()
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.start, r.end, r.component_id))
    assert set(have) == set(planted)
    for i, spans in planted.items():
        for a, b in spans:
            x, y, _ = max(have[i], key=lambda s: min(s[1], b) - max(s[0], a))
            assert min(y, b) - max(x, a) >= 0.85 * (b - a) and y - x <= (b - a) + 12, (i, have[i], spans)
    assert {c for i in range(40) for _, _, c in have[i]} == {0}
    assert all(have[i][0][2] == have[i + 1][0][2] == i for i in range(60, 80, 2))
    assert {have[i][0] for i in range(84, 88)} == {(0, 90, 84)}


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert C.repeated_passages(none).count() == 0
    same = spark.createDataFrame([(1, "w " * 30_000), (2, "w " * 20_000), (3, "v " * 10)], "doc_id long, text string")
    assert {r.doc_id for r in C.repeated_passages(same).collect()} <= {1, 2}


def test_links_near_copies_in_large_groups(spark):
    """Variants of one passage that are unlike each other, each with one near copy."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(0, 200, 2):
        one = base[:]
        for k in rng.sample(range(60), 4):
            one[k] = word()
        two = one[:]
        two[rng.choice([0, 1, 58, 59])] = word()
        rows += [(i, " ".join(one)), (i + 1, " ".join(two))]
    got = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    component = {r.doc_id: r.component_id for r in got}
    fine = [i for i in range(0, 200, 2) if i in component and component[i] == component.get(i + 1)]
    assert len(fine) >= 95, len(fine)


def phrased(rng, phrase, n=100, passage=54):
    """n pairs of documents; each pair shares a passage word for word, and all passages hold one phrase of so many words."""
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    stock, rows = [word() for _ in range(phrase)], []
    for i in range(0, 2 * n, 2):
        before = rng.randint(0, passage - phrase)
        shared = [word() for _ in range(before)] + stock + [word() for _ in range(passage - phrase - before)]
        rows += [(i + k, " ".join([word() for _ in range(rng.randint(5, 60))] + shared + [word() for _ in range(rng.randint(5, 60))])) for k in (0, 1)]
    return rows


def test_a_common_phrase_hides_no_copied_passage(spark):
    rng = random.Random(11)
    for phrase in (0, 24, 34):
        got = {r.doc_id: r.component_id for r in C.repeated_passages(spark.createDataFrame(phrased(rng, phrase), "doc_id long, text string").repartition(3)).collect()}
        fine = [i for i in range(0, 200, 2) if i in got and got[i] == got.get(i + 1)]
        assert len(fine) >= 95, (phrase, len(fine))


def test_recall_of_near_copies_against_brute_force(spark):
    """Passages of 50 to 70 words with one changed word, some with a common phrase: what a comparison of all pairs links is linked."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    stock, texts = [word() for _ in range(20)], []
    for _ in range(60):
        p = [word() for _ in range(rng.randint(50, 70))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(p) - 20)
            p[at : at + 20] = stock
        q = p[:]
        q[rng.randrange(len(q))] = word()
        texts += [[word() for _ in range(rng.randint(0, 30))] + x + [word() for _ in range(rng.randint(0, 30))] for x in (p, q)]

    def linked(x, y):
        grams = [[tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in (x, y)]
        for n in range(46, 70):
            for a in range(len(grams[0]) - n + 1):
                p = set(grams[0][a : a + n])
                for b in range(len(grams[1]) - n + 1):
                    if grams[0][a] == grams[1][b] or grams[0][a + n - 1] == grams[1][b + n - 1]:
                        q = set(grams[1][b : b + n])
                        if 5 * len(p & q) >= 4 * len(p | q):
                            return True
        return False

    want = [i for i in range(0, 120, 2) if linked(texts[i], texts[i + 1])]
    assert len(want) >= 50
    got = {r.doc_id: r.component_id for r in C.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    fine = [i for i in want if i in got and got[i] == got.get(i + 1)]
    assert len(fine) >= 0.95 * len(want), (len(fine), len(want))
    assert all(got[i] >= 2 * (i // 2) for i in got)  # no strangers in one component


def test_contexts_and_runs_match_brute_force():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**62, 300).astype(np.uint64)
    y = x.copy()
    y[[40, 100, 180]] = rng.integers(0, 2**62, 3)
    at = np.arange(300)
    zero, end = np.zeros(300, np.int64), np.full(300, 300)
    got = C.runs(C.contexts(x, at, zero, end, zero + 1), C.contexts(y, at, zero, end, zero + 2))

    def level(equal):
        n = 0
        for step in C.LEVELS:
            if not equal(step):
                break
            n = step
        return n

    want = [level(lambda n: k + n <= 300 and (x[k : k + n] == y[k : k + n]).all()) + level(lambda n: k >= n and (x[k - n : k] == y[k - n : k]).all()) for k in at]
    assert (got >= want).all() and (got == want).mean() > 0.85  # four bits may agree by chance, and then more is compared


def test_minima_of_many_texts_need_no_window(spark, monkeypatch):
    docs, planted = corpus(6)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    found = lambda: {(r.doc_id, r.component_id) for r in C.repeated_passages(frame).collect()}
    want = found()
    monkeypatch.setattr(C, "HOT", 3)
    monkeypatch.setattr(C, "BLOCK", 4)
    monkeypatch.setattr(C, "LARGE", 2)
    assert found() == want and {d for d, _ in want} == set(planted)


def test_equal_minima_in_one_text(spark):
    """A text of one word has one token over and over; its spans are those of the shorter of two such texts."""
    got = C.repeated_passages(spark.createDataFrame([(1, "w " * 3000), (2, "w " * 2000), (3, "v " * 2000)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.component_id for r in got} == {1}
    assert all(r.end - r.start >= 50 for r in got)


def test_matches_are_the_same_by_look_up_and_by_shifts(monkeypatch):
    rng = np.random.default_rng(7)
    y = rng.permutation(400).astype(np.uint32)
    x = np.r_[1000 + np.arange(30), y[20:200], 2000 + np.arange(3), y[203:350]].astype(np.uint32)
    found = C.Matches(x, y)
    assert found.known and found.sets
    for a, b, c, d in ((0, 100, 0, 100), (30, 210, 20, 200), (30, 357, 20, 350), (0, 357, 0, 400), (200, 300, 190, 280)):
        assert found.alike(a, b, c, d, 80) == C.alike(x[a:b], y[c:d], 80)
    again = np.r_[y[:50], y, y[30:60]]
    for other in (y, again, np.zeros(300, np.uint32)):
        held = C.Matches(x, other)
        monkeypatch.setattr(C, "MATCHES", 0)
        looked = C.Matches(x, other)
        monkeypatch.undo()
        assert held.known and not looked.known or not len(held.i)
        for shift in (-10, 0, 40):
            i, j = held.around(shift)
            p, q = looked.around(shift)
            assert (i == p).all() and (np.abs(j - i - shift) == np.abs(q - p - shift)).all()
    alike = np.zeros(4000, np.uint32)
    assert not C.Matches(alike, alike).known and C.passages(alike, alike, np.array([[5, 5]]), 46, 80)


def test_windows_are_split_at_the_smallest_of_a_passage_alone():
    rng = np.random.default_rng(13)
    for least in (1, 2, 5, 8, 46):
        for most in (3, 1000):
            values = rng.integers(0, most, 200).astype(np.uint64)
            want = {p for s in range(200 - least + 1) for p in range(s, s + least) if values[p] == values[s : s + least].min()}
            got = C.smallest_within(values, least).tolist()
            assert got == sorted(got) and want <= set(got) and all(p in want or values[p] == 0 for p in got)
    values = rng.integers(0, 2**62, 20_000).astype(np.uint64)
    assert len(C.smallest_within(values, 46)) < 20_000 / 15 and not len(C.smallest_within(values[:20], 46))


def test_a_text_is_ordered_once_for_all_its_pairs(monkeypatch):
    import pyarrow as pa

    rng, made, real = np.random.default_rng(14), [], C.Ordered
    monkeypatch.setattr(C, "Ordered", lambda y: made.append(1) or real(y))
    y = [rng.integers(0, 2**32, 300).astype(np.uint32) for _ in range(2)]
    y[1][200:] = y[1][:100]  # repeats itself
    x = [np.r_[rng.integers(0, 2**32, k).astype(np.uint32), y[b][50:150]] for b in (0, 1) for k in range(6)]
    columns = {"a": range(10, 22), "b": [0] * 6 + [1] * 6, "starts": [[(k + 20 << 32) + 70] for _ in (0, 1) for k in range(6)], "x": [v.tobytes() for v in x], "y": [y[b].tobytes() for b in (0, 1) for _ in range(6)]}
    batches = pa.table({n: list(v) for n, v in columns.items()}).to_batches(max_chunksize=4)
    got = [r for batch in C.compared(batches, 46, 80) for r in batch.to_pylist()]
    assert len(made) == 2
    assert [(r["a"], r["begin"], r["end"], r["b"], r["begin_b"], r["end_b"]) for r in got] == [(10 + k, k % 6, k % 6 + 100, k // 6, 50, 150) for k in range(12)]


def test_word_hashes_are_the_polynomial_of_the_words_bytes():
    from lynceus.llm import shingles as S

    words = ["a", "Abc", "語", "x" * 63, "x" * 64, "e"]
    raw = " \t" + "  ".join(words) + "\n"
    parts = [raw.encode(), b"", ("tail " * 9).encode()]
    got, owner = S.word_hashes(np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])])
    want = [sum(int(S.FOLDED[c]) * int(S.BASE) ** k for k, c in enumerate(w.encode())) % 2**64 for w in words + ["tail"] * 9]
    assert (got == S.mix(np.array(want, dtype=np.uint64))).all() and owner.tolist() == [0] * 6 + [2] * 9


def test_near_counts_as_a_loop_over_the_stretches_does():
    rng = np.random.default_rng(15)
    for least in (5, 46, 300):
        reach = least + C.DRIFT
        x = rng.integers(0, 60_000, (40, 2 * reach)).astype(np.uint16)
        y = np.roll(x, 1, axis=1)
        for r in range(40):
            y[r, rng.integers(0, 2 * reach, r * reach // 80)] = 1
        x[::5, : reach - 2] = y[::5, : reach - 2] = 0  # a text's begin
        x[::7, reach:] = y[::7, reach:] = 9  # a word over and over

        def slow(p, q):
            met = [p[k] != 0 and any(p[k] == q[k + d] for d in range(-C.SHIFTS, C.SHIFTS + 1) if 0 <= k + d < len(q)) for k in range(len(p))]
            fresh = [k == 0 or p[k] != p[k - 1] for k in range(len(p))]
            for a in range(reach - least + 1, reach + 1):
                m, f = met[a : a + least], fresh[a : a + least]
                if 180 * sum(m) >= 160 * least and 180 * sum(u and v for u, v in zip(m, f)) >= 160 * sum(f):
                    return True
            return False

        want = [slow(p, q) for p, q in zip(x.tolist(), y.tolist())]
        assert C.near(x, y, least, 80).tolist() == want and 0 < sum(want) < 40
    assert not len(C.near(x[:0], y[:0], 46, 80))


def test_components_grow_by_new_links(spark):
    old = spark.createDataFrame([(5, 3), (9, 5), (8, 7)], "a long, b long")
    new = spark.createDataFrame([(9, 8), (12, 11)], "a long, b long")
    got = {(r.node, r.component) for r in C.grown(C.components(old), new).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (8, 3), (7, 3), (11, 11), (12, 11)}
    assert got == {(r.node, r.component) for r in C.components(old.union(new)).collect()}
