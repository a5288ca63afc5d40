import random
import re
from collections import defaultdict

from lynceus.llm import line_spread as L


def brute(rows, sites):
    """What op2 is by its rule: lines on `sites` sites go, but not from texts whose whole sequence of lines is on as many."""
    spread, whole = defaultdict(set), defaultdict(set)
    trim = lambda line: line.strip(L.TRIMMED)
    has = lambda line: bool(re.search(r"[^\x20\x09-\x0D]", line))
    sequence = lambda t: tuple(trim(x) for x in (t or "").split("\n") if has(x))
    for _, t, s in rows:
        whole[sequence(t)].add(s or "")
        for line in (t or "").split("\n"):
            if has(line):
                spread[trim(line)].add(s or "")
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        gone = [x for x in lines if has(x) and len(spread[trim(x)]) >= sites]
        every = [x for x in lines if has(x)]
        if t is None or not gone or len(whole[sequence(t)]) >= sites:
            out.append((d, len(every), 0, 0, t))
        else:
            out.append((d, len(every), len(gone), sum(map(len, gone)), "\n".join(x for x in lines if not (has(x) and len(spread[trim(x)]) >= sites))))
    return out


def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(300):
        own = [f"own line {i} number {k} é" for k in range(rng.randint(0, 6))]
        shared = [f"shared {rng.randint(1, 25)}" for _ in range(rng.randint(0, 3))]
        lines = own + shared + rng.choice([[], ["", "  "], ["Copyright", "\tCopyright "]])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{rng.randint(0, 11) if rng.random() < .6 else 0}"))
    rows += [(None, None, None), (None, "Copyright\nmine own line here", None), (5, "", "s1"), (7, "x\n" * 3000 + "Copyright", "s2")]
    rows += [(1000 + i, "a copied page\nwith two lines", f"s{i}") for i in range(12)]
    return rows


def test_matches_brute_force_near_and_far_from_the_threshold(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, text string, source string, keys string, n_chars int").repartition(3)
    for sites in (3, 6, 10, 12):
        for limit in (0, 1000):
            got = L.removed(docs, sites, broadcast_texts=limit).select("row.doc_id", "n_lines", "n_removed", "n_chars_removed", "clean").collect()
            assert sorted(map(tuple, got), key=str) == sorted(brute(rows, sites), key=str)
    assert sum(r[2] for r in brute(rows, 10)) > 50
    out = L.cleaned(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.report(none).count() == 0


def test_short_pages_of_boilerplate_are_cleaned_and_copies_stay(spark):
    rows = [(i, f"Home About Contact\nAll rights reserved\nown {i}", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, f"a copied page {i // 12}\nwith two lines of its own", f"s{i % 12}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for limit in (0, 1000):
        got = {r.doc_id: r.clean for r in L.removed(docs, broadcast_texts=limit).select("row.doc_id", "clean").collect()}
        assert got == {d: f"own {d}" if d < 100 else t for d, t, _ in rows}


def test_texts_of_boilerplate_alone_are_emptied(spark):
    rows = [(i, f"All rights reserved\nown {i}", f"s{i}") for i in range(12)]
    rows += [(50, "All rights reserved", "s1"), (51, "All rights reserved\n\nAll rights reserved", "s2"), (52, "All rights reserved\n" * 40, "s3")]
    got = {r.doc_id: (r.clean, r.n_removed) for r in L.removed(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("row.doc_id", "clean", "n_removed").collect()}
    assert got[50] == ("", 1) and got[51] == ("", 2) and got[52] == ("", 40) and got[3] == ("own 3", 1)


def test_bytes_bound_what_is_broadcast(spark, monkeypatch):
    hits = spark.createDataFrame([(i, list(range(100))) for i in range(10)], "whole long, keys array<long>")
    assert L.small(hits, 10) and not L.small(hits, 9)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 8000)
    assert not L.small(hits, 10)
