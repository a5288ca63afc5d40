from collections import Counter

import re

import pytest

from lynceus.llm import rule_ledger as R

TEXTS = [
    None,
    "",
    " \t\n",
    "one two",
    "a b c a b c d",
    "x x x x x",
    "line\nline\n\nother\nline",
    "#* $% a&b |<>| word\x0bword\x0cword\xa0word",
    "é ü " * 40,
    "LOUD WORDS ALL OVER " * 20,
    " ".join(f"w{i}" for i in range(60)),
    "w " * 30_000,
    " ".join(f"w{i % 7919}" for i in range(30_000)),
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measurements_match_brute_force(spark):
    # an extra column and a clashing name must not matter
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, failed string")
    got = {r.doc_id: r for r in R.verdicts(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert tuple(got[i][1:6]) == want, t and t[:40]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i].base_failed == failed
        assert not (got[i].kept and failed)
    assert got[10].kept


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    book = R.ledger(docs)
    rows = {r.rule: r for r in R.ablation(book, "v1").collect()}
    masks = [r.failed for r in book.collect()]
    for rule in R.RULES:
        assert rows[rule.name].n_failed == sum(bool(m & 1 << rule.bit) for m in masks)
        assert rows[rule.name].n_only == sum(m == 1 << rule.bit for m in masks)
        assert rows[rule.name].n_docs == len(masks)
    assert R.mask("base") == 3
    with pytest.raises(KeyError):
        R.mask("none such")


def test_empty_table_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.verdicts(empty).count() == 0
    assert {r.n_failed for r in R.ablation(R.ledger(empty)).collect()} == {0}
    twice = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    assert R.verdicts(twice).count() == 3
