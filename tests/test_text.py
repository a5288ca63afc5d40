import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lynceus.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\rb", ["a\rb"]), ("a b\n", ["a b"])])
def test_lines(spark, text, want):
    assert one(spark, X.lines, text) == want


@pytest.mark.parametrize("text,want", [("  a ", "a"), ("  a\t", "a"), ("", ""), ("   ", "")])
def test_trim(spark, text, want):
    assert one(spark, X.trim, text) == want


@pytest.mark.parametrize("text", ["x" * 117, "x" * 120, "x" * 121, "é" * 60, "é" * 61, "é" * 118, " " + "x" * 121, "日" * 41])
def test_snippets(spark, text):
    cut = lambda s: s[:117] + "..." if len(s.encode()) > 120 else s
    assert one(spark, X.snippet_cut_first, text) == cut(text).strip()
    assert one(spark, X.snippet_trim_first, text) == cut(text.strip())


def test_patterns_are_unicode_aware(spark):
    assert one(spark, lambda v: X.matches(v, r"\bsudo"), "ésudo") is False
    assert one(spark, lambda v: X.matches(v, r"a.b"), "a b") is True
    assert one(spark, lambda v: X.matches(v, r"a\sb"), "a b") is True


@pytest.mark.parametrize(
    "line,want",
    [("curl https://github.com/x", True), ("curl https://raw.github.com", True), ("curl https://evilgithub.com", False), ("no address", False), ("https://github.com https://evil.com", False),
     ("https://user@github.com:443/x", True), ("https://evil.com#github.com", False), ("https://github.com@evil.com/", False), ("HTTPS://GITHUB.COM", True)],
)
def test_allowed_hosts(spark, line, want):
    assert one(spark, lambda v: X.all_hosts_allowed(v, ("github.com", "")), line) is want


def test_entropy_matches_its_definition(spark):
    rng = random.Random(1)
    texts = ["", "a", "aaaa", "abab", "é", *("".join(rng.choices("abcdefg0123éß日", k=rng.randint(1, 80))) for _ in range(40))]
    got = [r.r for r in spark.createDataFrame([(t,) for t in texts], "v string").select(X.entropy(F.col("v")).alias("r")).collect()]
    for t, g in zip(texts, got):
        raw = t.encode()
        want = -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values()) if raw else 0
        assert abs(g - want) < 1e-9


@pytest.mark.parametrize("text,sep,want", [("Bash(find,ls), Write", ",", ["Bash(find,ls)", "Write"]), ("a,,b,", ",", ["a", "", "b"]), ("f(g(x,y),z),w", ",", ["f(g(x,y),z)", "w"]), ("a(b, c", ",", ["a(b, c"]), ("a) b", " ", ["a)", "b"]), ("", ",", [])])
def test_split_outside_parens(spark, text, sep, want):
    assert one(spark, lambda v: X.split_outside_parens(v, sep), text) == want
