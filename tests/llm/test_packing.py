import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lynceus.llm import packing as P

PATH = public_tokenizers.path(P.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
HARD = [
    "", "  ", "Don't STOP, İstanbul ΣΑΣ", "a<|endoftext|>b", "<|startoftext|>", "naïve CAFÉ ½²ª", "x\x1cy z\x85w\xa0v", "日本 語", "é combine", "😀 👍🏽",
    "12 345 6,7.8", "word" * 2000, "a b " * 3000, "Ǆ ǅ ŉ ſ",
]


def same(texts):
    own = P.Tokens(PATH)
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t[:50]


def test_ids_match_the_library():
    same(HARD)
    same(HARD * 2)
    same(["İ", "x İ y"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=50), st.text(st.characters(max_codepoint=0x24F), max_size=50)), max_size=5))
def test_ids_match_on_any_text(texts):
    same(texts)


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 20)
    rng = random.Random(2)
    same([" ".join("".join(rng.choices("abcdef.", k=rng.randint(1, 6))) for _ in range(n)) for n in (5, 9, 30, 100, 7, 8)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 64]))
def test_pack_places_each_id_once_without_padding(sizes, length):
    seen = defaultdict(list)
    for s in P.pack(sizes, length):
        total = sum(p[2] for p in s)
        assert total == length or total & (total - 1) == 0 and total < length
        for d, start, n in s:
            seen[d].append((start, n))
    for d, n in enumerate(sizes):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at and k > 0
            at += k
        assert at == n


def test_first_fit_decreasing_matches_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        tree, bins = P.Tournament(100, len(sizes)), []
        for s in sizes:
            k = next((i for i, b in enumerate(bins) if b + s <= 100), len(bins))
            bins[k:] = [bins[k] + s, *bins[k + 1 :]] if k < len(bins) else [s]
            assert tree.place(s) == k


def test_table(spark):
    rng = random.Random(4)
    texts = [None, "", *(" ".join(rng.choices(["Alpha", "beta,", "gamma", "déjà", "42"], k=rng.choice([3, 50, 700, 6000]))) for _ in range(60)), "dup text", "dup text"]
    rows = [(i if i < 60 else None if i == 60 else 61, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grp string")
    got = P.packed(docs, group_docs=16).collect()
    ids = lambda t: np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, P.END_ID], dtype="<u4")
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append(ids(t))
    assert sum(r.length for r in got) == sum(len(x) for v in want.values() for x in v)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in want[r.doc_id])
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == P.LENGTH or at & (at - 1) == 0 and at < P.LENGTH
    assert P.packed(docs.limit(0)).count() == 0


def test_long_texts_go_through_in_segments(monkeypatch):
    monkeypatch.setattr(P, "SEGMENT", 50)
    rng = random.Random(5)
    words = ["Alpha", "beta,", "naïve", "日本語", "<|endoftext|>", "İ", "don't", "42", "é", "x\x85y", "\n\n", "--", "ΣΑΣ"]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=300)) for _ in range(20)]
    same([*texts, "word" * 200, "日本語" * 200])
    assert len(list(P.segments(texts[0]))) > 3 and "".join(P.segments(texts[0])) == texts[0]


def test_equal_rows_are_spread_and_one_long_text_is_cut(spark):
    rows = spark.range(40_000).select(F.lit(5).alias("doc_id"), F.lit("the same text").alias("text"))
    got = P.packed(rows, group_docs=1024)
    assert got.count() >= 40_000
    groups = got.groupBy(F.floor(F.col("sequence_id") / P.SEQUENCES_A_GROUP).alias("g")).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens")).collect()
    assert len(groups) == 40 and max(g.tokens for g in groups) < 3 * sum(g.tokens for g in groups) / 40
    long_ = spark.createDataFrame([(1, "alpha beta " * 500_000)], "doc_id long, text string")
    got = P.packed(long_).collect()
    assert sum(r.length for r in got) == 1_000_001 and len({r.sequence_id for r in got if r.length == P.LENGTH}) == 1_000_001 // P.LENGTH


def test_ids_of_pieces_make_up_the_documents(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Alpha", "beta,", "gamma", "déjà"], k=n)) for n in (0, 3, 900, 5000, 2047, 12)]
    got = P.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_ids=True).collect()
    for i, t in enumerate(texts):
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == [*LIBRARY.encode(t, add_special_tokens=False).ids, P.END_ID]


def test_frequent_words_are_asked_for_once_however_many_rare_ones_come(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 60)
    own, asked = P.Tokens(PATH), []
    model = own.model
    own.model = type("Model", (), {"tokenize": lambda _, word: asked.append(word) or model.tokenize(word)})()
    frequent = "the sea, and The sky. Of gold"
    for k in range(200):
        text = f"{frequent} {' '.join('rare' + chr(97 + k // 26) + chr(97 + k % 26) + c for c in 'abcdefgh')}"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert all(asked.count(w) == 1 for w in ("the", "sea", "and", "sky", "of", "gold", ",", "."))
    assert len(own.words) <= 60


SHARED = P.Tokens(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("'strevmldLA1²½é×¿ß_.,-\n\t x<|>", max_size=25), max_size=6))
def test_texts_together_are_cut_as_the_library_cuts_each(texts):
    got = P.Tokens.encode_all(SHARED, texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_batches_of_simple_other_and_long_texts(monkeypatch):
    monkeypatch.setattr(P, "SEGMENT", 40)
    monkeypatch.setattr(P, "BATCH", 100)
    rng = random.Random(8)
    words = ["Alpha", "don't", "it's", "we'll've", "naïve", "日本語", "<|endoftext|>", "İ", "Ⱥa", "''s", "42", "x.y", "--", "ΣΑΣ", "'"]
    texts = [rng.choice([" ", "\n", "a b"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 80]))) for _ in range(60)]
    texts += ["1,2;" * 200, "é,'s-a_.b'" * 100, "x'll\n'" * 100, "".join(rng.choices("'strevmld12é.,-_ ", k=2000)), "long" * 300]
    monkeypatch.setattr(P.Tokens, "simple_parts", lambda self, parts, own=P.Tokens.simple_parts: sizes.extend(map(len, parts)) or own(self, parts))
    sizes = []
    got = P.Tokens(PATH).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(sizes)[-1] == len(texts[-1]) and sorted(sizes)[-2] < 120


def test_plain_characters_alone_and_between_others():
    plain = [c for c in map(chr, range(0x250)) if P.PLAIN.fullmatch(c)]
    assert all(len(c.encode()) == len(c.lower().encode()) and len(c.lower()) == 1 for c in plain)
    same([*plain, *(f"a{c}b {c}{c} '{c}s 1{c}.{c}" for c in plain)])
