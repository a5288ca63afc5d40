import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lynceus.llm import bpe_count as B

PATH = public_tokenizers.path(B.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
HARD = [
    "", " ", "  \n\t x", "aaaaaaaaaaaaaaaa", "don't they'll  I'M", "naïve café 12345 ½ ²", "<|endoftext|>a<|endoftext|> <|endoftext|>",
    "日本語のテキスト", "a\x1cb\x1d \x85\xa0 z", "😀😀👍🏽", "word" * 3000, "x " * 5000, "ا لعربية", "́combining", " trailing  ", "\x00\x01",
]


def test_counts_match_the_library():
    want = [len(e.ids) for e in LIBRARY.encode_batch(HARD, add_special_tokens=False)]
    assert B.merges(PATH).count_texts(HARD).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_counts_match_on_any_text(texts):
    want = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert B.merges(PATH).count_texts(texts).tolist() == want


def test_small_slices_and_cache_give_the_same(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdeth ing", k=rng.randint(1, 9))) for _ in range(300)) for _ in range(30)]
    want = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(B, "SLICE", 100)
    monkeypatch.setattr(B, "CACHE", 150)
    assert B.Merges(PATH).count_texts(texts).tolist() == want


def test_table(spark):
    rows = [(1, "hello world", "x"), (None, None, "y"), (1, "hello world", None), (2, "", "z"), (3, "é" * 5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in B.token_counts(docs).collect()), key=str)
    n = len(LIBRARY.encode("é" * 5000).ids)
    assert got == sorted([(1, 11, 2, False)] * 2 + [(None, 0, 0, False), (2, 0, 0, False), (3, 10000, n, n > 1024)], key=str)
    assert B.token_counts(docs.limit(0)).count() == 0
    assert np.asarray(got, dtype=object).shape == (5, 4)
