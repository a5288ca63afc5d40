"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

A batch of pre-tokens is one flat array of symbols plus the start of each sequence. In each
round every sequence finds its lowest-ranked adjacent pair and merges all places of that pair at
once; sequences without a mergeable pair leave. What counts is how many symbols survive. Since a
merge only makes pairs of higher rank than its own, merging all equal pairs in one round gives
the same symbols as merging them one at a time from the left.

A worker remembers the counts of at most `CACHE` pre-tokens, so memory does not grow with the
input, and a text is cut into at most `SLICE` pre-tokens at a time.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null ids, repeated rows and
further columns of the input don't matter, one row comes out for each row that goes in.
The added special strings of the vocabulary count as one token each where a text holds them,
which is how the tokenizer library treats them by default.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .worker import tidy

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CACHE = 300_000
SLICE = 300_000
#: Unicode's White_Space, spelled out since regular expression libraries differ on it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """A BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.n = len(vocab)
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # bytes merge most, so the first round's ranks come from a table
        self.first = np.full(256 * 256, NONE, dtype=np.int32)
        place = {int(i): b for b, i in enumerate(self.byte_ids)}
        for rank, (a, b) in enumerate(pairs):
            x, y = place.get(vocab[a]), place.get(vocab[b])
            if x is not None and y is not None:
                self.first[x * 256 + y] = rank
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.cache: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.n + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols are left of each non-empty byte string."""
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = size.copy()
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids = self.byte_ids[raw]
        owner = np.repeat(np.arange(len(pieces)), size)
        ranks = np.full(len(ids), NONE, dtype=np.int32)
        ranks[:-1] = self.first[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        ranks[:-1][owner[:-1] != owner[1:]] = NONE
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks, starts)
            length = np.diff(np.r_[starts, len(ids)])
            out[owner[starts]] = length
            going = best < NONE
            if not going.all():
                stay = np.repeat(going, length)
                ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
                best, length = best[going], length[going]
                if not len(ids):
                    break
            lowest = np.repeat(best, length)
            hit = np.flatnonzero(ranks == lowest)
            # of touching places (a run of one repeated symbol) every second one merges
            new_run = np.r_[True, np.diff(hit) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            ids[hit] = self.made[ranks[hit]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            at = moved[hit]
            ranks[at] = NONE
            both = at[at + 1 < len(ids)]
            both = both[owner[both] == owner[both + 1]]
            ranks[both] = self.rank(ids[both], ids[both + 1])
            before = at[at > 0] - 1
            before = before[owner[before] == owner[before + 1]]
            ranks[before] = self.rank(ids[before], ids[before + 1])
        return out

    def learn(self, unseen: set[str]) -> None:
        if len(self.cache) + len(unseen) > CACHE:
            self.cache.clear()
        pieces = list(unseen)
        found = self.counts([p.encode() for p in pieces]).tolist()
        self.cache.update(zip(pieces, found, strict=True))

    def count_texts(self, texts: Iterable[str]) -> np.ndarray:
        """Tokens of each text."""
        import regex

        split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else None
        find = _finder()
        texts = list(texts)
        totals = np.zeros(len(texts), dtype=np.int64)

        def pieces() -> Iterator[tuple[int, str]]:
            for i, t in enumerate(texts):
                parts = split(t) if split and any(s in t for s in self.specials) else (t,)
                for k, part in enumerate(parts):
                    if k % 2:
                        totals[i] += 1
                    elif part:
                        yield i, part

        tokens: list[str] = []
        ends: list[tuple[int, int]] = []

        def flush() -> None:
            values = [*map(self.cache.get, tokens)]
            if None in values:
                self.learn({t for t, v in zip(tokens, values, strict=True) if v is None} | (set(tokens) if len(self.cache) > CACHE // 2 else set()))
                values = [*map(self.cache.__getitem__, tokens)]
            upto = np.r_[0, np.cumsum(np.fromiter(values, dtype=np.int64, count=len(values)))]
            at = 0
            for i, end in ends:
                totals[i] += upto[end] - upto[at]
                at = end
            tokens.clear()
            ends.clear()

        for i, part in pieces():
            if len(part) <= SLICE:
                tokens += find.findall(part)
                ends.append((i, len(tokens)))
                if len(tokens) >= SLICE:
                    flush()
            else:
                found = (m[0] for m in find.finditer(part))
                while more := list(itertools.islice(found, SLICE)):
                    tokens += more
                    ends.append((i, len(tokens)))
                    flush()
        if tokens:
            flush()
        return totals


@functools.cache
def _finder():
    import regex

    return regex.compile(PATTERN)


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters of text that are held as Python strings at a time.
TEXT_SLICE = 2_000_000


def text_slices(lengths: list[int], most: int = TEXT_SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters together, at least a row each."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        bpe = merges(path or vocabulary_path(vocabulary))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            size = pc.binary_length(texts).cast(pa.int64())
            tokens = np.concatenate([np.zeros(0, np.int64), *(bpe.count_texts(texts.slice(a, b - a).to_pylist()) for a, b in text_slices(size.to_pylist()))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(tidy(count), schema)
