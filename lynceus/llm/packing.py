"""Packing documents into sequences of fixed length.

A document gives its full sequences first, so that of no document more than one rest, shorter than a
sequence, is left to be packed. Rests are dealt into randomised groups of bounded size; each group is
packed on its own by first-fit decreasing, which finds the leftmost bin with room by walking down a tournament tree of bin
capacities. The emptiest bins are then cut to fill what the others have left, so all sequences
of a group but the last are full; the last is cut at powers of two, which need no padding.

Token ids come from the tokenizer library, word by word. Many texts at a time are cut into words by comparing kinds of
neighbouring bytes; each different word is looked up once, and the texts' ids are gathered from those of the words.
A worker remembers the ids of at most `CACHE` words, and when these are too many keeps those of the texts at hand. A text
with characters for which words might not be independent of what stands beside them goes to the library. Long texts go
through in segments, cut between two ASCII letters or digits with a white space between them, across which the tokenizer
never looks.

Pieces with the ids of the rests are written to the shared folder first, so a lost executor costs no text's
tokens again, and the groups can be dealt by place in that table: equal rows are spread like any others.

Defined results: a null or empty text is the end id alone, so one piece of length 1; repeated rows
are packed as often as they come; null doc_ids are packed too; an empty table gives no piece.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_count import byte_symbols, text_slices, vocabulary_path
from .columns import cut
from .worker import tidy

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 1
GROUP_DOCS = 1024
CACHE = 200_000
#: Longer words, in characters, are not remembered.
LONG = 64
#: Full sequences, which need only a number, that a group has besides its rests.
GROUP_FULL = 16_384
SEQUENCES_A_GROUP = 1 << 32
#: Documents that a worker holds at a time while it looks up ids.
ROWS = 1000
#: Characters of a text that are looked up at a time, up to the next place where it can be cut.
SEGMENT = 1 << 16
#: Characters that are cut into words at a time, up to the next place where a text can be cut.
BATCH = 1 << 20
SEAM = re.compile(r"[0-9A-Za-z][ \t\n]+[0-9A-Za-z]")
#: Only these characters: lower-casing, composing and splitting then never look past white space, and lower-casing
#: leaves each as many bytes as it had, two at most. Of the letters between, U+0130 alone becomes two characters in
#: lower case, of which one is no letter, and U+023A and U+023E become three bytes.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]*")
#: Where else a text of only these characters can be cut: after a space, a digit or a sign that a letter or digit follows.
PLAIN_SEAM = re.compile(r"[\s0-9]|[^\w\s'](?=[^\W_])")
GAP, LETTER, DIGIT, SIGN = range(4)
#: The kind of each character of one or two bytes in UTF-8.
KINDS = np.array([GAP if chr(c).isspace() else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], SIGN) for c in range(1 << 11)], np.uint8)


class Tokens:
    """Token ids of texts, by chunk and by the words and signs in it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bytes_as_signs = dict(enumerate(byte_symbols()))
        self.kind, self.code = ("<u2", "H") if self.library.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.forget()

    def narrow(self, ids: bytes) -> bytes:
        """Ids in as few bytes as the vocabulary needs; `wide` undoes it."""
        return np.frombuffer(ids, "<u4").astype(self.kind).tobytes()

    def wide(self, ids) -> bytes:
        return np.frombuffer(ids, self.kind).astype("<u4").tobytes()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}

    def simple(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def word(self, word: str) -> bytes:
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes_as_signs)
        return array(self.code, [t.id for t in self.model.tokenize(signs)]).tobytes()

    def look_up(self, words: list[str]) -> list[bytes]:
        """The narrow ids of each of different words."""
        found = [*map(self.words.get, words)]
        new = [k for k, ids in enumerate(found) if ids is None]
        for k in new:
            found[k] = self.word(words[k])
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = range(len(words))
        self.words.update((words[k], found[k]) for k in islice(new, CACHE) if len(words[k]) <= LONG)
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode(text) for each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, int, str]] = []  # text, place in it, part
        size = 0

        def flush() -> None:
            for (k, place, _), ids in zip(held, self.simple_parts([part for *_, part in held]), strict=True):
                out[k][place] = ids
            held.clear()

        for k, text in enumerate(texts):
            for part in segments(text) if len(text) > SEGMENT else (text,):
                if self.simple(part):
                    for piece in segments(part, PLAIN_SEAM, BATCH) if len(part) > BATCH else (part,):
                        held.append((k, len(out[k]), piece))
                        out[k].append(b"")
                        size += len(piece)
                        if size >= BATCH:
                            flush()
                            size = 0
                else:
                    out[k].append(np.array(self.library.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes())
        if held:
            flush()
        return [b"".join(parts) for parts in out]

    def simple_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are simple, by the different words in them."""
        words, begin = words_of("\n".join(parts))
        found = self.look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        word = words.indices.to_numpy()
        n = size[word]
        upto = np.r_[0, np.cumsum(n)]
        place = np.repeat((np.cumsum(size) - size)[word] - upto[:-1], n) + np.arange(upto[-1])
        ids = np.frombuffer(b"".join(found), self.kind)[place].astype("<u4").tobytes()
        ends = np.cumsum([0, *((len(p) if p.isascii() else len(p.encode())) + 1 for p in parts)])
        at = (4 * upto[np.searchsorted(begin, ends)]).tolist()
        return [ids[a:b] for a, b in pairwise(at)]


def words_of(text: str):
    """The words of a plain text in lower case, as a dictionary array, and the bytes at which they begin.

    Words are the matches of 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+, the vocabulary's own way of splitting.
    """
    import pyarrow as pa

    raw = np.frombuffer((text.lower() + "   ").encode(), np.uint8)  # nothing below looks further than three bytes
    kind = KINDS[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    kind[lead] = kind[lead + 1] = KINDS[(raw[lead] & 31).astype(np.int64) << 6 | raw[lead + 1] & 63]
    begins = kind == DIGIT
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    begins[lead + 1] = False
    solid = kind != GAP
    begins &= solid
    quote = np.flatnonzero(raw == ord("'"))
    quote = quote[begins[quote]]
    a, b = raw[quote + 1], raw[quote + 2]
    for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
        at = quote[(a == ord(tail[0])) & (b == ord(tail[1]))] if tail[1:] else quote[a == ord(tail)]
        begins[at + 1] = False
        after = at + 1 + len(tail)
        begins[after] |= kind[after] == LETTER
    begin = np.flatnonzero(begins)
    data = raw[solid]
    offsets = np.r_[np.cumsum(solid, dtype=np.int32)[begin] - 1, len(data)].astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode(), begin


def segments(text: str, seams: re.Pattern = SEAM, size: int | None = None) -> Iterator[str]:
    """The text in parts whose ids don't depend on each other, each cut after a seam's first character."""
    start, size = 0, size or SEGMENT
    while seam := seams.search(text, start + size):
        yield text[start : seam.start() + 1]
        start = seam.start() + 1
    yield text[start:]


@functools.cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


class Tournament:
    """Capacities of bins as the leaves of a tree of maxima; bins are opened as they are needed."""

    def __init__(self, capacity: int, leaves: int):
        self.capacity, self.n, self.size = capacity, 0, 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.best = [capacity] * (2 * self.size)

    def place(self, amount: int) -> int:
        """The leftmost bin with room for amount, which it then holds."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < amount:
                node += 1
        bin_ = node - self.size
        best[node] -= amount
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        self.n = max(self.n, bin_ + 1)
        return bin_


Piece = tuple[int, int, int]  # document's place in the group, start, length


def pack(sizes: list[int], length: int = LENGTH) -> list[list[Piece]]:
    """Sequences, each the pieces that lie in it one after the other."""
    full: list[list[Piece]] = []
    rests: list[Piece] = []
    for d, n in enumerate(sizes):
        full += ([(d, s, length)] for s in range(0, n - length + 1, length))
        if n % length:
            rests.append((d, n - n % length, n % length))
    rests.sort(key=lambda p: (-p[2], p[0]))
    tree = Tournament(length, len(rests))
    bins: list[list[Piece]] = [[] for _ in rests]
    for p in rests:
        bins[tree.place(p[2])].append(p)
    bins = [b for b in bins if b]
    held = lambda b: sum(p[2] for p in b)
    bins.sort(key=held, reverse=True)
    room = [length - held(b) for b in bins]
    low, high = 0, len(bins) - 1
    while low < high:
        if not room[low]:
            low += 1
        elif not bins[high]:
            high -= 1
        else:
            d, start, n = bins[high].pop()
            take = min(n, room[low])
            bins[low].append((d, start, take))
            if take < n:
                bins[high].append((d, start + take, n - take))
            room[low] -= take
            room[high] += take
    last = [b for b in bins if b and held(b) < length]
    return full + [b for b in bins if b and held(b) == length] + [s for b in last for s in at_powers_of_two(b)]


def at_powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """One sequence cut into sequences whose lengths are powers of two."""
    left = sum(p[2] for p in pieces)
    out, pieces = [], pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            d, start, n = pieces.pop()
            take = min(n, room)
            out[-1].append((d, start, take))
            if take < n:
                pieces.append((d, start + take, n - take))
            room -= take
    return out


def encoded(docs: DataFrame, vocabulary: str, path: str | None, length: int, keep_ids: bool) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids: each document's full sequences and its rest.

    Only the rests need their ids, which have two bytes where the vocabulary allows it; with keep_ids all have them.
    """

    def encode(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = tokens(path or vocabulary_path(vocabulary))
        own.forget()  # what an earlier task left, if it was stopped
        narrow = own.narrow
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in text_slices(pc.binary_length(texts).to_pylist(), BATCH):
                row, start, size, crc, total, kept = [], [], [], [], [], []
                for k, ids in enumerate(own.encode_all(texts.slice(a, b - a).to_pylist()), a):
                    ids += END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    for s in range(0, n, length):
                        piece = ids[4 * s : 4 * (s + length)]
                        row.append(k)
                        start.append(s)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        kept.append(narrow(piece) if keep_ids or size[-1] < length else None)
                numbers = (pa.array(x, pa.int64()) for x in (start, size, crc, total))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *numbers, pa.array(kept, pa.binary())], names=schema.names)
        own.forget()  # workers live on for other tasks

    fields = ("start", "length", "ids_crc32", "doc_tokens")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f, T.LongType()) for f in fields), T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(tidy(encode), schema)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None, length: int = LENGTH, group_docs: int = GROUP_DOCS, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: where it lies in its document and in its sequence.

    With keep_ids also ids, the piece's own, as little-endian unsigned 32-bit integers.
    """
    pieces = cut(encoded(docs, vocabulary, path, length, keep_ids), ROWS)
    full = F.col("length") == length
    n = pieces.agg(F.count_if(~full).alias("rests"), F.count_if(full).alias("full")).first()
    groups = max(1, -(-n["rests"] // group_docs), -(-n["full"] // GROUP_FULL))

    def pack_group(got):
        import pyarrow as pa

        wide = tokens(path or vocabulary_path(vocabulary)).wide
        base = got.column("grp")[0].as_py() * SEQUENCES_A_GROUP
        start, size, crc, total = (got.column(c).to_numpy() for c in ("start", "length", "ids_crc32", "doc_tokens"))
        ids = got.column("ids").combine_chunks()
        rests, whole = np.flatnonzero(size < length), np.flatnonzero(size == length)
        rows = [(k, start[k], length, crc[k], total[k], base + i, 0) for i, k in enumerate(whole.tolist())]
        parts = [ids[k].as_py() for k in whole.tolist()] if keep_ids else None
        for i, sequence in enumerate(pack(size[rests].tolist(), length), len(whole)):
            offset = 0
            for d, s, n in sequence:
                k = int(rests[d])
                if n < size[k] or keep_ids:
                    own = wide(ids[k].as_buffer())[4 * s : 4 * (s + n)]
                rows.append((k, start[k] + s, n, zlib.crc32(own) if n < size[k] else crc[k], total[k], base + i, offset))
                if keep_ids:
                    parts.append(own)
                offset += n
        cols = list(zip(*rows, strict=True))
        out = [got.column("doc_id").take(pa.array(cols[0])), *(pa.array(np.array(c, np.int64)) for c in cols[1:])]
        if keep_ids:
            out.append(pa.array([wide(p) if k < len(whole) else p for k, p in enumerate(parts)], pa.binary()))
        return pa.table(out, names=schema.names)

    fields = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f, T.LongType()) for f in fields)])
    if keep_ids:
        schema.add("ids", T.BinaryType())
    # a written table has its rows in the same places whenever a task reads them, so the draw can be repeated
    dealt = pieces.withColumn("grp", F.floor(F.rand(7) * groups))
    return dealt.groupBy("grp").applyInArrow(pack_group, schema)
