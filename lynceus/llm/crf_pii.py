"""Personal data in texts: fixed patterns, and a linear-chain conditional random field.

The patterns find what they define, leftmost and non-overlapping for each kind, in time linear in the text.
The field then reads the words near digits, at-signs, "at"s and "dot"s, spelled or bracketed, and groups of colons: each whole word gives
features of its shape and of its neighbours', trained by maximum likelihood on the small labelled table that
`examples` makes. Viterbi decodes padded batches of word sequences in numpy. What it finds is added where it
is well formed and touches no pattern's span, so patterns' spans always stay. What is `well_formed` holds
a digit, an at-sign, a spelled or bracketed "dot" or four colons, and no words but those of an address; so
words further than `NEAR` from any of those can be in no span, and the field leaves them out.

Defined results: a null text counts as empty; offsets count code points, ends are exclusive. Null
ids, repeated rows and further columns don't matter, one row comes out for each row that goes in.
A line of very many such words is read in parts of `PART` words that overlap by `OVERLAP`, more words than any span has.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .worker import tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
NEAR = 4
#: Longer words are read whole, but what the field says of them is not remembered.
LONGEST_WORD = 64
PART, OVERLAP = 4096, 64
#: Words of sequences that are decoded together.
BATCH = 20_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_REVERSED = re.compile(r"[A-Za-z0-9._%+-]+")
# a match of these always takes whole runs of digits, so none begins within one
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match must have its at-sign right after a run of local characters, and the run's begin is leftmost."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL_REVERSED.match(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as in KINDS, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(NO_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the field: examples, features, training, decoding


def examples(n: int = 1400, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The labelled table: sentences of (word, label), made from a few forms by chance."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    name = lambda: "".join(rng.choices("abcdeimnorstu", k=rng.randint(3, 8)))
    plain = lambda: rng.choice([name(), name().capitalize(), *"the of and is on at for und der die ist an bei et le la est sur à y el de es en por".split()])
    said = lambda word: word if rng.random() < 0.8 else word.upper()

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([[f"{a}-{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}.{b}.{c}"], [a, b, c], [f"+{digits(2)}", a, digits(7)], [f"+{digits(2)}-{a}-{b}-{c}"], [f"0{digits(3)}", digits(6)], [f"+{digits(11)}"], [f"0{digits(1)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}"], [f"0{digits(1)}", *(digits(2) for _ in range(4))]])

    def card():
        g = [digits(4) for _ in range(4)]
        return rng.choice([g, ["-".join(g)], ["".join(g)], [".".join(g)], ["/".join(g)], [digits(4), digits(6), digits(5)]])

    def mail():
        u, d, t = name(), name(), rng.choice(["com", "org", "net", "de", "fr", "es", "io", "info"])
        if rng.random() < 0.5:  # spelled
            user = rng.choice([[u], [u], [u], [u, "dot", name()], [f"{u}.{name()}"], [u + digits(2)]])
            host = rng.choice([[d, said("dot"), t], [d, said("dot"), t], [f"{d}.{t}"], [d, said("dot"), name(), "dot", t]])
            return user + [said("at")] + host if len(host) > 1 else [u, rng.choice(["[at]", "(at)", "{at}"]), *host]
        return rng.choice([[f"{u}@{d}.{t}"], [f"{u}.{name()}{digits(2)}@{d}.{t}"], [u, "[at]", d, "[dot]", t], [u, "(at)", d, "(dot)", t], [u, "@", f"{d}.{t}"], [f"{u}[at]{d}.{t}"], [f"{u}(at){d}.{t}"]])

    def ip():
        q = [str(rng.randint(1, 255)) for _ in range(4)]
        h = ":".join("".join(rng.choices("0123456789abcdef", k=4)) for _ in range(8))
        return rng.choice([[".".join(q)], [".".join(q) + f":{digits(4)}"], [h], [".".join(q) + "/24"]])

    def other():
        y = f"{rng.randint(1990, 2030)}"
        return rng.choice([[y], [f"{y}-{digits(2)}-{digits(2)}"], ["version", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}."], [f"${digits(3)}.{digits(2)}"], [f"{digits(2)}%"], [digits(1)], [digits(6)], [f"{digits(2)}:{digits(2)}"], [f"No.{digits(5)}"], [f"{rng.randint(1, 9)}.{rng.randint(0, 9)}"], ["".join(rng.choices("0123456789abcdef", k=40))], ["@" + name()], [f"{digits(3)},{digits(3)}"], [f"id{digits(8)}"], [digits(9)], [digits(3), name(), digits(4)], [name() + digits(1)],
            ["at", name(), "dot"], ["a", "dot", "and", "a", "dash"], ["the", "dot", "com", name()], ["dot", "product"], [name(), "at", digits(2), name()], ["at", "the", "dot"], [f"{digits(1)}.", name()], [f"{digits(2)}.{digits(2)}.{y}"], [digits(2), "of", name(), y], [f"{digits(4)}-{digits(4)}", name()], ["::", name(), "::"]])

    cues = {
        "phone": "call phone tel tel: mobile fax phone: Telefon Handy Tel.: ruf téléphone appelez portable teléfono llame móvil".split(),
        "card": "card visa card: credit Karte Kreditkarte carte tarjeta".split(),
        "email": "mail email write contact email: E-Mail schreib courriel écrivez correo escriba".split(),
        "ip": "host ip server address from Rechner serveur adresse servidor dirección".split(),
    }
    out = []
    for _ in range(n):
        sentence = [(plain(), "O") for _ in range(rng.randint(0, NEAR))]
        kind = rng.choice([*KINDS, *KINDS, "other", "other", "other"])
        if kind == "other":
            sentence += [(w, "O") for w in other()]
        else:
            if rng.random() < 0.6:
                sentence.append((rng.choice(cues[kind]), "O"))
            made = {"phone": phone, "card": card, "email": mail, "ip": ip}[kind]()
            if rng.random() < 0.3:
                made[-1] += rng.choice(".,;)")
            sentence += [(w, ("I-" if k else "B-") + kind) for k, w in enumerate(made)]
        out.append(sentence + [(plain(), "O") for _ in range(rng.randint(0, NEAR))])
    return out


RUNS = re.compile(r"([A-Z]+)|([a-z]+)|([0-9]+)")
CUES = frozenset(
    """call phone tel mobile fax card visa credit mail email write contact host ip server address from at dot com org net de fr es version no the a and of
    telefon handy ruf téléphone appelez portable teléfono llame móvil karte kreditkarte carte tarjeta e-mail schreib courriel écrivez correo escriba
    rechner serveur adresse servidor dirección product""".split()
)


def shape(word: str) -> str:
    """Letters as A or a, digits as d with their number, other signs as they are."""
    return RUNS.sub(lambda m: "A" if m[1] else "a" if m[2] else f"d{min(len(m[3]), 20)}", word)


def features(word: str) -> list[str]:
    bare = word.strip(".,;:!?()[]<>'\"").lower()
    n = sum(c.isdigit() for c in word)
    out = [f"shape={shape(word)}", f"core={shape(bare)}", f"digits={n}", f"first={shape(word[:1])}"]
    out += [f"has{c}" for c in "@.-+:/()[" if c in bare or c in "([" and c in word]
    if bare in CUES:
        out.append(f"word={bare}")
    if n and n < len(bare) and any(c.isalpha() for c in bare):
        out.append("mixed")
    return out


@dataclass
class Field:
    """Weights: by feature and place (the word itself, the one before, the one after) for each label, and between labels."""

    index: dict[str, int]
    weights: np.ndarray  # features x places x labels
    moves: np.ndarray  # label x next label, with -inf for what can't follow
    begin: np.ndarray

    def scores(self, word: str) -> np.ndarray:
        known = [self.index[f] for f in features(word) if f in self.index]
        return self.weights[known].sum(axis=0) if known else np.zeros(self.weights.shape[1:])


def allowed() -> tuple[np.ndarray, np.ndarray]:
    n = len(LABELS)
    moves, begin = np.zeros((n, n)), np.zeros(n)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            begin[j] = -1e9
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:]:
                    moves[i, j] = -1e9
    return moves, begin


def train(table: list[list[tuple[str, str]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam on all sentences at once."""
    names = sorted({f for s in table for w, _ in s for f in features(w)})
    index = {f: k for k, f in enumerate(names)}
    n, t_max, y = len(table), max(map(len, table)), len(LABELS)
    label = np.zeros((n, t_max), dtype=np.int64)
    length = np.array([len(s) for s in table])
    rows, cols = [], []
    for i, s in enumerate(table):
        for t, (w, b) in enumerate(s):
            label[i, t] = LABELS.index(b)
            for f in features(w):
                for place, at in enumerate((t, t + 1, t - 1)):  # itself; it is before t + 1; it is after t - 1
                    if 0 <= at < len(s):
                        rows.append(i * t_max + at)
                        cols.append(index[f] * 3 + place)
    rows, cols = np.array(rows), np.array(cols)
    inside = np.arange(t_max) < length[:, None]
    hard_moves, hard_begin = allowed()
    w, m = np.zeros((len(names) * 3, y)), np.zeros((y, y))
    gold = np.zeros((n, t_max, y))
    np.put_along_axis(gold, label[:, :, None], 1.0, axis=2)
    gold *= inside[:, :, None]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, m)]
    for step in range(1, steps + 1):
        emit = np.zeros((n * t_max, y))
        np.add.at(emit, rows, w[cols])
        emit = emit.reshape(n, t_max, y)
        moves = m + hard_moves
        ahead, back = np.zeros((n, t_max, y)), np.zeros((n, t_max, y))
        ahead[:, 0] = emit[:, 0] + hard_begin
        for t in range(1, t_max):
            ahead[:, t] = np.where(inside[:, t, None], log_sum(ahead[:, t - 1, :, None] + moves, 1) + emit[:, t], ahead[:, t - 1])
        total = log_sum(ahead[:, -1], 1)
        for t in range(t_max - 2, -1, -1):
            back[:, t] = np.where(inside[:, t + 1, None], log_sum(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0.0)
        chance = np.exp(ahead + back - total[:, None, None]) * inside[:, :, None]
        pair = np.zeros((y, y))
        for t in range(t_max - 1):
            p = ahead[:, t, :, None] + moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :] - total[:, None, None]
            pair += np.exp(p[inside[:, t + 1]]).sum(axis=0)
        diff = (gold - chance).reshape(-1, y)
        grad_w = np.zeros_like(w)
        np.add.at(grad_w, cols, diff[rows])
        for p, g, (a, b) in zip((w, m), (grad_w / n - decay * w, (gold_moves - pair) / n - decay * m), state, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Field(index, w.reshape(len(names), 3, y), m + hard_moves, hard_begin)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Decoder:
    """Viterbi over batches of word sequences. Scores of at most CACHE words are remembered."""

    CACHE = 50_000

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, np.ndarray] = {}

    def scores(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            found = self.field.scores(word)
            if len(word) <= LONGEST_WORD:
                if len(self.known) >= self.CACHE:
                    self.known.clear()
                self.known[word] = found
        return found

    def labels(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The most likely labels of each sequence; sequences of like length are padded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        start = 0
        while start < len(order):
            stop, width = start, 0
            while stop < len(order) and (stop == start or (stop - start + 1) * len(sequences[order[stop]]) <= BATCH):
                width = len(sequences[order[stop]])
                stop += 1
            if width:
                for i, path in zip(order[start:stop], self._batch([sequences[i] for i in order[start:stop]], width), strict=True):
                    out[i] = path
            start = stop
        return out

    def _batch(self, sequences: list[list[str]], width: int) -> list[np.ndarray]:
        y = len(LABELS)
        length = np.array([len(s) for s in sequences])
        none = np.zeros((3, y))
        scores = lambda t: np.array([self.scores(s[t]) if t < len(s) else none for s in sequences])
        came = np.zeros((len(sequences), width, y), dtype=np.int8)
        before, here = np.zeros((len(sequences), 3, y)), scores(0)
        for t in range(width):
            after = scores(t + 1) if t + 1 < width else np.zeros_like(here)
            emit = here[:, 0] + before[:, 1] + after[:, 2]
            if t:
                step = best[:, :, None] + self.field.moves
                came[:, t] = step.argmax(axis=1)
                best = np.where((t < length)[:, None], step.max(axis=1) + emit, best)
            else:
                best = emit + self.field.begin
            before, here = here, after
        path = np.zeros((len(sequences), width), dtype=np.int8)
        last = best.argmax(axis=1)
        for t in range(width - 1, -1, -1):
            path[:, t] = np.where(t < length, last, 0)
            if t:
                last = np.where(t < length, came[np.arange(len(sequences)), t, last], last)
        return [p[:n] for p, n in zip(path, length, strict=True)]


DOT = r"(?<![A-Za-z])(?i:dot)(?![A-Za-z])"
TRIGGER = re.compile(rf"[0-9@]|[\[({{](?i:at|dot)[\])}}]|{DOT}|:[0-9A-Fa-f]{{0,4}}:")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
OUTER = ".,;:!?()[]<>'\"|"
Run = list[tuple[int, str]]  # words with where they start


def neighbourhoods(text: str) -> Iterator[tuple[Run, int, int]]:
    """Runs of words around words with a trigger, within their lines, and between which two of them spans may begin."""
    done = 0
    while m := TRIGGER.search(text, done):
        start = max(text.rfind("\n", 0, m.start()) + 1, done)
        stop = text.find("\n", m.start())
        stop = len(text) if stop < 0 else stop
        run: Run = []
        before: Run = []
        after = first = 0
        for w in WORD.finditer(text, start, stop):
            item = (w.start(), w[0])
            if TRIGGER.search(w[0]):
                run += [*before, item]
                before, after = [], NEAR
            elif after:
                run.append(item)
                after -= 1
            else:
                before = [*before, item][-NEAR:]
                if run and len(before) == NEAR:
                    yield run, first, len(run)
                    run, first = [], 0
            if len(run) >= PART:
                yield run, first, len(run) - OVERLAP // 2
                run, first = run[-OVERLAP:], OVERLAP // 2
        if run:
            yield run, first, len(run)
        done = stop


_NAME, _PART = r"[\w.%+-]+", r"\w[\w-]*"
_DOT = r"(?:\s+dot\s+|\s*[\[({]dot[\])}]\s*)"
#: An address with its signs as they are, in brackets or as words; a spelled "at" asks for a spelled "dot".
SPELLED = re.compile(rf"(?i){_NAME}(?:{_DOT}{_NAME})*(?:\s*(?:@|[\[({{]at[\])}}])\s*{_PART}(?:(?:{_DOT}|\s*\.\s*){_PART})+|\s+at\s+{_PART}(?:{_DOT}{_PART})+)")


def well_formed(kind: str, part: str) -> bool:
    n = sum("0" <= c <= "9" for c in part)
    if kind == "email":
        return SPELLED.fullmatch(part) is not None
    if kind == "ip":
        return part.count(".") >= 3 or part.count(":") >= 4
    if kind == "card":
        return 13 <= n <= 19 and luhn(NO_DIGIT.sub("", part))
    return 8 <= n <= 15 and bool(re.fullmatch(r"[+0-9().\x20/-]+", part))


def added_spans(texts: list[str], bases: list[list[Span]], decoder: Decoder) -> list[list[Span]]:
    runs = [(i, r) for i, t in enumerate(texts) for r in neighbourhoods(t)]
    out: list[list[Span]] = [[] for _ in texts]
    for (i, (run, first_word, last_word)), path in zip(runs, decoder.labels([[w for _, w in r] for _, (r, _, _) in runs]), strict=True):
        t = first_word
        while t < last_word:
            if LABELS[path[t]][0] != "B":
                t += 1
                continue
            kind, first = LABELS[path[t]][2:], t
            t += 1
            while t < len(run) and LABELS[path[t]] == f"I-{kind}":
                t += 1
            a, b = run[first][0], run[t - 1][0] + len(run[t - 1][1])
            part = texts[i][a:b]
            opens = len(part) - len(part.lstrip(OUTER.replace("(", "") if kind == "phone" else OUTER))
            a, b = a + opens, b - (len(part) - len(part.rstrip(OUTER)))
            if a < b and well_formed(kind, texts[i][a:b]) and not any(p < b and a < q for _, p, q in bases[i]):
                out[i].append((kind, a, b))
    return out


def found(texts: list[str], decoder: Decoder) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and all spans, both ordered."""
    bases = [base_spans(t) for t in texts]
    order = {k: n for n, k in enumerate(KINDS)}
    return [(b, sorted(b + a, key=lambda s: (order[s[0]], s[1]))) for b, a in zip(bases, added_spans(texts, bases, decoder), strict=True)]


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The result of op5: a row for each row of docs."""
    field = field or train(examples())

    def find(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from .bpe_count import text_slices

        decoder = Decoder(field)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in text_slices(pc.binary_length(texts).to_pylist()):
                got = found(texts.slice(a, b - a).to_pylist(), decoder)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *counts, digest, pa.array([joined(every) for _, every in got])], names=names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(tidy(find), schema)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
            end = b
    return "".join([*out, text[end:]])
