import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lynceus.llm import crf_pii as C

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda: 8 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="01234567890011..--+@ (a)bé\n%", max_size=60))
def test_patterns_match_plain_expressions(text):
    assert C.base_spans(text) == brute(text)


def test_patterns_on_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a." * 100_000 + "@", "@" * 200_000, "+1" * 100_000, "1 " * 100_000):
        C.base_spans(text)
    assert C.base_spans("x" * 100_000 + "@a.b") == [("email", 0, 100_004)]
    assert C.base_spans("é 1.2.3.4.5.6.7.8, 4111 1111 1111 1111 é+49 (0)30 1234567.") == [("ip", 2, 9), ("ip", 10, 17), ("card", 19, 38), ("phone", 40, 57)]


@pytest.fixture(scope="module")
def field():
    return C.train(C.examples())


def test_viterbi_matches_brute_force(field):
    decoder = C.Decoder(field)
    for s in [e for e in C.examples(40, seed=5) if len(e) <= 5]:
        ws = [w for w, _ in s]
        emit = np.stack([decoder.scores(w) for w in ws])
        value = lambda p: field.begin[p[0]] + sum(emit[t, 0, y] for t, y in enumerate(p)) + sum(emit[t - 1, 1, y] for t, y in enumerate(p) if t) + sum(emit[t + 1, 2, y] for t, y in enumerate(p) if t + 1 < len(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E501, E731
        best = max(value(p) for p in itertools.product(range(len(C.LABELS)), repeat=len(ws))) if len(ws) <= 4 else None
        got = decoder.labels([ws, ["x"] * 9])[0]
        if best is not None:
            assert abs(value(got.tolist()) - best) < 1e-6


def test_held_out_accuracy(field):
    table = C.examples(300, seed=99)
    got = C.Decoder(field).labels([[w for w, _ in s] for s in table])
    hits = [C.LABELS[y] == b for s, p in zip(table, got) for (_, b), y in zip(s, p)]
    assert np.mean(hits) > 0.95


def test_table(spark, field):
    texts = [None, "", "mail bob [at] mail [dot] com now", "call 555-123-4567.", "call +49 30 1234567 or a.b@c.de", "Licensed under the GNU General Public License, version 3.", "nothing here at all", "word " * 20_000 + "x@y.zz"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "a@b.c", "s")] * 2, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in C.personal_data(docs, field).collect()}
    for i, t in enumerate(texts):
        base = brute(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[i].n_email == sum(k == "email" for k, _, _ in base) and got[i].n_phone == sum(k == "phone" for k, _, _ in base)
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert got[2].spans == "email:5:28" and got[3].spans == "phone:5:17"
    assert got[5].spans == got[6].spans == got[0].spans == ""
    assert C.personal_data(docs, field).count() == len(texts) + 2
    assert C.personal_data(docs.limit(0), field).count() == 0
    assert C.redacted(texts[3], [("phone", 5, 17)]) == "call [phone]."
    assert random.Random(1).random() < 1


#: Written by hand, not by the generator; {kind:...} marks what is personal.
BY_HAND = """
please write to {email:anna at example dot org} before friday
mail {email:bob at mail dot com}
you can reach me at {email:j.miller [at] web [dot] de} any time
contact: {email:sales(at)shop(dot)example(dot)com}, thanks
call me on {phone:(555) 123-4567} tonight
my number is {phone:555-867-5309}.
tel {phone:020 7946 0958} or leave a note
paid with card {card:4111.1111.1111.1111} yesterday
visa {card:4111/1111/1111/1111} was declined
the server {ip:2001:0db8:85a3:0000:0000:8a2e:0370:7334} is down
schreib an {email:karl [at] beispiel [dot] de} bitte
ruf mich unter {phone:030-123-4567} an
Telefon {phone:0171 2345678} ist neu
die Karte {card:4111.1111.1111.1111} ist gesperrt
écrivez à {email:marie [at] exemple [dot] fr} demain
appelez le {phone:01.23.456.7890} ce soir
téléphone {phone:06 12 34 56 78} le matin
correo {email:jose at ejemplo dot es}
llame al {phone:915-123-4567} por favor
there was a dot com crash in 2001 at the time
we meet at 10:30 at the station on 12 May 2024
version 3.11.2 was released on 2023-10-04
the a dot and the dash are signs
Rechnung Nr. 12345 vom 03.04.2021 über 99,90
le 14 juillet 1789 à Paris
son 25 de marzo de 2020 a las 12:45
page 12 of 300 and chapter 7
"""


def test_spans_of_sentences_by_hand(field):
    decoder, hits, wrong, total = C.Decoder(field), 0, [], 0
    for line in filter(None, BY_HAND.split("\n")):
        text, want = "", set()
        for part in re.split(r"(\{\w+:[^}]*\})", line):
            if m := re.fullmatch(r"\{(\w+):([^}]*)\}", part):
                want.add((m[1], len(text), len(text) + len(m[2])))
                part = m[2]
            text += part
        got = set(C.found([text], decoder)[0][1])
        total += len(want)
        hits += len(want & got)
        wrong += [(text, got - want, want - got)] if got != want else []
    assert hits >= 0.85 * total, (hits, total, wrong)
    assert sum(len(g) for _, g, _ in wrong) <= 2, wrong


def test_long_words_and_endless_lines(field):
    decoder = C.Decoder(field)
    text = "mail " + "a" * 70 + "[at]mail.com now"
    assert C.found([text], decoder)[0][1] == [("email", 5, 5 + 70 + len("[at]mail.com"))]
    assert C.found(["mail bob at mail dot com"], decoder)[0][1] == [("email", 5, 24)]
    line = "7 " * 30_000
    text = line + "call 555-123-4567 " + line
    assert ("phone", len(line) + 5, len(line) + 17) in C.found([text], decoder)[0][1]
    runs = list(C.neighbourhoods(text))
    assert max(len(r) for r, _, _ in runs) <= C.PART + C.NEAR + 1 and len(runs) > 10
    starts = [w for r, a, b in runs for w, _ in r[a:b]]
    assert len(starts) == len(set(starts)) == 60_002
