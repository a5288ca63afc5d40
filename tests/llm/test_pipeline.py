import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from lynceus.llm import packing
from tests.llm.test_line_spread import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows = []
    for i in range(240):
        kind = i % 6
        if kind == 0:  # junk
            text = " ".join(f"{word()}$$$" for _ in range(60))
        elif kind == 1 and i > 6:  # near copy of an earlier good document
            words = rows[i - 5 if (i - 5) % 6 == 2 else 2][1].split(" ")
            words[-1] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(rng.randint(60, 120)))
        if kind == 3:
            text += "\nAll rights reserved by the shared footer"
        rows.append((i, text, "en", f"src{i % 12 if i % 2 else 0}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen[name] = at.collect()
        if name != "pack":
            assert at.columns == docs.columns
    assert {r.doc_id for r in seen["quality"]} == {i for i in range(240) if i % 6}
    want = {d: t for d, _, _, _, t in brute_lines([(r.doc_id, r.text, r.source) for r in seen["quality"]], 10)}
    assert {r.doc_id: r.text for r in seen["line_dedup"]} == want
    groups = brute_groups([(r.doc_id, r.text) for r in seen["line_dedup"]])
    assert {r.doc_id for r in seen["near_duplicates"]} == {d for d, _, c in groups if d == c} < set(want)
    assert {r.doc_id for r in seen["mix"]} == {r.doc_id for r in seen["near_duplicates"]}
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, packing.END_ID], "<u4") for r in seen["mix"]}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in seen["pack"])
    times, tokens = Counter(r.doc_id for r in seen["mix"]), Counter()
    for r in seen["pack"]:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({d: n * len(ids[d]) for d, n in times.items()})
    assert sum(r.doc_tokens for r in seen["pack"] if r.start == 0) == sum(r.length for r in seen["pack"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, row string, node long, grp long"


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    good = [text(80) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "k", "r", 1, 2) for i, t in enumerate(good)]
    rows += [rows[3], rows[3], (None, good[5], "en", "s0", 1, "k", "r", 1, 2), (None, text(70), None, None, None, None, None, None, None), (40, None, "en", "s1", None, "k", "r", 1, 2), (41, "", "en", "s1", 0, "k", "r", 1, 2), (42, text(60_000), "en", "s2", 1, "k", "r", 1, 2)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, seen = at.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == names
        seen[name] = Counter((r.doc_id, r.text) for r in at.collect())
    want = Counter((r[0], r[1]) for r in rows)
    assert seen["quality"] == want  # all labels are good, so nothing is rejected
    assert seen["near_duplicates"] == want  # rows of one id are one document, and a row without an id is no copy
    assert set(seen["mix"]) == set(want)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows} and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert min(r.length for r in out if r.doc_id in (40, 41)) == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
