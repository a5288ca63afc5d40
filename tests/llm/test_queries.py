"""Queries that have SQL against it, and the shape of all, on the smallest tables."""

import os

import duckdb
import pytest

from lynceus.llm import queries as Q

DATA = "/root/testdata/sf0.001"
SHAPES = {
    "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3_substring_dedup": ["doc_id", "start", "end", "component_id"],
    "op4_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op7_mixing": ["doc_id", "source", "pass", "block_rank", "place", "n_tokens"],
    "op8_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op9_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    got = Q.queries()[name](spark, DATA)
    if name in SHAPES:
        assert got.columns[: len(SHAPES[name])] == SHAPES[name]
    have = [tuple(r) for r in got.collect()]
    assert have
    sql = Q.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for t in ("documents", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        want = c.execute(sql)
        columns = [d[0] for d in want.description]
        order, mine = sorted(columns), sorted(got.columns)
        assert order == mine
        pick = lambda cols, rows: sorted((tuple(r[cols.index(x)] for x in order) for r in rows), key=str)
        assert pick(got.columns, have) == pick(columns, want.fetchall())
