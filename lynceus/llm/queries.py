"""The queries op1 to op10 and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_count, compact_windows, crf_pii, line_spread, mixing, ngram_join, packing, pivot_index, rule_ensemble, rule_ledger
from .columns import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.verdicts(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.scores(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_pii.personal_data(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM base
), grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_zip(w[1:-3], w[2:-2], w[3:])) AS g
  FROM parts WHERE len(w) >= 3
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), measured AS (
  SELECT p.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_capitals
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id
), judged AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END)::BIGINT AS failed_rules
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules
FROM judged
"""


OP2_SQL = r"""
WITH lines AS (
  SELECT row_number() OVER () AS rn, doc_id, text, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), each AS (
  SELECT rn, site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM lines
), keyed AS (
  SELECT *, trim(line, E'\t\n\x0b\x0c\r ') AS k, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM each
), spread AS (
  SELECT k FROM keyed WHERE worded GROUP BY k HAVING count(DISTINCT site) >= 10
), judged AS (
  SELECT e.*, e.worded AND s.k IS NOT NULL AS gone FROM keyed e LEFT JOIN spread s ON e.k = s.k
), texts AS (
  SELECT rn, count(*) FILTER (WHERE worded) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone, any_value(site) AS site,
         list(k ORDER BY i) FILTER (WHERE worded) AS sequence, coalesce(sum(length(line)) FILTER (WHERE gone), 0) AS c_gone,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS clean
  FROM judged GROUP BY rn
), copied AS (
  SELECT sequence FROM texts WHERE n_lines > 0 GROUP BY sequence HAVING count(DISTINCT site) >= 10
), decided AS (
  SELECT t.*, c.sequence IS NULL AND n_gone > 0 AS loses FROM texts t LEFT JOIN copied c ON t.sequence = c.sequence
)
SELECT doc_id, n_lines::BIGINT AS n_lines, CASE WHEN loses THEN n_gone ELSE 0 END::BIGINT AS n_removed,
       CASE WHEN loses THEN c_gone ELSE 0 END::BIGINT AS n_chars_removed, md5(CASE WHEN loses THEN clean ELSE text END) AS clean_md5
FROM lines JOIN decided USING (rn)
"""


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ends AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS r FROM ends UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON reach.r = ends.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT a AS vec_id, a AS r FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a
), least_one AS (
  SELECT vec_id, min(r) AS m FROM reach GROUP BY vec_id
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, coalesce(least(v.vec_id, m), v.vec_id) AS component_id, v.vec_id = coalesce(least(v.vec_id, m), v.vec_id) AS kept
FROM v LEFT JOIN least_one r ON r.vec_id = v.vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_substring_dedup, op4_quality_classifier, op5_pii, op6_token_counts, op7_mixing, op8_ngram_join, op9_embedding_dedup, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_line_dedup": OP2_SQL, "op8_ngram_join": OP8_SQL, "op9_embedding_dedup": OP9_SQL}
