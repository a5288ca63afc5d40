"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once for each document and stores the measurements and a
bitmask of failed rules. A policy is a named, versioned set of rules; applying one to a ledger
is a single bitwise AND, so policies can change without reading a text again. `ablation`
answers "what would each rule alone change?" from the counts of the distinct masks.

Everything is built-in column expressions over one row: no shuffle, no Python.

Defined results for edge cases: a null, empty or blank text has no words and no lines and fails
`few_words`; ratios over nothing are 0. Null doc_ids and repeated rows pass through, one row each.
Columns of the input other than the two that are named do not reach the result unless asked for.

Two 3-word windows count as equal when their 64-bit hashes are equal, within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, share, text_or_empty, worded_lines, words

WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A named predicate over measurements, true where a document fails."""

    name: str
    bit: int
    sql: str


#: Bits are never reused: a rule that goes leaves its bit unused.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 25 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", 5, "100 * n_capitals > 50 * word_chars"),
)
BASE = ("few_words", "repeated_windows")
#: Versions of policies; a new idea gets a new version.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "word_length", "capitals"),
}
CURRENT = "v1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def repeat_words(word_list: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first one included.

    Windows become 64-bit hashes. If all differ, the answer is 0. Otherwise (hash, position)
    pairs are sorted, so equal windows are neighbours, and the covered words are summed over
    the positions of the windows that have an equal neighbour: n log n for a text of n words.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def positions(s: Column) -> Column:
        near = lambda x, k, step: F.coalesce(F.get(s, k + step)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(near(x, k, -1) | near(x, k, 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        state = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("long").alias("n"))
        step = lambda acc, i: state(i, acc["n"] + F.least(F.lit(WINDOW), i - acc["at"]))
        return F.aggregate(p, state(F.lit(-WINDOW), F.lit(0)), step, lambda acc: acc["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(let(pairs, positions)))

    return F.when(F.size(word_list) < WINDOW, F.lit(0).cast("long")).otherwise(let(word_list, lambda w: let(hashes(w), count)))


def measurements(text: Column) -> Column:
    """One struct of MEASURES."""
    clean = text_or_empty(text)

    def by_words(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            F.regexp_count(clean, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.regexp_count(clean, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        )

    return let(words(clean), lambda w: let(worded_lines(clean), lambda lines: by_words(w, lines)))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, the measurements, and failed: a bit for each rule that the document fails."""
    measured = docs.select(*(F.col(c) for c in keep), measurements(F.col(text)).alias("_m")).select(*keep, *(F.col("_m")[c].alias(c) for c in MEASURES))
    failed = F.lit(0).cast("long")
    for r in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def passes(policy: str | tuple[str, ...], failed: Column | None = None) -> Column:
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(kept_ledger: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it fails.

    One aggregation over the masks (at most 2 ** rules groups, pre-aggregated before the
    shuffle), then a bitwise pass over those counts. Columns rule, n_failed, n_only, n_docs,
    share_only; every rule of the policy has a row, also over an empty ledger.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    all_bits = F.lit(mask(policy)).cast("long")
    counts = kept_ledger.groupBy(F.col("failed").bitwiseAND(all_bits).alias("m")).agg(F.count("*").alias("n"))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), *(c for n in names for c in _rule_counts(n)))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"_f_{n}").alias("n_failed"), F.col(f"_o_{n}").alias("n_only")) for n in names)))
    return one.select("n_docs", rows.alias("r")).select("r.rule", "r.n_failed", "r.n_only", "n_docs", share(F.col("r.n_only"), F.col("n_docs")).alias("share_only"))


def _rule_counts(name: str) -> tuple[Column, Column]:
    bit = F.lit(mask((name,))).cast("long")
    total = lambda test, to: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long").alias(to)
    return total(F.col("m").bitwiseAND(bit) != 0, f"_f_{name}"), total(F.col("m") == bit, f"_o_{name}")


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The result of op1: measurements, base_failed, and kept under the base rules and the policy."""
    book = ledger(docs)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"),
        (passes("base") & passes(policy)).alias("kept"),
        F.col("failed").alias("failed_rules"),
    )
