"""Cross-site boilerplate lines by distinct-site spread.

Each line's sites go into a HyperLogLog sketch; sketches merge by aggregation, so a line of a
third of all rows is one small row a task. Lines whose estimate is well above the threshold
are boilerplate, those well below are not, and the few near it get an exact distinct count. Texts that
hold boilerplate lines then lose them.

A text whose whole sequence of lines lies on as many sites is a document that was copied there, which is why its lines
are on them; it stays whole, as whole copies are document deduplication's work. All other texts lose their boilerplate,
whatever its share: one of boilerplate alone is empty then.

Native operations only. Lines are \\n-split, trimmed of ASCII white space, and compared by a 64-bit
hash; lines without a word are not counted and not removed.

Defined results: null and empty texts have no lines and stay as they are. Rows with a null site count as
one site together. Null ids, repeated rows and further columns don't matter: one row for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import NOT_GAP, cut, text_or_empty

#: Lines on this many sites or more are boilerplate.
SITES = 10
LG_K = 12
#: Texts with boilerplate are broadcast up to this number of them and of bytes together; more are joined by a shuffle.
BROADCAST_TEXTS, BROADCAST_BYTES = 250_000, 16 << 20
TRIMMED = "\t\n\x0b\x0c\r "


def key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(TRIMMED)))


def lines_of(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n")


def worded(lines: Column) -> Column:
    return F.filter(lines, lambda line: line.rlike(NOT_GAP))


def occurrences(docs: DataFrame, site: str, text: str) -> DataFrame:
    """whole (a hash of the text), site, key: a row for each line with a word."""
    keys = F.transform(worded(lines_of(F.col(text))), key)
    return docs.select(F.xxhash64(text).alias("whole"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(keys).alias("key"))


def boilerplate(found: DataFrame, sites: int = SITES) -> DataFrame:
    """key of every line on at least `sites` distinct sites."""
    error = 3 * 1.04 / 2 ** (LG_K / 2)
    spread = cut(found.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n")).where(F.col("n") >= sites * (1 - error) - 1))
    sure = F.col("n") > sites * (1 + error) + 1
    near = spread.where(~sure).select("key")
    exact = found.join(near, "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return cut(spread.where(sure).select("key").unionByName(exact.select("key")))


def small(hits: DataFrame, texts: int) -> bool:
    """Whether hits (whole, keys) may be broadcast: rows take 64 bytes and 8 for each key."""
    n, keys = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    return n <= texts and 64 * n + 8 * keys <= BROADCAST_BYTES


def removed(docs: DataFrame, sites: int = SITES, site: str = "source", text: str = "text", broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """A row for each of docs: row (a struct of its columns), and clean (the text without boilerplate), n_lines, n_removed, n_chars_removed."""
    found = occurrences(docs, site, text)
    hits = cut(found.join(boilerplate(found, sites), "key", "left_semi").groupBy("whole").agg(F.collect_set("key").alias("keys")))
    hits = F.broadcast(hits) if small(hits, broadcast_texts) else hits
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), F.xxhash64(text).alias("whole")).join(hits, "whole", "left")
    lines = lines_of(F.col("text"))
    is_hit = lambda line: F.array_contains("keys", key(line)) & line.rlike(NOT_GAP)
    chars = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    kept, gone = F.filter(lines, lambda line: ~is_hit(line)), F.filter(lines, is_hit)
    # only a text that consists of boilerplate can have a sequence that lies on so many sites
    keys = F.transform(worded(lines), key)
    only = F.col("keys").isNotNull() & F.forall(keys, lambda k: F.array_contains("keys", k))
    rows = rows.withColumn("sequence", F.when(only, F.xxhash64(keys, F.size(keys))))
    sites_of = rows.where(F.col("sequence").isNotNull()).select("sequence", F.coalesce(F.col("row")[site].cast("string"), F.lit("")).alias("site")).distinct()
    copies = cut(sites_of.groupBy("sequence").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("sequence", F.lit(True).alias("copied")))
    rows = rows.join(F.broadcast(copies) if copies.count() <= broadcast_texts else copies, "sequence", "left")
    n_lines = F.size(worded(lines)).cast("long").alias("n_lines")
    count = lambda n, c: (n.cast("long").alias("n_removed"), c.cast("long").alias("n_chars_removed"))
    whole = F.struct(F.col("text").alias("clean"), n_lines, *count(F.lit(0), F.lit(0)))
    less = F.struct(F.array_join(kept, "\n").alias("clean"), n_lines, *count(F.size(gone), chars(gone)))
    result = F.when(F.col("keys").isNotNull() & F.col("copied").isNull(), less).otherwise(whole)
    return rows.select("row", result.alias("r")).select("row", "r.*")


def report(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The result of op2: what each row keeps."""
    out = removed(docs.select("doc_id", "text", "source"), sites)
    return out.select("row.doc_id", "n_lines", "n_removed", "n_chars_removed", F.md5(F.col("clean").cast("binary")).alias("clean_md5"))


def cleaned(docs: DataFrame, sites: int = SITES, text: str = "text") -> DataFrame:
    """docs with boilerplate lines gone from their texts; all columns stay, n_chars follows where there is one."""
    out = removed(docs, sites, text=text)
    change = {text: F.col("clean")}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col("n_removed") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(change.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
