"""Mixing sources to target weights by a temperature.

Weights are token shares raised to an exponent between 1 (in proportion) and 0 (all sources
alike), normalised. The exponent is bisected, each time five halvings in one aggregation over the sources, to the
evenest mix that neither exceeds the target entropy nor repeats a source more often than the limit.

A source's quota of the budget is realised as whole passes over its documents and one part of a
pass. Documents lie in blocks of bounded size by a hash; each pass permutes a source's blocks and the documents of
a block. The part of a pass takes blocks in their order while the quota lasts, and documents of the
block in which it ends. Of equal rows beyond a few, each gets its block by its place in the table, so many copies fill many blocks.
The order of a source's blocks is cut into stretches of at most about `STRETCH` blocks, which are ranked each on its own. So no
window is larger than a block, a stretch or a list of stretches, and a source with a third of all documents is spread like any other.

Native operations only. Tokens are words and one for the end of a document.

Defined results: a null source is a source of its own; null and empty texts have one token; null
doc_ids and repeated rows are mixed like others. An empty table gives no rows. A very long text is one document, taken whole or not.
The table is read more than once and must have its rows in the same places each time, as files have.
Columns of the input may have any names: scratch columns live beside a struct of the row.
"""

from __future__ import annotations

from math import inf, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import cut, words

#: Share of the largest possible entropy (all sources alike) that is the target.
ENTROPY = 0.95
#: How often a source may be passed over, with a budget that takes the least repeated source once.
REPEATS = 2.0
BLOCK_DOCS = 2048
STRETCH = 65_536
HALVINGS = 5
ROUNDS = 6
SEED = 17


def sources(rows: DataFrame) -> DataFrame:
    """src, tokens, docs."""
    return rows.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def exponent(by_source: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The smallest exponent in [0, 1] that keeps both limits; 1 if none does."""
    total, n, least, most = by_source.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n or n == 1:
        return 1.0
    share = F.col("tokens") / F.lit(total)
    low, high = 0.0, 1.0  # high is fine, low may not be

    def fine(t: float, s0: float, s1: float) -> bool:
        h = log(s0) - t * s1 / s0
        spread = (least / most) ** (t - 1)
        return h <= entropy * log(n) + 1e-12 and spread <= repeats + 1e-12

    for _ in range(ROUNDS):
        points = [low + (high - low) * k / 2**HALVINGS for k in range(2**HALVINGS)]
        sums = by_source.agg(*(f(F.pow(share, F.lit(t)) * w).alias(f"{a}{k}") for k, t in enumerate(points) for a, w, f in (("a", F.lit(1.0), F.sum), ("b", F.log(share), F.sum)))).first()
        a, b = 0, 2**HALVINGS  # a bisection among the points; both limits hold the better the larger the exponent
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if fine(points[mid], sums[f"a{mid}"], sums[f"b{mid}"]) else (mid, b)
        if a == 0 and fine(points[0], sums["a0"], sums["b0"]):
            return points[0]
        low, high = points[a], points[b] if b < len(points) else high
    return high


def weights(by_source: DataFrame, power: float, budget: int | None) -> DataFrame:
    """src, tokens, docs, weight, quota (tokens), full (whole passes), rest (tokens of the last pass).

    Without a budget, the least repeated source is taken once and the others follow.
    """
    tokens = F.col("tokens").cast("double")
    raised = F.pow(tokens, F.lit(power))
    total, most = by_source.agg(F.sum(raised), F.max(F.pow(tokens, F.lit(1 - power)))).first()
    quota = F.col("weight") * F.lit(float(budget)) if budget is not None else raised * F.lit(most or 0.0)
    out = by_source.withColumn("weight", raised / F.lit(total or 1.0)).withColumn("quota", F.round(quota).cast("long"))
    out = out.withColumn("full", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
    return out.withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens"))


def chance(*columns: Column | str) -> Column:
    return F.xxhash64(*columns, F.lit(SEED))


#: Rows of a table of sources or blocks (under 100 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def planned(docs: DataFrame, keep: list[str], entropy: float, repeats: float, budget: int | None, block_docs: int, site: str, text: str) -> DataFrame:
    """A row for each document and pass that visits its block: row (struct of `keep`), src, tokens, id, block, pass, block_rank, left.

    left is null where the pass takes the whole block, else the tokens that it has left for the block.
    """
    src = F.coalesce(F.col(site).cast("string"), F.lit(""))
    tokens = (F.size(words(F.col(text))) + 1).cast("long")
    rows = docs.select(F.struct(*keep).alias("row"), src.alias("src"), tokens.alias("tokens"), F.xxhash64("doc_id", text).alias("id"), F.monotonically_increasing_id().alias("place"))
    often = cut(rows.groupBy("id").agg(F.count("*").alias("copies")).where(F.col("copies") > max(1, block_docs // 16)).select("id", F.lit(True).alias("often")))
    rows = rows.join(small(often), "id", "left").withColumn("of", F.when(F.col("often"), F.xxhash64("id", "place")).otherwise(F.col("id"))).drop("often", "place")
    by_source = cut(sources(rows.select("src", "tokens")))
    plan = cut(weights(by_source, exponent(by_source, entropy, repeats), budget).withColumn("blocks", F.ceil(F.col("docs") / F.lit(block_docs)).cast("int")))
    placed = rows.join(small(plan.select("src", "blocks")), "src").withColumn("block", F.pmod(F.xxhash64("of", F.lit(SEED)), F.col("blocks"))).drop("blocks")

    # blocks of each pass in their order; `ahead` is what lies before a block in its pass
    sums = placed.groupBy("src", "block").agg(F.sum("tokens").alias("block_tokens")).join(small(plan.select("src", "full", "rest", "blocks")), "src")
    last_pass = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    passes = sums.where(last_pass >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last_pass)))
    # a stretch holds the blocks whose chance lies in one part of its range
    part = (chance("block", "pass").cast("double") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("blocks") / F.lit(STRETCH))
    passes = passes.withColumn("stretch", F.floor(part).cast("int"))
    in_order = Window.partitionBy("src", "pass").orderBy("stretch")
    stretches = passes.groupBy("src", "pass", "stretch").agg(F.sum("block_tokens").alias("t"), F.count("*").alias("c"))
    stretches = stretches.select("src", "pass", "stretch", (F.sum("t").over(in_order) - F.col("t")).alias("tokens_before"), (F.sum("c").over(in_order) - F.col("c")).alias("blocks_before"))
    order = Window.partitionBy("src", "pass", "stretch").orderBy(chance("block", "pass"), "block")
    ranked = passes.withColumn("rank", F.row_number().over(order)).withColumn("upto", F.sum("block_tokens").over(order))
    ranked = ranked.join(small(cut(stretches)), ["src", "pass", "stretch"])
    ranked = ranked.withColumn("block_rank", F.col("rank") + F.col("blocks_before")).withColumn("ahead", F.col("upto") + F.col("tokens_before") - F.col("block_tokens"))
    left = F.when(F.col("pass") == F.col("full"), F.col("rest") - F.col("ahead"))
    ranked = ranked.withColumn("left", left).where(F.col("left").isNull() | (F.col("left") > 0))
    ranked = ranked.select("src", "block", "pass", "block_rank", F.when(F.col("left") < F.col("block_tokens"), F.col("left")).alias("left"))
    by_block = cut(ranked.groupBy("src", "block").agg(F.collect_list(F.struct("pass", "block_rank", "left")).alias("visits")))
    visited = placed.join(small(by_block), ["src", "block"]).withColumn("v", F.explode("visits"))
    return visited.select("row", "src", "tokens", "id", "block", "v.pass", "v.block_rank", "v.left")


def taken(visits: DataFrame) -> DataFrame:
    """Visits with a document's place in its block and pass, without those beyond the end of a quota."""
    within = Window.partitionBy("src", "block", "pass").orderBy(chance("id", "pass"), "id")
    placed = visits.withColumns({"place": F.row_number().over(within), "upto": F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.where(F.col("left").isNull() | (F.col("upto") <= F.col("left"))).drop("upto")


def drawn(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_docs: int = BLOCK_DOCS, site: str = "source", text: str = "text") -> DataFrame:
    """The result of op7: doc_id, source, pass, block_rank, place, n_tokens for each time a document is taken.

    The order of a source is that of pass, block_rank and place.
    """
    out = taken(planned(docs, ["doc_id", site], entropy, repeats, budget, block_docs, site, text))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row")[site].alias(site), F.col("pass").cast("int"), F.col("block_rank").cast("int"), F.col("place").cast("int"), F.col("tokens").alias("n_tokens"))


def remixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_docs: int = BLOCK_DOCS, site: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Only the documents of the blocks in which quotas end need their order; no other text is moved.
    """
    visits = planned(docs, docs.columns, entropy, repeats, budget, block_docs, site, text)
    whole = visits.where(F.col("left").isNull()).select("row")
    part = taken(visits.where(F.col("left").isNotNull())).select("row")
    return whole.unionByName(part).select(*(F.col("row")[c].alias(c) for c in docs.columns))
