"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of the vectors serves as pivots, as many as the root of the number of vectors asks for, so that
pairs that meet stay far below all pairs. Each vector is described by its nearest pivots
in order; it enters the inverted list of every pair of its nearest ones, so two vectors
that meet in a list share at least two pivots: a candidate's shared-pivot count is two or more. The more pivots, the longer the
part of the permutation that is read (`nearest_of`), which keeps recall. Lists are cut into blocks and each pair of blocks is
one unit of work: the dot products of a block pair are one matrix product, and pairs at or above
the cosine are links. A pair that shares several lists is counted in the first of them alone, so
links add up without being listed, and each block pair hands on a spanning forest, not its pairs.

Equal vectors are one class before any of that, with a number of members; so thousands of copies are a
single row of the index. Within a list a hot group is split over `BLOCK`-sized blocks.

Defined results: a vector that is null, empty or all 0, or that has null or non-finite components, or whose
length differs from most vectors', links with nothing: 0 links, its own component. A null
vec_id links with nothing and has a null component. Repeated rows count as vectors of their own.
kept is vec_id = component_id, so null without a vec_id.
Cosines are computed in double precision on the given components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import spanning
from .columns import cut, discard
from .components import components
from .worker import tidy

COSINE = 0.9
#: Candidates for pivots are the distinct vectors of the smallest hashes, of so many components together at most: the only sample there is.
SAMPLE = 2048
SAMPLE_VALUES = 1 << 23
#: Of those, in order, the first so many that are not too near an earlier pivot: pivots within one
#: group of near copies would order its members by chance. Up to PIVOTS_FROM vectors there are PIVOTS, for four times
#: as many vectors twice as many, and MOST_PIVOTS at most.
PIVOTS, PIVOTS_FROM, MOST_PIVOTS = 192, 50_000, 4096
APART = 0.7
#: Nearest pivots that are read of PIVOTS; with each doubling of the pivots one more.
NEAREST = 6
BLOCK = 1024


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node; node null if unusable) and classes (node, first, members, v) of equal vectors."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, plain).alias("v"))
    size = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("s")).agg(F.count("*").alias("k")).agg(F.max(F.struct("k", "s")).alias("m")).first()
    length = size.m.s if size.m is not None else 0
    rows = rows.select("vec_id", F.when(F.size("v") == length, F.col("v")).alias("v"))
    rows = cut(rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.size("v"))).alias("node"), "v"))
    found = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("members"), F.first("v").alias("v"))
    return rows.select("vec_id", "node"), cut(found)


def unit(v: np.ndarray) -> np.ndarray:
    # scaled first, so neither huge nor tiny components leave the range of doubles
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pivots_for(vectors: int) -> int:
    return min(MOST_PIVOTS, max(PIVOTS, round(PIVOTS * (vectors / PIVOTS_FROM) ** 0.5)))


def nearest_of(pivots: int) -> int:
    return NEAREST + max(0, round(np.log2(pivots / PIVOTS)))


def matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), dtype=np.float64).reshape(n, -1)


def apart(candidates: np.ndarray, pivots: int) -> np.ndarray:
    chosen = np.zeros((0, candidates.shape[1]))
    for v in candidates:
        if len(chosen) < pivots and (not len(chosen) or (chosen @ v).max() < APART):
            chosen = np.r_[chosen, v[None]]
    return chosen


def listed(found: DataFrame, pivots: np.ndarray, nearest: int, kind: str) -> DataFrame:
    """list, node, members, keys (all lists of the node, in order), v (its components as given, of the kind `kind`): an index entry for each list."""
    n_pivots = len(pivots)
    near = min(nearest, n_pivots)
    i, j = np.triu_indices(near, 1) if near > 1 else (np.zeros(1, int), np.zeros(1, int))

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            given = matrix(batch.column("v"), n)
            u = unit(given)
            given = given.astype(kind)
            top = np.argsort(-(u @ pivots.T), axis=1, kind="stable")[:, :near]
            low, high = np.minimum(top[:, i], top[:, j]), np.maximum(top[:, i], top[:, j])
            keys = np.sort(low * n_pivots + high, axis=1).astype(np.int32)
            for a in range(0, n, 2048):
                part = keys[a : a + 2048]
                row = np.repeat(np.arange(len(part)), part.shape[1])
                own = pa.array([k.tobytes() for k in part], pa.binary())
                vec = pa.array([x.tobytes() for x in given[a : a + 2048]], pa.binary())
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ravel()), *(batch.column(c).slice(a, len(part)).take(at) for c in ("node", "members")), own.take(at), vec.take(at)],
                    names=["list", "node", "members", "keys", "v"],
                )

    return found.select("node", "members", "v").mapInArrow(tidy(describe), "list int, node long, members long, keys binary, v binary")


def met(entries: DataFrame, cosine: float, block: int, kind: str) -> DataFrame:
    """Of all block pairs of all lists: node with the links found there (other null), and links node - other."""
    salted = entries.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)).cast("long"))
    sizes = entries.groupBy("list").agg(F.count("*").alias("k")).where("k > 1").select("list", F.ceil(F.col("k") / F.lit(block)).cast("long").alias("blocks"))
    placed = salted.join(sizes, "list").withColumn("part", F.col("part") % F.col("blocks"))
    # block p meets the blocks from p on: as the first of them, and as the second of those before
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q")))
    dealt = placed.select("list", F.explode(pairs).alias("at"), "part", "node", "members", "keys", "v").select("list", "at.p", "at.q", "part", "node", "members", "keys", "v")

    def multiply(key, got):
        import pyarrow as pa

        own, p, q = (k.as_py() for k in key)
        n = got.num_rows
        part = np.asarray(got.column("part"))
        v = unit(np.frombuffer(b"".join(got.column("v").to_pylist()), dtype=kind).reshape(n, -1).astype(np.float64))
        keys = np.frombuffer(b"".join(got.column("keys").to_pylist()), dtype=np.int32).reshape(n, -1)
        x, y = np.flatnonzero(part == p), np.flatnonzero(part == q)
        hit = v[x] @ v[y].T >= cosine
        i, j = np.nonzero(np.triu(hit, 1) if p == q else hit)
        i, j = x[i], y[j]
        first = np.empty(len(i), dtype=bool)
        for a in range(0, len(i), 100_000):
            ki, kj = keys[i[a : a + 100_000]], keys[j[a : a + 100_000]]
            shared = (ki[:, :, None] == kj[:, None, :]).any(axis=2)
            first[a : a + 100_000] = ki[np.arange(len(ki)), shared.argmax(axis=1)] == own
        i, j = i[first], j[first]
        node, members = np.asarray(got.column("node")), np.asarray(got.column("members"))
        links = np.bincount(i, weights=members[j], minlength=n) + np.bincount(j, weights=members[i], minlength=n)
        some = np.flatnonzero(links)
        tree = spanning(n, i, j)
        return pa.table(
            [
                pa.array(np.r_[node[some], node[i[tree]]], pa.int64()),
                pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[j[tree]], pa.int64())]),
                pa.array(np.r_[links[some], np.zeros(len(tree))].astype(np.int64)),
            ],
            names=["node", "other", "links"],
        )

    return dealt.groupBy("list", "p", "q").applyInArrow(multiply, "node long, other long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, pivots: int | None = None, nearest: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    rows, found = classes(vectors)
    pivots = pivots or pivots_for(found.count())
    nearest = nearest or nearest_of(pivots)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    length = found.select(F.size("v")).first()
    sample = max(SAMPLE, 4 * pivots) if length is None else min(max(SAMPLE, 4 * pivots), max(SAMPLE, SAMPLE_VALUES // max(1, length[0])))
    chosen = found.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(sample).select("v").collect()
    if chosen:
        entries = cut(listed(found, apart(unit(np.array([r.v for r in chosen])), pivots), nearest, kind))
        links = cut(met(entries, cosine, block, kind))
        discard(entries)
        component = components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
        counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    else:
        component = rows.select("node", F.col("node").alias("component")).limit(0)
        counts = rows.select("node", F.col("node").alias("links")).limit(0)
    known = found.select("node", "first", "members").join(component, "node", "left").join(counts, "node", "left")
    known = known.select("node", "first", F.coalesce("component", "node").alias("component"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = known.join(least, "component").select("node", "n_links", "component_id")
    out = rows.join(by_node, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
