"""Near-duplicate documents by a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are classes of documents with one and the same shingle set, columns are
shingles. A pair can only reach the similarity if it shares one of the shingles that come first
in both sets under a global order (rare ones first), so the product runs over those prefixes
alone: blocks of columns are dealt to tasks, each sums its pairs' overlaps, sums are added up, and
pairs below the bound that their sizes set are dropped before whole sets are compared.

A column of m classes would give m * m / 2 pairs. Instead
1. every class meets only the first class of its columns; the best such pair of each class is
   verified and verified pairs are contracted to components;
2. the product then runs over pairs of different components, in numpy. Columns of up to `HOT` rows are multiplied in
   blocks of columns, and overlaps are accumulated. Hotter columns go through it in blocks of rows: sets carry
   histograms of their shingles, whose sum of minima is at least the overlap, so nearly all pairs
   end right there, and what is left of a block hands on its maximal spanning forest;
3. verified pairs are contracted and step 2 is done again on hot columns, the last time with every
   pair that the histograms leave.
A column within one component costs nothing, and every linked pair is within a component or
verified: it shares a hot column, or the product counts all columns that it shares. Components are exact.

The order needs no exact frequencies, only one function for all: shingles go to `BUCKETS` counters over all
documents. A task hands on those that are `OFTEN` times as full as its others, and these are summed up by
aggregation; there are no more than `BUCKETS` sums, so they can be collected and broadcast.

Defined results: null, empty and blank texts have no shingles, link with nothing, and are their own
component. A row with a null doc_id has its n_shingles and component null, and links nothing.
Repeated rows each come out. Columns other than doc_id and text are ignored.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import pairs_within, spanning, whole_units
from .columns import cut, discard
from .components import components
from .shingles import WORDS, shingle_hashes, text_buffers
from .worker import tidy

#: Percent of the union that the intersection must reach.
SIMILARITY = 80
BUCKETS = 1 << 20
OFTEN = 4
#: doc_ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of a set's histogram; rows of a column that are multiplied with as many others at a time.
WIDTH = 512
#: Documents or pairs of sets that a Python worker holds at a time.
ROWS = 2000
BLOCK = 1024
#: Rows up to which a column is multiplied whole.
HOT = 64


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares at least with any set it links with."""
    return -(-percent * n // 100)


def node_of(unique: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(unique.tobytes(), digest_size=8).digest(), "little", signed=True)


def histogram(unique: np.ndarray) -> bytes | None:
    """How many shingles fall to each of WIDTH values; null where a byte can't hold one."""
    h = np.bincount((unique & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
    return h.astype(np.uint8).tobytes() if h.max() < 256 else None


def sets_of(column, words: int):
    """For each text: its row and its sorted distinct shingle hashes."""
    for a, _, data, offsets in text_buffers(column):
        hashes, at, _ = shingle_hashes(data, offsets, words)
        for k in range(len(offsets) - 1):
            yield a + k, np.unique(hashes[at[k] : at[k + 1]])


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, node, hist of each row (node and hist null without shingles), and rows with a bucket and how often it was seen."""

    def describe(batches):
        import pyarrow as pa

        counters = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            n, node, hist = [], [], []
            for _, s in sets_of(batch.column("text"), words):
                n.append(len(s))
                hist.append(histogram(s) if len(s) else None)
                node.append(node_of(s) if len(s) else None)
                np.add.at(counters, (s >> np.uint64(44)).astype(np.int64), 1)
            size = len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(hist, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64())], names=names)
        often = np.flatnonzero(counters >= OFTEN * (1 + counters.mean()))
        size = len(often)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(size, pa.int64()) for _ in range(3)), pa.nulls(size, pa.binary()), pa.array(often, pa.int32()), pa.array(counters[often])], names=names)

    names = ["doc_id", "n", "node", "hist", "bucket", "seen"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(describe), "doc_id long, n long, node long, hist binary, bucket int, seen long")


def frequencies(told: DataFrame) -> np.ndarray:
    """What the tasks have counted, added up, by bucket."""
    found = cut(told.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("seen").alias("seen"))).toArrow()
    out = np.zeros(BUCKETS, dtype=np.uint32)
    out[found["bucket"].to_numpy()] = np.minimum(found["seen"].to_numpy(), 2**32 - 1)
    return out


def prefixes(docs: DataFrame, counters, words: int, percent: int) -> DataFrame:
    """shingle, node, n: the incidence, of each set only the shingles that come first."""

    def first(batches):
        import pyarrow as pa

        count = np.frombuffer(counters.value, dtype=np.uint32)
        for batch in batches:
            shingle, node, size = [], [], []
            seen = set()
            for _, s in sets_of(batch.column("text"), words):
                if not len(s) or (own := node_of(s)) in seen:
                    continue
                seen.add(own)
                p = len(s) - int(least_overlap(len(s), percent)) + 1
                shingle.append(s[np.argsort(count[(s >> np.uint64(44)).astype(np.int64)], kind="stable")[:p]].view(np.int64))
                node.append(np.full(p, own, dtype=np.int64))
                size.append(np.full(p, len(s), dtype=np.int64))
            if shingle:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shingle, node, size)], names=["shingle", "node", "n"])

    return docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(tidy(first), "shingle long, node long, n long")


def may_link(c: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of these sizes with c common shingles in their prefixes can still link."""
    rest = lambda n: F.ceil(n * percent / F.lit(100)) - 1
    sizes = F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)
    return sizes & (F.lit(100 + percent) * (c + F.greatest(rest(na), rest(nb))) >= F.lit(percent) * (na + nb))


def verified(pairs: DataFrame, docs: DataFrame, first_doc: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(nodes.join(first_doc, "node").select("node", F.col("first").alias("doc_id")))
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids

    def whole(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(node_of(s), s.tobytes()) for _, s in sets_of(batch.column("text"), words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "set"])

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column(k)] for k in ("set_a", "set_b"))
            both = np.array([common(p, q) for p, q in zip(x, y, strict=True)], dtype=np.int64)
            total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * both >= percent * total))

    sets = cut(docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").select("text").mapInArrow(tidy(whole), "node long, set binary"), ROWS)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    links = cut(both.mapInArrow(tidy(compare), "a long, b long"), ROWS)
    discard(sets)
    discard(wanted)
    return links


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def linked(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    told = cut(described(docs, words), ROWS)
    base = told.where("bucket IS NULL")
    classes = base.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("hist").alias("hist"))
    component = node_components(spark, docs, told, classes, words, percent)
    smallest = classes.join(component, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    roots = smallest.groupBy("component").agg(F.min("first").alias("component_id"))
    # only where the answer is not the row's own id
    by_node = smallest.join(roots, "component").select("node", "component_id")
    found = base.join(by_node, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def node_components(spark: SparkSession, docs: DataFrame, told: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component of the classes that link with another one."""
    counters = spark.sparkContext.broadcast(frequencies(told).tobytes())
    # shingles of more than one class; dealt by shingle once for all that follows here
    dealt = prefixes(docs, counters, words, percent).repartition(F.col("shingle")).distinct()
    column = Window.partitionBy("shingle")
    shared = cut(dealt.select("shingle", "node", "n", F.min("node").over(column).alias("lo"), F.max("node").over(column).alias("hi")).where("lo <> hi").drop("hi"), ROWS)
    counters.destroy()

    sizes = shared.select(F.col("node").alias("lo"), F.col("n").alias("n_lo")).distinct()
    stars = shared.where("node <> lo").groupBy("node", "n", "lo").agg(F.count("*").alias("c")).join(sizes, "lo")
    best = stars.where(may_link(F.col("c"), F.col("n"), F.col("n_lo"), percent)).groupBy("node").agg(F.max(F.struct("c", "lo")).alias("m"))
    one = verified(cut(best.select(F.col("node").alias("a"), F.col("m.lo").alias("b"))), docs, classes, words, percent)

    rows = mixed(shared.select("shingle", "node", "n"), components(one))
    discard(shared)
    pairs = cut(multiplied(rows.where(F.col("k") <= HOT), percent))
    hot = cut(rows.where(F.col("k") > HOT))
    discard(rows)
    edges = one.unionByName(verified(pairs, docs, classes, words, percent))
    for forest in (True, False):
        if hot.isEmpty():
            break
        more = cut(survivors(hot, classes, percent, forest).join(pairs, ["a", "b"], "left_anti"), ROWS)
        edges = edges.unionByName(verified(more, docs, classes, words, percent))
        pairs = pairs.unionByName(more)
        hot = mixed(hot.select("shingle", "node", "n"), components(edges)) if forest else hot
    return components(edges)


def mixed(rows: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of columns in which several components meet, with the component as label, and k, the column's rows."""
    column = Window.partitionBy("shingle")
    labelled = rows.join(component, "node", "left").select("shingle", "node", "n", F.coalesce("component", "node").alias("label"))
    return cut(labelled.withColumns({"lo": F.min("label").over(column), "hi": F.max("label").over(column), "k": F.count("*").over(column)}).where("lo <> hi").drop("lo", "hi"))


def multiplied(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different labels that their sizes and the number of shared columns let link.

    Blocks of whole columns are multiplied with themselves, and the pairs' overlaps in a block are summed up
    there before they are added to those of other blocks.
    """
    columns = rows.select("shingle", "node", "n", "label").repartition(F.col("shingle")).sortWithinPartitions("shingle")

    def multiply(batches):
        import pyarrow as pa

        kinds = ("a", "b", "less", "more", "c")
        for held, bounds in whole_units(batches, ("shingle", "node", "n", "label"), ("shingle",)):
            nodes, place = np.unique(held["node"], return_inverse=True)
            size = np.zeros(len(nodes), np.int64)
            size[place] = held["n"]
            for i, j in pairs_within(bounds):
                ni, nj = held["n"][i], held["n"][j]
                fine = (held["label"][i] != held["label"][j]) & (100 * np.minimum(ni, nj) >= percent * np.maximum(ni, nj))
                x, y = place[i[fine]], place[j[fine]]
                pair, c = np.unique(np.minimum(x, y) * len(nodes) + np.maximum(x, y), return_counts=True)
                x, y = pair // len(nodes), pair % len(nodes)
                if len(pair):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (nodes[x], nodes[y], np.minimum(size[x], size[y]), np.maximum(size[x], size[y]), c)], names=list(kinds))

    partial = columns.mapInArrow(tidy(multiply), "a long, b long, less long, more long, c long")
    pairs = partial.groupBy("a", "b", "less", "more").agg(F.sum("c").alias("c"))
    return pairs.where(may_link(F.col("c"), F.col("more"), F.col("less"), percent)).select("a", "b")


def survivors(rows: DataFrame, classes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """a, b: pairs of a column and of different labels that sizes and histograms let link.

    Columns are cut into blocks of rows and each pair of blocks is one unit of work, so a hot column is
    spread over tasks. With forest, a unit gives fewer pairs than rows.
    """
    sizes = rows.groupBy("shingle").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    placed = rows.join(sizes, "shingle").select("shingle", "node", "n", "label", "blocks", part.alias("part"))
    columns = rows.groupBy("node").agg(F.sort_array(F.collect_set("shingle")).alias("columns"))
    with_hist = placed.join(columns, "node").join(classes.select("node", "hist"), "node")
    at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q")))
    dealt = with_hist.select("shingle", "node", "n", "label", "part", "columns", "hist", F.explode(at).alias("at")).select("shingle", "at.p", "at.q", "part", "node", "n", "label", "columns", "hist")
    ordered = dealt.repartition(F.col("shingle"), F.col("p"), F.col("q")).sortWithinPartitions("shingle", "p", "q")

    def multiply(batches):
        import pyarrow as pa

        for unit in units(batches):
            a, b = block_product(unit, percent, forest)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return ordered.mapInArrow(tidy(multiply), "a long, b long").distinct()


def units(batches):
    """The runs of rows with one (shingle, p, q), whole also where they lie across batches."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = np.stack([np.asarray(held.column(c)).astype(np.int64) for c in ("shingle", "p", "q")])
        ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        whole = held.slice(0, ends[-1]) if len(ends) else None
        if whole is not None:
            yield from cut_up(whole, ends)
            held = held.slice(ends[-1])
    if held is not None and held.num_rows:
        yield from cut_up(held, np.array([held.num_rows]))


def cut_up(table, ends: np.ndarray):
    shingle, node, n, label, part = (np.asarray(table.column(c)) for c in ("shingle", "node", "n", "label", "part"))
    hist = table.column("hist").to_pylist()
    columns = table.column("columns").combine_chunks()
    at, every = np.asarray(columns.offsets), np.asarray(columns.values)
    start = 0
    for end in ends:
        if end - start > 1:
            rows = slice(start, end)
            # of each row's columns those before this one, as (row in the unit, column)
            some = every[at[start] : at[end]]
            owner = np.repeat(np.arange(end - start), np.diff(at[start : end + 1]))
            earlier = some < shingle[start]
            yield node[rows], n[rows], label[rows], part[rows], hist[rows], (owner[earlier], some[earlier])
        start = end


def incidence(n: int, owner: np.ndarray, columns: np.ndarray) -> np.ndarray:
    values, place = np.unique(columns, return_inverse=True)
    out = np.zeros((n, max(1, len(values))), dtype=np.float32)
    out[owner, place] = 1
    return out


def block_product(unit, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's rows that can link. A pair is left to the first column that both rows have."""
    node, n, label, part, hist, before = unit
    met = incidence(len(node), *before)
    values, group, counts = np.unique(label, return_inverse=True, return_counts=True)
    outside = group != counts.argmax()
    unknown = np.array([h is None for h in hist])
    h = np.frombuffer(b"".join(x if x is not None else b"\xff" * WIDTH for x in hist), dtype=np.uint8).reshape(-1, WIDTH)
    two_parts = part.min() != part.max()
    place = np.arange(len(node))
    out = []
    rows = np.flatnonzero(outside)
    for k in range(0, len(rows), 64):
        x = rows[k : k + 64]
        ok = group[x][:, None] != group[None, :]
        ok &= 100 * np.minimum(n[x][:, None], n[None, :]) >= percent * np.maximum(n[x][:, None], n[None, :])
        ok &= ~outside[None, :] | (x[:, None] < place[None, :])
        if two_parts:
            ok &= part[x][:, None] != part[None, :]
        ok &= met[x] @ met.T == 0
        i, j = np.nonzero(ok)
        for m in range(0, len(i), 20_000):
            p, q = x[i[m : m + 20_000]], j[m : m + 20_000]
            both = np.minimum(h[p], h[q]).sum(axis=1, dtype=np.int64)
            both[unknown[p] | unknown[q]] = 1 << 40
            fine = (100 + percent) * both >= percent * (n[p] + n[q])
            out.append((p[fine], q[fine], both[fine] / (n[p] + n[q])[fine]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q, bound = (np.concatenate(c) for c in zip(*out, strict=True))
    if forest:
        order = np.lexsort((np.maximum(node[p], node[q]), np.minimum(node[p], node[q]), -bound))
        tree = spanning(len(values), group[p[order]], group[q[order]])
        p, q = p[order[tree]], q[order[tree]]
    return node[p], node[q]
