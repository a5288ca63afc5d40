"""Near-duplicate passages of long texts by compact windows.

Tokens are 5-word shingles. Under one hash, the Cartesian tree of a text's token hashes says for every
token which subsequences have it as their minimum: those that begin in [low, at] and end in [at, high). One such
compact window stands for up to thousands of subsequences with one signature, and only windows wide
enough for a passage are kept, about two for each passage length of text. Trees of a whole batch are split level by
level with numpy.

Two texts are candidates if they share a minimum under one of the hashes, if their windows, laid upon each other at the minimum,
have a passage's length in common (the join of intervals), and if they agree word for word for `RUN` tokens around it. The
last is known from the windows alone: each carries small hashes of what stands before and after its minimum,
up to each of `LEVELS`. A passage of the least similarity has one changed word in 50, so one of its two runs is longer than that.
Candidates are verified on the texts' shingles: a passage is a stretch of shared shingles, as long as a passage must
be, whose two sides have the similarity as sets. Equal texts are one class before any of that.

A group of m texts would give m * m / 2 pairs. Instead
1. texts with one minimum and one context (`STARS`: 20 tokens after it, before it, or 8 on both sides) meet the first of them.
   Verified passages link texts to components, and a place in or beside (nearer than a passage's length) a known passage has its component as label;
2. where texts of several components agree on 8 tokens after the minimum or before it, blocks of them are multiplied in numpy.
   The candidates whose tokens around the minimum are alike are verified: all of them in groups of up to `LARGE` texts, in larger ones a
   spanning forest, longest runs first, which is contracted;
3. larger groups are multiplied once more, and all such candidates that are still of different components are verified.
So two texts of a candidate pair are verified, or both are in one component and have a row at the place or beside it: links between
components are never left out, but within one a row may end short of the longest passage. Minima that many
texts have never lie in one task: they need no window (a task that sees one `HOT` times says so), stars
are aggregations, and blocks are dealt to tasks.

Defined results: null, empty and short texts have no passage. Rows with null doc_id are left out. Repeated
rows of one doc_id are one document. Texts without a repeated passage have no row. Columns other than
doc_id and text are ignored. Tokens are compared by 64-bit hashes of their words, A-Z as a-z; verification by 32 bits of those.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pairs_within, spanning, whole_units
from .columns import cut, discard
from .components import components
from .shingles import WORDS, mix, shingle_hashes, text_buffers
from .worker import tidy

PASSAGE = 50
SIMILARITY = 80
HASHES = 4
#: How far a passage's places may drift between the two texts.
DRIFT = 16
#: Documents or pairs of sequences that a Python worker holds at a time.
ROWS = 2000
#: doc_ids or minima up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Tokens after a minimum, itself included, and before it, of which a window carries hashes of four bits.
LEVELS = np.array([4, 8, 12, 16, 20, 24, 32, 46])
#: Tokens that candidates share word for word around their minimum, by LEVELS.
RUN = 16
#: Times that a task sees a minimum before it counts as one that many texts have.
HOT = 64
#: Pairs of equal shingles for each shingle of two texts up to which all of them are held; beyond it each shift looks for its own.
MATCHES = 16
#: Shifts that are looked at for each token around a minimum, and pairs that this is done for at a time.
SHIFTS, ALIKE = 2, 20_000
#: Texts of a group up to which all its candidates are verified at once.
LARGE = 16
#: Rows of a group that are multiplied with as many others in one unit of work.
BLOCK = 1024
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SALTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def smallest_within(values: np.ndarray, least: int) -> np.ndarray:
    """Places of the tokens that are the minimum (or equal to it) of some `least` tokens in a row, in order."""
    if len(values) < least:
        return np.zeros(0, np.int64)

    def spread(x: np.ndarray, better) -> np.ndarray:
        """The best of each `least` in a row."""
        width = 1
        while 2 * width <= least:
            x = better(x[:-width], x[width:])
            width *= 2
        return better(x[: len(x) - least + width], x[least - width :]) if width < least else x

    lowest = np.zeros(len(values) + least - 1, dtype=values.dtype)  # nothing is below 0, so what lies beyond the ends adds no place but those of 0
    lowest[least - 1 : len(values)] = spread(values, np.minimum)
    return np.flatnonzero(spread(lowest, np.maximum) == values)


def compact_windows(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """low, at, high (exclusive) of every compact window of `least` tokens or more.

    begins and ends cut values into texts. A segment's minimum (of equal ones, the middle one) gives its window and splits it.
    Only tokens that are smallest among `least` in a row split a segment as wide as that, so only those are looked at.
    """
    lows, ats, highs = [], [], []
    low, high = begins, ends
    places = smallest_within(values, least)
    padded = np.append(values[places], values[:1])
    wide = high - low >= least
    low, high = low[wide], high[wide]
    begin, end = np.searchsorted(places, low), np.searchsorted(places, high)  # of segments, among places
    while len(low):
        size = end - begin
        best = np.minimum.reduceat(padded, np.stack([begin, end], axis=1).ravel())[::2]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(begin - first, size)
        hit = np.flatnonzero(padded[place] == np.repeat(best, size))
        segment = np.searchsorted(first, hit, side="right") - 1
        split = place[hit]
        at = places[split]
        if len(at) > len(low):  # of equal minima the middle one, so that runs of equals split evenly
            order = np.lexsort((np.abs(2 * at - (low + high)[segment]), segment))
            at, split, segment = at[order], split[order], segment[order]
            once = np.append(True, segment[1:] != segment[:-1])
            at, split = at[once], split[once]
        lows.append(low)
        ats.append(at)
        highs.append(high)
        low, high = np.stack([low, at + 1], axis=1).ravel(), np.stack([at, high], axis=1).ravel()
        begin, end = np.stack([begin, split + 1], axis=1).ravel(), np.stack([split, end], axis=1).ravel()
        wide = high - low >= least
        low, high, begin, end = low[wide], high[wide], begin[wide], end[wide]
    if not lows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(lows), np.concatenate(ats), np.concatenate(highs)


def node_of(sequence: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(sequence.tobytes(), digest_size=8).digest(), "little", signed=True)


def sequences_of(column, least: int):
    """For each text with a passage's length: its row and its shingle hashes in order."""
    for a, _, data, offsets in text_buffers(column):
        hashes, at, _ = shingle_hashes(data, offsets)
        yield a, hashes, at, np.flatnonzero(np.diff(at) >= least)


def contexts(tokens: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each place at of the text node, which lies in [begin, end): hashes of the tokens after it in the lower half, of those before it in the upper half.

    Four bits for each of LEVELS, nearest first; beyond the text's ends they are the place's own.
    """
    sums = np.r_[np.uint64(0), np.cumsum(mix(tokens))]
    out = np.zeros(len(at), dtype=np.uint64)
    alone = mix(mix(node.view(np.uint64)) + (at - begin).astype(np.uint64))
    for k, n in enumerate(LEVELS):
        for side, first, last in ((0, at, at + n), (32, at - n, at)):
            inside = (first >= begin) & (last <= end)
            value = sums[np.where(inside, last, 0)] - sums[np.where(inside, first, 0)]
            bits = np.where(inside, (value * SPREAD) >> np.uint64(60), (alone >> np.uint64(4 * k)) & np.uint64(15))
            out |= bits << np.uint64(side + 4 * k)
    return out.view(np.int64)


def runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens, by LEVELS, the places with contexts x and y share around them."""
    differ = (x ^ y).view(np.uint64)
    length = np.r_[0, LEVELS]
    out = np.zeros(len(x), dtype=np.int64)
    for half in (differ & np.uint64(0xFFFFFFFF), differ >> np.uint64(32)):
        lowest = half & (~half + np.uint64(1))  # of a half without a difference 0
        level = np.where(half == 0, len(LEVELS), np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) // 4)
        out += length[level]
    return out


def described(docs: DataFrame, least: int, n_hashes: int) -> DataFrame:
    """Rows doc_id, node, n of long texts (node: its class of equal texts); compact windows key, node, at, left, right, context (left and right:
    how far the window reaches from its minimum); and, with key alone, minima that a task has seen often.
    """

    def cover(batches):
        import pyarrow as pa

        seen = []

        def rows(**columns):
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(size, k)) for n, k in kinds.items()], names=list(kinds))

        kinds = {"doc_id": pa.int64(), "node": pa.int64(), "n": pa.int64(), "key": pa.int64(), "at": pa.int32(), "left": pa.int32(), "right": pa.int32(), "context": pa.int64()}
        for batch in batches:
            for a, hashes, at, long_ in sequences_of(batch.column("text"), least):
                nodes = np.array([node_of(hashes[at[k] : at[k + 1]]) for k in long_], dtype=np.int64)
                yield rows(doc_id=batch.column("doc_id").take(pa.array(a + long_)), node=pa.array(nodes), n=pa.array((at[long_ + 1] - at[long_]).astype(np.int64)))
                _, once = np.unique(nodes, return_index=True)
                once = np.sort(once)
                begins, ends, nodes = at[long_[once]], at[long_[once] + 1], nodes[once]
                for k in range(n_hashes):
                    low, mid, high = compact_windows(mix(hashes ^ SALTS[k]), begins, ends, least)
                    own = np.searchsorted(begins, mid, side="right") - 1
                    key = mix(hashes[mid] + SALTS[k + 32]).view(np.int64)
                    seen.append(key)
                    small = {n: pa.array(x.astype(np.int32)) for n, x in (("at", mid - begins[own]), ("left", mid - low), ("right", high - mid))}
                    yield rows(key=pa.array(key), node=pa.array(nodes[own]), context=pa.array(contexts(hashes, mid, begins[own], ends[own], nodes[own])), **small)
        if seen:
            key, count = np.unique(np.concatenate(seen), return_counts=True)
            yield rows(key=pa.array(key[count >= HOT]))

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(tidy(cover), "doc_id long, node long, n long, key long, at int, left int, right int, context long")


def shared_windows(every: DataFrame) -> DataFrame:
    """The windows whose minimum several texts have."""
    found = every.where("key IS NOT NULL AND node IS NOT NULL").select("key", "node", "at", "left", "right", "context")
    hot = cut(every.where("key IS NOT NULL AND node IS NULL").select("key").distinct())
    keys = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    group = Window.partitionBy("key")
    cold = found.join(keys, "key", "left_anti").repartition(F.col("key"))
    cold = cold.withColumns({"lo": F.min("node").over(group), "hi": F.max("node").over(group)}).where("lo <> hi").drop("lo", "hi").distinct()
    shared = cut(cold.unionByName(found.join(keys, "key", "left_semi").distinct()), ROWS)
    discard(hot)
    return shared


def part(side: int, tokens: int) -> Column:
    """What a context says of so many tokens after the minimum (side 0) or before it (side 1)."""
    levels = int(np.searchsorted(LEVELS, tokens, side="right"))
    return F.shiftrightunsigned("context", 32 * side).bitwiseAND(F.lit((1 << (4 * levels)) - 1))


#: Contexts, as (side, tokens), that texts of one star share.
STARS = (((0, 20),), ((1, 20),), ((0, 8), (1, 8)))
#: Contexts of which candidates share one: RUN tokens have half of them on one side.
HALVES = (((0, RUN // 2),), ((1, RUN // 2),))


def dealt(rows: DataFrame, groups: tuple) -> DataFrame:
    """rows for each of groups, with sub: one value for one key and context."""
    subs = [F.xxhash64("key", F.lit(k), *(part(*p) for p in parts)) for k, parts in enumerate(groups)]
    return rows.withColumn("sub", F.explode(F.array(*subs))).drop("key")


def joinable(x: str, y: str, least: int) -> Column:
    """Whether two windows have a passage's length in common where their minima lie upon each other."""
    return F.least(f"{x}.left", f"{y}.left") + F.least(f"{x}.right", f"{y}.right") >= F.lit(least - DRIFT)


def by_pair(pairs: DataFrame) -> DataFrame:
    """a, b, starts (at of a in the upper half, of b in the lower half) of a, b, at, at_b."""
    return pairs.groupBy("a", "b").agg(F.collect_set(F.shiftleft(F.col("at").cast("long"), 32) + F.col("at_b")).alias("starts"))


def stars(shared: DataFrame, least: int) -> DataFrame:
    """a, b, starts: each text with the first of those that have its minimum and a context of it."""
    rows = dealt(shared, STARS).select("sub", F.struct("node", "at", "left", "right").alias("x"))
    first = rows.groupBy("sub").agg(F.min("x").alias("y"), F.max("x.node").alias("hi")).where("y.node <> hi").drop("hi")
    met = rows.join(first, "sub").where((F.col("x.node") != F.col("y.node")) & joinable("x", "y", least))
    return by_pair(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.at").alias("at"), F.col("y.at").alias("at_b")))


def grown(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components of the links that made component and of these."""
    return components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b")))


def places(links: DataFrame, component: DataFrame, least: int) -> DataFrame:
    """node, from, to, component: where a text's known passages are, with a passage's length on both sides, and the component that their links make."""
    ends = links.select(F.col("a").alias("node"), "begin", "end").union(links.select("b", "begin_b", "end_b")).distinct()
    spans = merged(ends.withColumns({"begin": F.col("begin") - least, "end": F.col("end") + least}))
    return cut(spans.join(component, "node").select("node", F.col("begin").alias("from"), F.col("end").alias("to"), "component"))


def labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with label: the component of the text if at lies in or beside one of its known passages, else the node."""
    within = (F.col("from") <= F.col("at")) & (F.col("at") < F.col("to"))
    return rows.join(known.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & within, "left").withColumn("label", F.coalesce("component", "node")).drop("of", "from", "to", "component")


def open_groups(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (sub, node, at, left, right, context) whose group has several labels, with label and k, the group's rows."""
    told = cut(labelled(rows, known), ROWS)
    groups = told.groupBy("sub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where("lo <> hi")
    out = cut(told.join(groups.select("sub", "k"), "sub"), ROWS)
    discard(told)
    return out


def surroundings(places_: DataFrame, sequences: DataFrame, least: int) -> DataFrame:
    """node, at, tokens: 16 bits (not 0) of each of the tokens around a place, as many before it as after; 0 beyond the text."""
    reach = least + DRIFT

    def take(batches):
        import pyarrow as pa

        for batch in batches:
            for node, ats, x in zip(batch.column("node").to_pylist(), batch.column("ats"), batch.column("sequence"), strict=True):
                short = np.maximum(np.frombuffer(x.as_buffer(), dtype=np.uint32) & np.uint32(0xFFFF), 1).astype(np.uint16)
                padded = np.r_[np.zeros(reach, np.uint16), short, np.zeros(reach, np.uint16)]
                at = np.asarray(ats.values)
                tokens = [padded[k : k + 2 * reach].tobytes() for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), node)), pa.array(at), pa.array(tokens, pa.binary())], names=["node", "at", "tokens"])

    by_node = places_.select("node", "at").distinct().groupBy("node").agg(F.collect_list("at").alias("ats"))
    return by_node.join(sequences, "node").mapInArrow(tidy(take), "node long, at int, tokens binary")


def products(rows: DataFrame, around: DataFrame, least: int, percent: int, forest: bool) -> DataFrame:
    """a, b, at, at_b: the candidates of different labels in one group; with forest those of a spanning forest of a batch's labels."""
    blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    piece = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    at = F.transform(F.sequence(F.lit(0), blocks - 1), lambda q: F.struct(F.least("piece", q).alias("p"), F.greatest("piece", q).alias("q")))
    names = ("sub", "p", "q", "piece", "node", "at", "left", "right", "context", "label", "tokens")
    spread = rows.join(around, ["node", "at"]).withColumn("piece", piece).withColumn("unit", F.explode(at)).withColumns({"p": F.col("unit.p"), "q": F.col("unit.q")})
    units = spread.select(*names).repartition(F.col("sub"), F.col("p"), F.col("q")).sortWithinPartitions("sub", "p", "q")

    def multiply(batches):
        import pyarrow as pa

        for held, bounds in whole_units(batches, names, ("sub", "p", "q")):
            held["tokens"] = np.ascontiguousarray(held["tokens"]).view(np.uint16)
            found = candidates(held, bounds, least, percent, forest)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)], names=["a", "b", "at", "at_b"])

    return units.mapInArrow(tidy(multiply), "a long, b long, at long, at_b long")


def near(x: np.ndarray, y: np.ndarray, least: int, percent: int) -> np.ndarray:
    """For each two rows of surroundings, whether `least` tokens in a row that hold the middle are in enough places shared within SHIFTS.

    So they must be among those that differ from the one before: a word over and over is one token of a set.
    """
    n, width = x.shape
    reach = width // 2
    at = slice(max(0, reach - least + 1), reach + 1)  # begins of stretches that hold the middle
    kind = np.uint8 if least < 256 else np.int32

    def within(mask: np.ndarray) -> np.ndarray:
        """How many of the `least` places from each begin on are set. Rows lie end to end: no begin looks beyond its own."""
        count = mask.reshape(-1).view(np.uint8).astype(kind, copy=False)
        total, done, step = None, 0, 1
        while True:
            if least & step:
                total = count if total is None else total[: len(count) - done] + count[done:]
                done += step
            if 2 * step > least:
                break
            count = count[:-step] + count[step:]
            step *= 2
        return np.append(total, np.zeros(n * width - len(total), kind)).reshape(n, width)[:, at]

    mine, theirs = x.reshape(-1), y.reshape(-1)
    met = np.zeros((n, width), dtype=bool)
    for d in range(-SHIFTS, SHIFTS + 1):
        a, b = max(0, -d), n * width - max(0, d)
        moved = np.zeros(n * width, dtype=bool)
        np.equal(mine[a:b], theirs[a + d : b + d], out=moved[a:b])
        moved = moved.reshape(n, width)
        moved[:, slice(width - d, None) if d > 0 else slice(0, -d)] = False  # those met another row
        met |= moved
    met &= x != 0
    need = -(-2 * least * percent // (100 + percent))
    enough = within(met) >= need
    out = enough.any(axis=1)
    some = np.flatnonzero(out)
    n = len(some)
    if n:
        fresh = np.ones((n, width), dtype=bool)
        fresh[:, 1:] = x[some, 1:] != x[some, :-1]
        both, all_ = within(met[some] & fresh).astype(np.int32), within(fresh).astype(np.int32)
        out[some] = (enough[some] & ((100 + percent) * both >= 2 * percent * all_)).any(axis=1)
    return out


def candidates(rows: dict[str, np.ndarray], bounds: np.ndarray, least: int, percent: int, forest: bool) -> np.ndarray:
    """a, b, at, at_b (a row each) of the candidates among the rows between each two bounds, a > b."""
    values, label = np.unique(rows["label"], return_inverse=True)
    out = np.zeros((0, 7), np.int64)  # a, b, at, at_b, run, label of a, label of b
    for i, j in pairs_within(bounds):
        fine = (label[i] != label[j]) & (rows["node"][i] != rows["node"][j])
        fine &= (rows["p"][i] == rows["q"][i]) | (rows["piece"][i] != rows["piece"][j])  # in a unit of two blocks one row of each
        i, j = i[fine], j[fine]
        run = runs(rows["context"][i], rows["context"][j])
        common = np.minimum(rows["left"][i], rows["left"][j]) + np.minimum(rows["right"][i], rows["right"][j])
        fine = (run >= RUN) & (common >= least - DRIFT)
        i, j, run = i[fine], j[fine], run[fine]
        for turned in (False, True):  # seen from either side
            x, y = (j, i) if turned else (i, j)
            fine = [near(rows["tokens"][x[k : k + ALIKE]], rows["tokens"][y[k : k + ALIKE]], least, percent) for k in range(0, len(x), ALIKE)]
            fine = np.concatenate(fine or [np.zeros(0, bool)])
            i, j, run = i[fine], j[fine], run[fine]
        i, j = np.where(rows["node"][i] < rows["node"][j], (j, i), (i, j))
        out = np.r_[out, np.stack([rows["node"][i], rows["node"][j], rows["at"][i], rows["at"][j], run, label[i], label[j]], axis=1)]
        if forest:
            out = out[np.lexsort((out[:, 1], out[:, 0], -out[:, 4]))]
            out = out[spanning(len(values), out[:, 5], out[:, 6])]
    # of a pair's places one for each shift, give or take DRIFT, which verification looks at together
    _, once = np.unique(np.stack([out[:, 0], out[:, 1], (out[:, 3] - out[:, 2]) // DRIFT], axis=1), axis=0, return_index=True)
    return out[np.sort(once), :4]


def shared_places(x: np.ndarray, y: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of equal shingles whose distance is `shift`, give or take DRIFT, ordered by place in x."""
    i, j = [], []
    for d in range(shift - DRIFT, shift + DRIFT + 1):
        begin, end = max(0, -d), min(len(x), len(y) - d)
        if begin < end:
            hit = np.flatnonzero(x[begin:end] == y[begin + d : end + d]) + begin
            if len(hit):
                i.append(hit)
                j.append(hit + d)
    if not i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(i), np.concatenate(j)
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


class Ordered:
    """A sequence in the order of its values (equal ones by place): what it is looked up in."""

    def __init__(self, y: np.ndarray):
        both = np.sort((y.astype(np.uint64) << np.uint64(32)) | np.arange(len(y), dtype=np.uint64))
        self.values, self.order = (both >> np.uint64(32)).astype(y.dtype), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.distinct = not (self.values[1:] == self.values[:-1]).any()


class Matches:
    """Equal shingles of two sequences: places (in x, in y) whose distance is a shift, give or take DRIFT, one for each place in x, by place in x."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ordered: Ordered | None = None):
        self.x, self.y = x, y
        ordered = ordered or Ordered(y)
        low = np.searchsorted(ordered.values, x)
        #: Whether no place in x has several in y.
        self.single = ordered.distinct
        if self.single:
            self.i = np.flatnonzero(ordered.values[np.minimum(low, len(y) - 1)] == x)
            n, total = None, len(self.i)
        else:
            n = np.searchsorted(ordered.values, x, side="right") - low
            total = int(n.sum())
        #: Whether all pairs of equal shingles are at hand; of texts that repeat themselves there may be too many.
        self.known = total <= MATCHES * (len(x) + len(y))
        if self.known and self.single:
            self.j = ordered.order[low[self.i]]
        elif self.known:
            self.i = np.repeat(np.arange(len(x)), n)
            self.j = ordered.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)]
        if self.known:
            self.shift = self.j - self.i
        self.sets = False
        if self.known and self.single:
            x = np.sort(x)
            self.sets = not (x[1:] == x[:-1]).any()

    def alike(self, a: int, b: int, c: int, d: int, percent: int) -> bool:
        """Whether x[a:b] and y[c:d] reach the similarity as sets."""
        if not self.sets:
            return alike(self.x[a:b], self.y[c:d], percent)
        first, last = self.i.searchsorted((a, b))
        j = self.j[first:last]
        both = int(np.count_nonzero((j >= c) & (j < d)))
        return 100 * both >= percent * (b - a + d - c - both)

    def around(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        if self.known:
            fine = np.flatnonzero(np.abs(self.shift - shift) <= DRIFT)
            i, j = self.i[fine], self.j[fine]
            if self.single:
                return i, j
        else:
            i, j = shared_places(self.x, self.y, shift)
        if (i[1:] == i[:-1]).any():
            nearest = np.lexsort((np.abs(j - i - shift), i))
            i, j = i[nearest], j[nearest]
            once = np.append(True, i[1:] > i[:-1])
            i, j = i[once], j[once]
        return i, j


def longest_stretches(scores: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the stretches of runs (even places; between them what they cost) whose sum is not negative, without those within others.

    The furthest end for a begin is the last place where the running total is no lower than before the begin.
    """
    total = np.append(0, np.cumsum(scores))
    later = np.maximum.accumulate(total[::-1])[::-1]  # the largest total from each place on: never rises
    first = np.arange(0, len(scores), 2)
    last = np.searchsorted(-later, -total[first], side="right") - 2
    new = last > np.append(-1, np.maximum.accumulate(last)[:-1])
    return list(zip(first[new].tolist(), last[new].tolist(), strict=True))


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    p, q = set(x.tolist()), set(y.tolist())
    both = len(p & q)
    return 100 * both >= percent * (len(p) + len(q) - both)


def passages(x: np.ndarray, y: np.ndarray, starts: np.ndarray, least: int, percent: int, ordered: Ordered | None = None) -> list[tuple[int, int, int, int]]:
    """(begin, end, begin_b, end_b) of near-duplicate passages of two shingle sequences, on the shifts of places that they share.

    Runs of shared shingles score for their length, what lies between them costs, so that a stretch of runs has no
    negative score where it is similar enough. Every run lies in one of the longest such stretches; each that is long
    enough is compared as sets, and where repeats make the sets less alike than the runs, its long runs are passages on their own.
    """
    out: list[tuple[int, int, int, int]] = []
    matches = Matches(x, y, ordered)
    by_shift: dict[int, list[list[int]]] = {}
    for m in starts.tolist():
        by_shift.setdefault(m[1] - m[0], []).append(m)
    for shift, mine in sorted(by_shift.items()):
        if out and all(any(p[0] <= m[0] < p[1] and p[2] <= m[1] < p[3] for p in out) for m in mine):
            continue  # within passages that are known
        i, j = matches.around(shift)
        if len(i) < max(1, least * percent // 100):
            continue
        step, step_b = i[1:] - i[:-1], j[1:] - j[:-1]
        edges = np.flatnonzero((step != 1) | (step_b != 1))
        first, last = np.append(0, edges + 1), np.append(edges, len(i) - 1)
        begin, end, begin_b, end_b = i[first].tolist(), (i[last] + 1).tolist(), j[first].tolist(), (j[last] + 1).tolist()
        stretches = [(0, 0)]
        if len(edges):
            scores = np.empty(2 * len(first) - 1, dtype=np.int64)
            scores[::2] = (last - first + 1) * (100 - percent)
            gap_b = step_b[edges]
            scores[1::2] = -percent * (step[edges] - 1 + np.where(gap_b > 0, gap_b - 1, least))
            stretches = longest_stretches(scores)
        for u, v in stretches:
            u, v = u // 2, v // 2
            if end[v] - begin[u] < least:
                continue  # nor is any of its runs longer
            whole = (begin[u], end[v], begin_b[u], end_b[v])
            some = [whole] if u == v or matches.alike(*whole, percent) else [(begin[r], end[r], begin_b[r], end_b[r]) for r in range(u, v + 1) if end[r] - begin[r] >= least]
            out += [p for p in some if p[3] - p[2] >= least and p not in out]
    return out


def repeated_passages(docs: DataFrame, words: int = PASSAGE, percent: int = SIMILARITY, n_hashes: int = HASHES) -> DataFrame:
    """doc_id, start and end (in words, end exclusive), component_id: each passage of a document that near-repeats in another one.

    Passages of a document that overlap are one row. component_id is the smallest doc_id that
    can be reached by shared passages.
    """
    least = words - WORDS + 1
    every = cut(described(docs, least, n_hashes), ROWS)
    shared = shared_windows(every)
    told = cut(every.where("doc_id IS NOT NULL").select("doc_id", "node", "n").distinct(), ROWS)
    discard(every)
    classes = told.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"))
    links, component = all_links(shared, docs, classes, least, percent)
    discard(shared)
    spans = links.select(F.col("a").alias("node"), "begin", "end").union(links.select("b", "begin_b", "end_b"))
    spans = spans.union(classes.where("copies > 1").select("node", F.lit(0), F.col("n").cast("int")))
    spans = merged(spans.distinct())
    named = classes.join(component, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    roots = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = spans.join(named.join(roots, "component").select("node", "component_id"), "node")
    return told.join(by_node, "node").select("doc_id", F.col("begin").cast("long").alias("start"), (F.col("end") + F.lit(WORDS - 1)).cast("long").alias("end"), "component_id")


def all_links(shared: DataFrame, docs: DataFrame, classes: DataFrame, least: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The verified passages (of stars, of forests of the candidates that are apart then, and of all candidates that are still apart) and the components they make."""
    sequences = sequences_for(shared.select("node").distinct(), docs, classes, least)
    pairs = cut(stars(shared, least), ROWS)
    links = verified(pairs, sequences, least, percent)
    component = components(links.select("a", "b"))
    known = places(links, component, least)
    columns = ("sub", "node", "at", "left", "right", "context")
    opened = open_groups(dealt(shared, HALVES).select(*columns), known)
    around = cut(surroundings(opened, sequences, least), ROWS)
    small, large = opened.where(F.col("k") <= LARGE), opened.where(F.col("k") > LARGE)
    found = products(small, around, least, percent, False).unionByName(products(large, around, least, percent, True))
    more = cut(by_pair(found).join(pairs, ["a", "b"], "left_anti"), ROWS)
    new = verified(more, sequences, least, percent)
    links, component = links.unionByName(new), grown(component, new)
    if not large.isEmpty():
        pairs = pairs.select("a", "b").unionByName(more.select("a", "b"))
        left = open_groups(large.select(*columns), places(links, component, least))
        rest = cut(by_pair(products(left, around, least, percent, False)).join(pairs, ["a", "b"], "left_anti"), ROWS)
        new = verified(rest, sequences, least, percent)
        links, component = links.unionByName(new), grown(component, new)
    for done in (known, opened, around, sequences):
        discard(done)
    return links, component


def merged(spans: DataFrame) -> DataFrame:
    """Spans of a node with those that overlap made one."""
    order = Window.partitionBy("node").orderBy("begin", "end")
    new = F.col("begin") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return spans.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order)).groupBy("node", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def sequences_for(nodes: DataFrame, docs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """node, sequence: 32 bits of each token of the nodes' texts, in order."""
    wanted = cut(nodes.join(classes, "node").select(F.col("first").alias("doc_id")).distinct())
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def whole(batches):
        import pyarrow as pa

        for batch in batches:
            for _, hashes, at, long_ in sequences_of(batch.column("text"), least):
                parts = [hashes[at[k] : at[k + 1]] for k in long_]
                halves = [(p >> np.uint64(32)).astype(np.uint32).tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(p) for p in parts], pa.int64()), pa.array(halves, pa.binary())], names=["node", "sequence"])

    out = cut(docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").select("text").mapInArrow(tidy(whole), "node long, sequence binary"), ROWS)
    discard(wanted)
    rows, distinct = out.agg(F.count("*"), F.count_distinct("node")).first()
    if rows == distinct:
        return out
    once = cut(out.dropDuplicates(["node"]), ROWS)  # only rows that repeat a doc_id
    discard(out)
    return once


def compared(batches, least: int, percent: int):
    """Of batches a, b, starts, x, y (the sequences of a and b): the passages. Sorted by b, each b is ordered once for all its pairs."""
    import pyarrow as pa

    of, ordered = None, None
    for batch in batches:
        rows = []
        values = [batch.column("a").to_pylist(), batch.column("b").to_pylist(), *(batch.column(c) for c in ("starts", "x", "y"))]
        for a, b, starts, x, y in zip(*values, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y))
            if ordered is None or b != of:
                of, ordered = b, Ordered(y)
            at = np.sort(np.asarray(starts.values))
            for p in passages(x, y, np.stack([at >> 32, at & 0xFFFFFFFF], axis=1), least, percent, ordered):
                rows.append((a, *p[:2], b, *p[2:]))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "begin", "end", "b", "begin_b", "end_b"])


def verified(pairs: DataFrame, sequences: DataFrame, least: int, percent: int) -> DataFrame:
    """a, begin, end, b, begin_b, end_b (in shingles) of every verified passage of the pairs."""

    def compare(batches):
        yield from compared(batches, least, percent)

    left = pairs.join(sequences.select(F.col("node").alias("a"), F.col("sequence").alias("x")), "a")
    both = left.join(sequences.select(F.col("node").alias("b"), F.col("sequence").alias("y")), "b").select("a", "b", "starts", "x", "y")
    return cut(both.mapInArrow(tidy(compare), "a long, begin int, end int, b long, begin_b int, end_b int"), ROWS)
