"""A quality classifier made of sparse rules.

Statistics of a text are built-in column expressions. On a bounded sample of labelled rows the
driver grows shallow trees, reads every path from a root as a conjunctive rule ("capitals > 0.4
and words > 12"), and fits weights for the rules by logistic regression with a lasso penalty,
which sets most of them to 0. What is left compiles to one Spark column: no Python touches a
scored text.

`SAMPLE` bounds the labelled rows that a fit reads: those of the smallest hashes of doc_id. It is
the only bound here; scoring covers every row and whole texts.

Defined results: null and empty texts have all statistics 0 and are scored like any other. Null
labels and labels without a document are ignored; a doc_id with several labels counts with each.
Without both classes among the labels the score is the share of label 1 (0.5 without labels).
Null doc_ids are scored and are not held out. Repeated rows are scored each; columns other than
doc_id and text are not read by `scores` and pass through `keep_good` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, share, text_or_empty, worded_lines, words

SAMPLE = 20_000
FOLDS = 5
CUT = 0.3
TREES, DEPTH, MIN_LEAF, CUTS = 12, 3, 5, 24
LASSO = 0.002


NAMES = (
    "words", "chars_a_word", "distinct_words", "runs", "lines", "words_a_line", "repeated_lines", "capitals", "digits",
    "symbols_a_word", "bars_a_word", "exclaims_a_word", "stops_a_word", "commas_a_word",
)


def statistics(text: Column) -> Column:
    """The struct of NAMES, all doubles, as one expression that computes each part once."""
    clean = text_or_empty(text)
    count = lambda pattern: F.regexp_count(clean, F.lit(pattern))

    def counted(w: Column, lines: Column) -> Column:
        state = lambda last, n: F.struct(last.alias("last"), n.cast("int").alias("n"))
        return F.struct(
            F.size(w).alias("words"),
            F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)).alias("chars"),
            F.size(F.array_distinct(w)).alias("distinct"),
            F.aggregate(w, state(F.lit(""), F.lit(0)), lambda a, x: state(x, a["n"] + (a["last"] == x).cast("int")), lambda a: a["n"]).alias("runs"),
            F.size(lines).alias("lines"),
            F.size(F.array_distinct(lines)).alias("distinct_lines"),
            F.length(clean).alias("text_chars"),
        )

    def ratios(c: Column) -> Column:
        values = {
            "words": c["words"].cast("double"),
            "chars_a_word": share(c["chars"], c["words"]),
            "distinct_words": share(c["distinct"], c["words"]),
            "runs": share(c["runs"], c["words"]),
            "lines": c["lines"].cast("double"),
            "words_a_line": share(c["words"], c["lines"]),
            "repeated_lines": share(c["lines"] - c["distinct_lines"], c["lines"]),
            "capitals": share(count(r"\p{Lu}"), c["text_chars"]),
            "digits": share(count(r"[0-9]"), c["text_chars"]),
            "symbols_a_word": share(count(r"[#*$%&<>=~^{}\[\]]"), c["words"]),
            "bars_a_word": share(count(r"[|]"), c["words"]),
            "exclaims_a_word": share(count(r"!"), c["words"]),
            "stops_a_word": share(count(r"[.?!]"), c["words"]),
            "commas_a_word": share(count(r","), c["words"]),
        }
        return F.struct(*(values[n].alias(n) for n in NAMES))

    return let(let(words(clean), lambda w: let(worded_lines(clean), lambda lines: counted(w, lines))), ratios)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, stats: Column) -> Column:
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            test = F.lit(True)
            for c in conditions:
                test = test & ((stats[c.feature] > c.cut) if c.above else (stats[c.feature] <= c.cut))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray, names: tuple[str, ...] = NAMES) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            total += weight * holds(conditions, x, names)
        return 1 / (1 + np.exp(-total))


def holds(conditions: tuple[Condition, ...], x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in conditions:
        v = x[:, names.index(c.feature)]
        out &= (v > c.cut) if c.above else (v <= c.cut)
    return out


def grow(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], rng: np.random.Generator, trees: int = TREES, depth: int = DEPTH) -> list[tuple[Condition, ...]]:
    """The paths of trees grown one after the other on what the earlier ones leave unexplained."""
    paths: dict[tuple[Condition, ...], None] = {}
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1], method="inverted_cdf")) for j in range(x.shape[1])]
    # quantiles miss rare values, which is where junk lies
    cuts = [np.unique(np.r_[c, np.linspace(x[:, j].min(), x[:, j].max(), CUTS)[1:-1]]) for j, c in enumerate(cuts)]
    for _ in range(trees):
        grad = y - 1 / (1 + np.exp(-margin))
        rows = rng.random(len(y)) < 0.7
        features = rng.permutation(x.shape[1])[: max(2, int(0.7 * x.shape[1]))]
        leaves: list[tuple[np.ndarray, tuple[Condition, ...]]] = [(np.flatnonzero(rows), ())]
        for _ in range(depth):
            nxt = []
            for at, path in leaves:
                split = best_split(x[at], grad[at], features, cuts)
                if split is None:
                    nxt.append((at, path))
                    continue
                j, cut = split
                over = x[at, j] > cut
                for above, part in ((True, at[over]), (False, at[~over])):
                    longer = (*path, Condition(names[j], above, float(cut)))
                    paths[longer] = None
                    nxt.append((part, longer))
            leaves = nxt
        for _, path in leaves:
            where = holds(path, x, names)
            g, p = grad[where].sum(), 1 / (1 + np.exp(-margin[where]))
            margin[where] += 0.5 * np.clip(g / ((p * (1 - p)).sum() + 1.0), -4, 4)
    return list(paths)


def best_split(x: np.ndarray, grad: np.ndarray, features: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float] | None:
    if len(grad) < 2 * MIN_LEAF:
        return None
    best, found = 1e-6, None
    base = grad.sum() ** 2 / len(grad)
    for j in features:
        bins = np.searchsorted(cuts[j], x[:, j], side="left")  # bin k: cuts[k - 1] < x <= cuts[k]
        n = np.bincount(bins, minlength=len(cuts[j]) + 1).cumsum()[:-1]
        g = np.bincount(bins, weights=grad, minlength=len(cuts[j]) + 1).cumsum()[:-1]
        ok = (n >= MIN_LEAF) & (len(grad) - n >= MIN_LEAF)
        if not ok.any():
            continue
        gain = np.where(ok, g**2 / np.maximum(n, 1) + (grad.sum() - g) ** 2 / np.maximum(len(grad) - n, 1) - base, -1)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (int(j), float(cuts[j][k]))
    return found


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient."""
    design = np.c_[np.ones(len(z)), z].astype(np.float64)
    step = 4 * len(y) / (np.linalg.norm(design, 2) ** 2 + 1e-12)
    w = np.zeros(design.shape[1])
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        grad = design.T @ (1 / (1 + np.exp(-(design @ ahead))) - y) / len(y)
        new = ahead - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = NAMES, seed: int = 0) -> Model:
    y = np.asarray(y, dtype=np.float64)
    if not len(y):
        return Model(0.0, ())
    if y.min() == y.max():
        return Model(20.0 if y[0] else -20.0, ())
    paths = grow(x, y, names, np.random.default_rng(seed))
    z = np.stack([holds(p, x, names) for p in paths], axis=1) if paths else np.zeros((len(y), 0))
    unique = {z[:, k].tobytes(): k for k in reversed(range(len(paths)))}
    keep = sorted(unique.values())
    bias, weights = lasso(z[:, keep], y)
    return Model(bias, tuple((paths[k], float(w)) for k, w in zip(keep, weights, strict=True) if w))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents that are not held out.

    The labels are cut to `sample` rows by a hash of their id before the join, so what is
    broadcast has a bound, and the joined rows are cut again by a hash of their values since doc_ids may repeat.
    """
    usable = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_q"))
    some = F.broadcast(usable.orderBy(F.xxhash64("_id"), "_id", "_q").limit(sample))
    joined = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("_id"))
    measured = joined.select("doc_id", "_q", statistics(F.col("text")).alias("_s"))
    values = ["doc_id", "_q", *NAMES]
    rows = measured.select("doc_id", "_q", *(F.col("_s")[n].alias(n) for n in NAMES)).orderBy(F.xxhash64(*values), *values).limit(2 * sample).toPandas()
    rows = rows.sort_values(["doc_id", "_q", *NAMES], ignore_index=True)
    return fit(rows[list(NAMES)].to_numpy(np.float64).reshape(-1, len(NAMES)), rows["_q"].to_numpy())


def score(model: Model, text: Column) -> Column:
    return let(statistics(text), model.column)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """The result of op4."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs that the model does not reject."""
    return docs.where(score(model, F.col("text")) >= cut)
