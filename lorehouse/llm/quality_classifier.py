"""Quality classifier by Bradley-Terry pairwise ranking, cut at a quantile of the scores.

A document's strength is a linear function of native text features; a document marked 1 is preferred to one marked 0,
and the weights minimise the logistic loss of the feature differences of such pairs. The threshold is the quantile of
the training scores that leaves the training share of mark 0 below it; scores map to [0, 1] with that quantile at
``CUT``. Features and scores are one projection of DataFrame functions.

``train`` uses every marked row and every pair of them. The loss of a pair depends on the rows' strengths alone, so rows of
near strength are summed into one of ``BINS`` bins of their mark: a Newton step is one aggregation over the rows' features, and
the driver holds the bins' sums, whatever the number of rows. The quantile is exact: the range that holds it is cut into bins
until two strengths next to each other are left.

Defined results: null and empty texts, and texts of blanks, have no words to rank and score 0; without marks of both kinds
every score is 1. Rows are scored one by one, so repeated rows agree. Other columns pass through; one named
like the score is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, discard, free_name, held

#: The score of the threshold, bins of strengths, Newton steps at most, the weights' shrinkage and decimals.
CUT, BINS, STEPS, SHRINK, DECIMALS = 0.7, 512, 30, 1e-4, 9
FEATURES = (
    "any", "words", "symbols", "marks", "bars", "shouting", "capitals", "digits", "repeats", "same_next", "word_chars", "ends",
)


def with_features(docs: DataFrame, text_col: str = "text", x_col: str = "x") -> DataFrame:
    """``docs`` with an array of numbers about each whole text, in the order of ``FEATURES``; shares are per word."""
    t, w = free_name(docs, "__text"), free_name(docs, "__w")
    text, words = F.col(f"`{t}`"), F.col(f"`{w}`")
    split = held(docs.withColumn(t, F.coalesce(docs[text_col].cast("string"), F.lit(""))), w, F.array_remove(F.split(text, BLANKS), ""))
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    many = lambda c: F.length(F.regexp_replace(text, f"[^{c}]+", ""))
    loud = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    x = F.array(
        (F.size(words) > 0).cast("double"),
        F.log1p(F.size(words).cast("double")),
        F.least(F.lit(3.0), many("#*$%&<>") / n),
        F.least(F.lit(3.0), many("!?") / n),
        F.least(F.lit(1.0), many("|") / n),
        F.size(F.filter(words, lambda x: loud(x) & (F.length(x) > 1))) / n,
        F.size(F.filter(words, loud)) / n,
        F.least(F.lit(3.0), many("0-9") / n),
        1 - F.size(F.array_distinct(words)) / n,
        F.size(F.filter(words, lambda x, i: x == F.get(words, i - 1))) / n,
        F.least(F.lit(30.0), F.length(text) / n),
        F.least(F.lit(1.0), many(".") / n),
    )
    return held(split, x_col, x).drop(t, w)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float
    scale: float

    def score(self, x: Column) -> Column:
        """Of an array of features."""
        strength = dot(x, self.weights)
        ranked = 1 / (1 + F.exp(-((strength - self.threshold) * self.scale + float(np.log(CUT / (1 - CUT))))))
        return F.when(x[0] > 0, ranked).otherwise(0.0)


def fit(x: np.ndarray, mark: np.ndarray, share_of_0: float | None = None, pairs: int = 60_000, epochs: int = 400, rate: float = 0.3, shrink: float = 1e-4, seed: int = 42) -> Model | None:
    good, bad = np.flatnonzero(mark == 1), np.flatnonzero(mark == 0)
    if not len(good) or not len(bad):
        return None
    spread = x.std(axis=0)
    spread[spread < 1e-9] = 1
    rng = np.random.default_rng(seed)
    # Each preferred row meets about as many others; differences, not rows, carry the loss.
    diff = (x[good[rng.integers(0, len(good), pairs)]] - x[bad[rng.integers(0, len(bad), pairs)]]) / spread
    w, g = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(epochs):
        miss = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * miss[:, None]).mean(axis=0) + shrink * w
        g += grad**2
        w -= rate * grad / np.sqrt(g)
    w = w / spread
    s = x @ w
    # The quantile of the scores, each mark weighted to its share of the marks, that has the share of 0 below it.
    share = len(bad) / len(s) if share_of_0 is None else share_of_0
    weight = np.where(mark == 1, (1 - share) / len(good), share / len(bad))
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share))
    at = min(max(at, 0), len(s) - 2)
    threshold = (s[order[at]] + s[order[at + 1]]) / 2
    return Model(tuple(map(float, w)), float(threshold), 1.0)


def marked(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(label, x): the features of every document with a mark of 0 or 1. Features are joined, not texts."""
    told = marks.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = with_features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "x")
    return rows.join(told, "id").select("label", "x")


def train(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model from the texts of ``docs`` and the 0/1 marks of their ids, from all of them."""
    rows = cut(marked(docs, marks, id_col, text_col, label_col))
    try:
        return fit_all(rows)
    finally:
        discard(docs.sparkSession, rows)


def fit_all(rows: DataFrame) -> Model | None:
    """A model from rows (label, x): the least loss over all pairs of a row of 1 and a row of 0, by damped Newton steps."""
    k = len(FEATURES)
    x = [F.get("x", F.lit(i)) for i in range(k)]
    facts = rows.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(c * c).alias(f"q{i}") for i, c in enumerate(x)]).collect()
    n = {r["label"]: r["n"] for r in facts}
    if len(n) < 2:
        return None
    total = sum(n.values())
    mean = np.array([sum(r[f"s{i}"] for r in facts) for i in range(k)]) / total
    spread = np.sqrt(np.maximum(np.array([sum(r[f"q{i}"] for r in facts) for i in range(k)]) / total - mean**2, 0))
    spread[spread < 1e-9] = 1
    z = rows.select("label", F.array(*[(c - float(m)) / float(d) for c, m, d in zip(x, mean, spread, strict=True)]).alias("z"))
    w, best, last, second = np.zeros(k), np.zeros(k), np.inf, None
    for _ in range(STEPS):
        wide = 1.0 if second is None else max(float(np.sqrt(w @ second @ w)), 1e-12)
        loss, grad, hessian, squares = _sums(z, w, wide, n[1] * n[0])
        second = squares / total
        if loss <= last + 1e-9:
            step, best, last = np.linalg.solve(hessian, grad), w, loss
        else:  # too far: half the way from the best
            step = step / 2
        w = best - step
        if np.abs(step).max() < 1e-4:
            best = w
            break
    w = np.round(best / spread, DECIMALS)
    s = rows.select(dot(F.col("x"), w).alias("s"))
    return Model(tuple(map(float, w)), quantile_gap(s, "s", n[0]), 1.0)


def dot(x: Column, w: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _sums(z: DataFrame, w: np.ndarray, wide: float, pairs: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss over all pairs, its gradient and second derivatives, and the rows' squares, from the sums of the bins. Bins
    are even steps of the logistic function of the strengths by their spread ``wide``; a bin stands for its mean."""
    k = len(w)
    scored = held(z, "t", dot(F.col("z"), w / wide))
    at = F.least(F.lit(BINS - 1), F.floor(BINS / (1 + F.exp(-F.col("t")))).cast("int"))
    c = [F.get("z", F.lit(i)) for i in range(k)]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count("*").alias("n"), F.sum("t").alias("t"), *[F.sum(a).alias(f"x{i}") for i, a in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"x{i}_{j}") for i, j in upper]]
    told = np.array([list(r) for r in scored.groupBy("label", at.alias("b")).agg(*sums).orderBy("label", "b").collect()], dtype=float)  # at most 2 * BINS rows
    parts = []
    for label in (1, 0):
        t = told[told[:, 0] == label]
        square = np.zeros((len(t), k, k))
        for m, (i, j) in enumerate(upper):
            square[:, i, j] = square[:, j, i] = t[:, 4 + k + m]
        parts.append((t[:, 2], wide * t[:, 3] / t[:, 2], t[:, 4 : 4 + k], square))
    (ng, sg, xg, qg), (nb, sb, xb, qb) = parts
    d = sg[:, None] - sb[None, :]
    miss = 1 / (1 + np.exp(np.clip(d, -500, 500)))
    loss = (np.logaddexp(0, -d) * ng[:, None] * nb[None, :]).sum() / pairs + SHRINK / 2 * (w @ w)
    grad = -((miss @ nb) @ xg - (ng @ miss) @ xb) / pairs + SHRINK * w
    v = miss * (1 - miss)
    cross = xg.T @ v @ xb
    hessian = (np.tensordot(v @ nb, qg, 1) + np.tensordot(ng @ v, qb, 1) - cross - cross.T) / pairs + SHRINK * np.eye(k)
    return float(loss), grad, hessian, qg.sum(axis=0) + qb.sum(axis=0)


def quantile_gap(rows: DataFrame, col: str, below: int) -> float:
    """The middle between the ``below``-th number of a column and the next one, in order; exact, from counts of bins."""
    s, got = F.col(col), []
    for rank in (below, below + 1):
        low, high, n = rows.agg(F.min(s), F.max(s), F.count("*")).first()
        rank, before = min(max(rank, 1), n), 0
        while low < high:
            width = (high - low) / BINS
            at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((s - low) / width).cast("int"))) if width > 0 else F.lit(0)
            bins = rows.where(s.between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(s).alias("low"), F.max(s).alias("high")).orderBy("b").collect()
            for b in bins:
                if before + b["n"] >= rank:
                    break
                before += b["n"]
            if (b["low"], b["high"]) == (low, high):  # numbers that no width tells apart
                break
            low, high = b["low"], b["high"]
        got.append(low)
    return (got[0] + got[1]) / 2


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1] for each whole text."""
    if model is None:
        return docs.withColumn(score_col, F.lit(1.0))
    x = free_name(docs, "__x")
    return with_features(docs, text_col, x).withColumn(score_col, model.score(F.col(f"`{x}`"))).drop(x)
