"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

* **Voters.** Lexicon voters fire on a word of a list of insults in four languages; pattern voters fire on word beginnings
  (4 and 5 bytes) and words, proposed because marked toxic rows of the sample use them far more than the others; one
  pattern voter votes "clean" where no other fires. They see hashes of lower-cased words, so one pass over the text
  serves all.
* **Copies.** Of copies and near copies in the sample one counts, found by bands of minimum hashes; otherwise a copied
  text's chance words would look like evidence.
* **Label model.** Each voter has an accuracy for both classes, estimated by expectation-maximisation from the votes of
  the training sample alone, started from their majority; the marks have no part in it. Voters that fire together more often than the classes explain
  are correlated; a voter's evidence is divided by its number of effective copies, estimated from those correlations.
* **Classifier.** Logistic regression over hashed words and word beginnings, fitted to the posteriors, scores all
  documents. Its bias is fitted to the marks of the sample by a last logistic step, so 0.5 separates the classes.

The sample is bounded: at most ``per_class`` rows of each mark. Everything else covers all rows and whole texts.

Defined results: null and empty texts have no feature and get the score of the bias alone, below 0.5; without labelled
rows every score is 0. Rows are scored one by one, so repeated rows agree; other columns pass through, one named like the
score is replaced by it. Of the sample only features come to the driver, never texts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked_sample, small_batches
from .words import mix, runs_of_words

#: Insults in English, German, French and Spanish.
LEXICON = (
    "idiot moron stupid loser trash scum worthless pathetic disgusting clown fool dumb jerk vermin filth imbecile scumbag bastard "
    "dummkopf trottel arschloch versager abschaum vollidiot schwachkopf miststück wichser dreckskerl blödmann widerlich erbärmlich depp "
    "imbécile connard salaud abruti crétin ordure minable dégoûtant pathétique débile raclure enfoiré bouffon ducon "
    "imbécil idiota estúpido basura escoria patético asqueroso payaso inútil tonto cabrón gilipollas cretino tarado"
).split()
STEMS = (4, 5)
#: Rows of the sample that a feature has to be in: one in fewer is never evidence enough, nor a sign of a copy.
SEEN = 3
_BITS = np.uint64(40)
_SALT = {k: np.uint64(k << 32 | 1) for k in (0, *STEMS)}


def features_of(texts: pa.Array, known: np.ndarray | None = None) -> Iterable[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run: first row, number of rows, then document and 40-bit hash of each distinct word and word beginning,
    of those in the sorted array ``known`` if it is given."""
    for run in runs_of_words(texts, STEMS):
        keys = []
        for k, h in ((0, run.hash), *run.prefix.items()):
            f = mix(h + _SALT[k]) >> (np.uint64(64) - _BITS)
            use = h != 0
            if known is not None:
                at = np.searchsorted(known, f)
                use &= known[np.minimum(at, len(known) - 1)] == f
            keys.append(run.doc[use].astype(np.uint64) << _BITS | f[use])
        key = np.unique(np.concatenate(keys))
        yield run.first, run.n_docs, (key >> _BITS).astype(np.int64), key & ((np.uint64(1) << _BITS) - np.uint64(1))


def hashes_of(words: list[str]) -> np.ndarray:
    return np.concatenate([mix(run.hash + _SALT[0]) >> (np.uint64(64) - _BITS) for run in runs_of_words(pa.array(words))])


@dataclass(frozen=True)
class Model:
    known: np.ndarray  # sorted hashes of the words and beginnings with a weight
    weights: np.ndarray
    bias: float
    voters: list[tuple[int, float, float, float]]  # hash, rate among toxic, rate among clean, effective copies

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, n, doc, f in features_of(texts, self.known) if len(self.known) else ():
            out[first : first + n] += np.bincount(doc, self.weights[np.searchsorted(self.known, f)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def evidence(yes: np.ndarray, no: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """Log-likelihood ratio of "a slot is as frequent in both classes" against "it is not" (G squared)."""
    part = lambda seen, total, rate: seen * np.log((seen + 1e-12) / (total * rate + 1e-12)) + (total - seen) * np.log((total - seen + 1e-12) / (total * (1 - rate) + 1e-12))
    rate = (yes + no) / (toxic + clean)
    return 2 * (part(yes, toxic, rate) + part(no, clean, rate))


def choose_voters(n: int, doc: np.ndarray, col: np.ndarray, names: np.ndarray, mark: np.ndarray, at_most: int = 512, ratio: float = 8.0, least: float = 30.0) -> np.ndarray:
    """Columns at least ``ratio`` times as frequent in toxic rows, by evidence that chance does not give, and the lexicon's."""
    toxic, clean = max(1, mark.sum()), max(1, n - mark.sum())
    yes, no = np.bincount(col, mark[doc], minlength=len(names)), np.bincount(col, 1 - mark[doc], minlength=len(names))
    good = np.flatnonzero(((yes / toxic) >= ratio * (no + 0.5) / clean) & (evidence(yes, no, toxic, clean) >= least))
    mined = good[np.argsort(-yes[good], kind="stable")][:at_most]
    return np.unique(np.concatenate([mined, np.flatnonzero(np.isin(names, hashes_of(LEXICON)))]))


def majority(votes: np.ndarray) -> np.ndarray:
    """1 for rows with more voters for toxic than for clean; the last voter is the one for clean."""
    return (votes[:, :-1].sum(axis=1) > votes[:, -1]).astype(float)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, and each voter's rate among toxic rows, among clean rows, and effective copies."""
    post = np.clip(start.astype(float), 0.05, 0.95)
    copies = np.ones(votes.shape[1])
    for step in range(rounds):
        yes = (votes.T @ post + 0.5) / (post.sum() + 1)
        no = (votes.T @ (1 - post) + 0.05) / ((1 - post).sum() + 1)
        if step == 2:  # correlations beyond the classes: residuals after the class means
            rest = votes - (post[:, None] * yes + (1 - post)[:, None] * no)
            scale = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            linked = (rest.T @ rest) / scale / scale[:, None]
            copies = np.maximum(1, np.where(linked > 0.2, linked, 0).sum(axis=0))
        prior = np.clip(post.mean(), 0.01, 0.99)
        fired = np.log(yes / no) / copies
        silent = np.log((1 - yes) / (1 - no)) / copies
        odds = np.log(prior / (1 - prior)) + votes @ fired + np.maximum((1 - votes) @ silent, -6)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, yes, no, copies


def apart(n: int, doc: np.ndarray, col: np.ndarray, n_cols: int, bands: int = 8, wide: int = 4, common: float = 0.1) -> np.ndarray:
    """Rows that share no band of minimum hashes of their rarer words with an earlier row."""
    rare = (np.bincount(col, minlength=n_cols) <= common * n)[col]
    doc, col = doc[rare], col[rare]
    order = np.argsort(doc, kind="stable")
    doc, col = doc[order], col[order].astype(np.uint64)
    filled, first = np.unique(doc, return_index=True)
    keep = np.ones(n, bool)
    for band in range(bands if len(filled) else 0):
        key = np.zeros(len(filled), np.uint64)
        for k in range(wide):
            key = mix(key + np.minimum.reduceat(mix(col + np.uint64((band * wide + k + 1) << 32)), first))
        again = np.ones(len(filled), bool)
        again[np.unique(key, return_index=True)[1]] = False
        keep[filled[again]] = False
    return keep


def packed_features(texts: pa.Array) -> pa.Array:
    """The features of each text as 64-bit numbers in a row, so that no text of the sample has to leave its task."""
    out = [b""] * len(texts)
    for first, n, doc, f in features_of(texts):
        ends = np.searchsorted(doc, np.arange(n + 1))
        for k in range(n):
            out[first + k] = f[ends[k] : ends[k + 1]].astype("<u8").tobytes()
    return pa.array(out, pa.binary())


def regression(doc: np.ndarray, col: np.ndarray, post: np.ndarray, width: int, epochs: int, rate: float, shrink: float) -> np.ndarray:
    """Weights, none below 0, of a logistic regression on 0/1 features (row, column) to the posteriors, both classes alike, by
    steps that adapt to each weight."""
    n, w, b = len(post), np.zeros(width), 0.0
    gw, gb = np.full(width, 1e-8), 1e-8
    weight = np.where(post > 0.5, 0.5 / max(1, (post > 0.5).sum()), 0.5 / max(1, (post <= 0.5).sum()))
    for _ in range(epochs):
        out = np.bincount(doc, w[col], minlength=n) + b
        miss = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - post) * weight
        grad = np.bincount(col, miss[doc], minlength=width) + shrink * w / n
        gw += grad**2
        gb += miss.sum() ** 2
        w = np.maximum(w - rate * grad / np.sqrt(gw), 0)  # a word can only speak for a toxic text
        b -= rate * miss.sum() / np.sqrt(gb)
    return w


def fit(rows: list, epochs: int = 100, rate: float = 0.1, shrink: float = 1e-4, contrast: float = 12.0, least: float = 30.0) -> Model | None:
    """Label model and classifier from (features, label) rows, features as ``packed_features`` gives them, label 0 or 1."""
    if not rows or len({r["label"] for r in rows}) < 2:
        return None
    mark = np.array([float(r["label"]) for r in rows])
    parts = [np.frombuffer(r["features"], "<u8") for r in rows]
    doc, f = np.repeat(np.arange(len(rows), dtype=np.int32), list(map(len, parts))), np.concatenate(parts)
    del parts
    names, many = np.unique(f, return_counts=True)
    names = names[many >= SEEN]
    col = np.minimum(np.searchsorted(names, f), max(len(names) - 1, 0)).astype(np.int32)
    use = names[col] == f if len(names) else np.zeros(len(f), bool)
    doc, col = doc[use], col[use]
    del f, use, many
    keep = apart(len(rows), doc, col, len(names))
    doc, col, mark = (np.cumsum(keep) - 1)[doc[keep[doc]]], col[keep[doc]], mark[keep]
    n = len(mark)
    chosen = choose_voters(n, doc, col, names, mark)
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    hit = place[col] >= 0
    votes = np.zeros((n, len(chosen) + 1), np.float64)
    votes[doc[hit], place[col[hit]]] = 1
    votes[:, -1] = votes.sum(axis=1) == 0  # the voter for clean
    post, rate_toxic, rate_clean, copies = label_model(votes, majority(votes))
    post = np.clip(post, 0.02, 0.98)
    # Classifier on the posteriors: features that mark toxic rows by more than chance and length or language explain.
    yes, no = np.bincount(col, post[doc], minlength=len(names)), np.bincount(col, 1 - post[doc], minlength=len(names))
    toxic, clean = post.sum(), (1 - post).sum()
    used = (evidence(yes, no, toxic, clean) >= least) & (yes / toxic >= contrast * (no + 0.5) / clean)
    doc, col = doc[used[col]], (np.cumsum(used) - 1)[col[used[col]]]
    w = regression(doc, col, post, int(used.sum()), epochs, rate, shrink)
    # The bias: the sample's marks, each class alike, decide where 0.5 lies; no feature at all stays below it.
    out = np.bincount(doc, w[col], minlength=n)
    cuts = np.unique(out)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else np.array([1.0])
    wrong = (np.searchsorted(np.sort(out[mark == 1]), cuts) / max(1, (mark == 1).sum())) + 1 - np.searchsorted(np.sort(out[mark == 0]), cuts) / max(1, (mark == 0).sum())
    best = cuts[wrong <= wrong.min() + 1e-12]
    return Model(names[used], w, -max(float(best[len(best) // 2]), 1e-6), [(int(h), float(a), float(c), float(k)) for h, a, c, k in zip(names[chosen], rate_toxic, rate_clean, copies, strict=False)])


def train(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000) -> Model | None:
    """A model from the texts of ``docs`` and the 0/1 marks of their ids."""
    small_batches(docs.sparkSession)
    rows = marked_sample(docs, marks, label_col, per_class, id_col, text_col)
    return fit(rows.select("label", "h", F.arrow_udf(packed_features, "binary")("text").alias("features")).orderBy("label", "h").collect())


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1] for each whole text."""
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers at most: features above the evidence bound

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    # Not deterministic, for the optimiser: it would run the function again for each use of its result.
    return docs.withColumn(score_col, of.asNondeterministic()(docs[text_col].cast("string")))
