"""Language ID by string kernels: blended-spectrum n-gram presence kernels, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the cosine of the sets of their 1- to 3-grams of lower-cased characters, hashed into
``buckets``; a text's set is a 0/1 row, so a batch's kernel values against the landmarks are one matrix product. Landmarks
are texts of the training sample; the Nyström map whitens their kernel matrix, and one ridge regression per language
(one against the rest) is solved on the mapped sample. Whole texts are read; texts are never cut.

The sample is bounded: at most ``SAMPLE`` documents of the ``LANGUAGES`` values with the most labelled rows, shared out
evenly, and for each at most ``per_language``, the ones with the least hash of the id in each of that many slots. Of rows that
share an id the least text counts. Everything else covers all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0. With no labelled text at all every
prediction is ``und`` with score 0. Equal scores go to the first language in alphabetical order. Rows are predicted one
by one, so repeated rows agree. Other columns pass through; columns named like the results are replaced by them. Very
long texts fill most of the ``buckets``: the more n-grams two of them have, the more alike they are, which blurs languages
only from some hundred thousand different n-grams on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, free_name, give_back, small_batches
from .words import in_runs

UNKNOWN = "und"
_RUN = 1 << 18
#: Bounds of the sample: languages and documents in all.
LANGUAGES, SAMPLE = 256, 8000


def presence(texts: list[str], buckets: int, longest: int) -> np.ndarray:
    """0/1 rows of the hashed 1- to ``longest``-grams of each text."""
    out = np.zeros((len(texts), buckets), np.float32)
    flat = out.reshape(-1)
    lengths = np.array([len(t) for t in texts])
    first, ends = 0, np.cumsum(lengths)
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _RUN, "right")))
        codes = np.frombuffer("".join(texts[first:last]).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(first, last), lengths[first:last])
        h = np.zeros(len(codes), np.uint32)
        for k in range(longest):
            if len(codes) <= k:
                break
            h = (h[: len(codes) - k] if k else h) * np.uint32(0x9E3779B1) + codes[k:] + np.uint32(k + 1)
            slot = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - int(buckets).bit_length() + 1)
            inside = doc[: len(h)] == doc[k:]
            flat[doc[: len(h)][inside] * buckets + slot[inside]] = 1
        first = last
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence rows, each divided by its norm
    weights: np.ndarray  # from kernel values to one score per language
    buckets: int
    longest: int

    def scores(self, texts: list[str]) -> np.ndarray:
        x = presence(texts, self.buckets, self.longest)
        norm = np.sqrt(x.sum(axis=1, keepdims=True))
        return (x @ self.landmarks.T / np.maximum(norm, 1)) @ self.weights


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> list:
    """At most ``per_label`` (text, label) rows for each label, and ``SAMPLE`` in all: of each slot of ids, the one with the least hash."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"), h.alias("h"))
    labels = [r["label"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LANGUAGES).collect()]
    if not labels:
        return []
    per_label = min(per_label, SAMPLE // len(labels))
    rows = rows.where(F.col("label").isin(*labels))
    chosen = rows.groupBy("label", F.pmod("h", F.lit(per_label)).alias("slot")).agg(F.min("h").alias("h")).select("label", "h")
    texts = rows.join(F.broadcast(chosen), ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text"))
    return texts.orderBy("label", "h").collect()


def fit(rows: list, landmarks: int = 128, buckets: int = 1 << 14, longest: int = 3, ridge: float = 1e-3, seed: int = 42) -> Model | None:
    rows = [r for r in rows if any(c.isalpha() for c in r["text"])]
    if not rows:
        return None
    languages = sorted({r["label"] for r in rows})
    texts = [r["text"].lower() for r in rows]

    def unit(part: list[str]) -> np.ndarray:
        x = presence(part, buckets, longest)
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return x

    label = np.array([languages.index(r["label"]) for r in rows])
    rng, each = np.random.default_rng(seed), max(1, landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == k))[:each] for k in range(len(languages))])
    z = unit([texts[k] for k in chosen])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    use = values > 1e-6 * values[-1]
    nystrom = vectors[:, use] / np.sqrt(values[use])
    # In parts: the sample's rows are never all there at once.
    phi = np.concatenate([(unit(texts[a : a + 64]) @ z.T).astype(np.float64) for a in range(0, len(texts), 64)]) @ nystrom
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1 / np.bincount(label))[label][:, None] * len(label) / len(languages)  # each language counts alike
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(label) * np.eye(phi.shape[1]), phi.T @ (weight * target))
    return Model(languages, z, (nystrom @ solved).astype(np.float32), buckets, longest)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 400, **options) -> Model | None:
    return fit(sample(docs, id_col, text_col, label_col, per_language), **options)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score in [0, 1]."""
    if model is None:
        return docs.withColumns({pred_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # landmarks x buckets and landmarks x languages numbers

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        m, names, scores = shared.value, [], []
        for _, run in in_runs(texts):  # a batch's texts are never all Python strings at once
            low = [t.lower() if t else "" for t in run.to_pylist()]
            for a in range(0, len(low), 64):
                part = low[a : a + 64]
                s = m.scores(part)
                best = s.argmax(axis=1)
                sure = 1 / (1 + np.exp(-3 * s[np.arange(len(part)), best]))
                for t, k, p in zip(part, best, sure, strict=True):
                    letters = any(map(str.isalpha, t))
                    names.append(m.languages[k] if letters else UNKNOWN)
                    scores.append(float(p) if letters else 0.0)
        give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # Not deterministic, for the optimiser: it would run the function again for each use of its result.
    once = of.asNondeterministic()
    judged = docs.select("*", once(docs[text_col].cast("string")).alias(free := free_name(docs, "__judged")))
    return judged.withColumns({pred_col: F.col(f"`{free}`.lang"), score_col: F.col(f"`{free}`.score")}).drop(free)


def training_rows(docs: DataFrame, id_col: str = "doc_id", modulus: int = 3, held_out: int = 1) -> DataFrame:
    return docs.where(bucket_of(F.col(id_col), modulus) != held_out)
