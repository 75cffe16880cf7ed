"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (one to three characters of the lower-cased text, everything but
letters read as one space), hashed to 2**16 places, weighted by TF-IDF: the n-gram's share of the
text in per cent times its inverse document frequency. Document frequencies are counted over all
learning rows. Weights are learned by follow-the-regularised-leader with elastic-net penalties on
a bounded sample: about ``per_language`` rows of each language, chosen by a hash of the id; at
most ``languages`` languages, the most frequent ones. A fifth of the sample is kept out of the
training and sets the temperature that calibrates the probabilities.

Learning rows have a language and an id outside fold 2 of 4. Whole texts are read, in learning
as in prediction; the language, source and id of a row are never inputs of its prediction. Null
text, or text without a letter, is ``und`` with score 0; so is every text if nothing was learned.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import add_columns, fold_of, own_names, read

PLACES = 1 << 16
ORDERS = 3
UNKNOWN = "und"
_MIX = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def ngrams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, repeats included; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint16)
    codes = np.where(letter, codes, np.uint32(32))
    space = np.r_[True, ~letter]
    codes = np.r_[np.uint32(32), codes[~(space[1:] & space[:-1])], np.uint32(32)]
    found, key = [], np.zeros(len(codes), np.uint32)
    for order in range(min(ORDERS, len(codes))):
        key = (key[: len(codes) - order] ^ codes[order:]) * _MIX[order]
        key ^= key >> np.uint32(15)
        found.append((key * _MIX[0] >> np.uint32(16)).astype(np.uint16))
    return np.concatenate(found)


def _frequencies(batches):
    """In how many texts each place occurs; place -1 counts the texts."""
    seen, times, texts = np.zeros(PLACES, bool), np.zeros(PLACES, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            places = ngrams(text)
            if len(places):
                seen[places] = True
                times += seen
                seen[:] = False
                texts += 1
    used = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[-1, used].astype(np.int32)), pa.array(np.r_[texts, times[used]])], names=["place", "n"]
    )


def _counted(batches):
    for batch in batches:
        rows = [np.unique(ngrams(t), return_counts=True) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([p.astype(np.int32).tobytes() for p, _ in rows], pa.binary()),
                pa.array([n.astype(np.int64).tobytes() for _, n in rows], pa.binary()),
                batch.column(2),
            ],
            names=["lang", "places", "counts", "draw"],
        )


@dataclass
class Model:
    """Languages, inverse frequencies times weights by row, the row of each place, bias, temperature."""

    languages: list[str]
    rows: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, places: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for at in range(0, len(places), 1 << 18):
            total += self.weights[self.rows[places[at : at + (1 << 18)]]].sum(axis=0, dtype=np.float64)
        return 100 * total / len(places) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        places = ngrams(text)
        if not len(places) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(places) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    epochs: int = 3,
    alpha: float = 0.1,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (places + 1 for the bias) by per-coordinate FTRL-proximal with both penalties."""
    z, n = np.zeros((PLACES + 1, classes)), np.zeros((PLACES + 1, classes))

    def weights(at):
        shrunk = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            places, x, y = examples[k]
            at, x = np.r_[places, PLACES], np.r_[x, 1.0]
            w = weights(at)
            miss = softmax(x @ w)
            miss[y] -= 1
            g = x[:, None] * miss
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    full = weights(slice(None))
    return full[:-1], full[-1]


def best_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    One error among ``n + 2`` rows is assumed, so a sample without errors gives no certainty.
    """
    if not len(truth):
        return 1.0
    doubt = 1 / (len(truth) + 2)
    target = np.full(logits.shape, doubt / max(1, logits.shape[1] - 1))
    target[np.arange(len(truth)), truth] = 1 - doubt

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    lo, hi, cut = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 500,
    languages: int = 256,
) -> Model:
    """Learn every language that occurs; more than ``languages`` of them raise, as the model would grow too large."""
    rows = docs.select(
        F.col(text).alias("text"),
        F.col(lang).cast("string").alias("lang"),
        fold_of(doc_id, 4).alias("fold"),
        F.pmod(F.xxhash64(F.col(doc_id), F.lit("language")), F.lit(1 << 31)).alias("draw"),
    ).filter("fold <> 2 and lang is not null")
    sizes = rows.groupBy("lang").count().limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages to learn")
    if not sizes:
        return Model([], np.zeros(PLACES, np.int32), np.zeros((1, 0), np.float32), np.zeros(0), 1.0)
    names = sorted(r["lang"] for r in sizes)
    counted = rows.select("text").mapInArrow(_frequencies, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    found = {r["place"]: r["n"] for r in counted.collect()}  # at most one row per place
    texts = found.pop(-1, 0)
    times = np.zeros(PLACES)
    times[list(found)] = list(found.values())
    idf = np.log((1 + texts) / (1 + times)) + 1

    rates = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1 << 31, (per_language << 31) // r["count"]))])
    drawn = rows.filter(F.col("draw") < rates[F.col("lang")]).select("lang", "text", "draw")
    sample = drawn.mapInArrow(_counted, "lang string, places binary, counts binary, draw bigint").collect()
    examples = []
    for r in sorted(sample, key=lambda r: (r["draw"], r["lang"], bytes(r["places"]), bytes(r["counts"]))):
        places, counts = np.frombuffer(r["places"], np.int32), np.frombuffer(r["counts"], np.int64)
        if len(places):
            examples.append((places, 100 * counts / counts.sum() * idf[places], names.index(r["lang"])))
    learn = [e for i, e in enumerate(examples) if i % 5]
    weights, bias = follow_the_leader(learn, len(names))
    rest = [e for i, e in enumerate(examples) if not i % 5]
    logits = np.array([x @ weights[p] + bias for p, x, _ in rest]).reshape(len(rest), len(names))
    temperature = best_temperature(logits, np.array([y for _, _, y in rest], int))
    used = np.flatnonzero(weights.any(axis=1))
    at = np.zeros(PLACES, np.int32)
    at[used] = np.arange(1, len(used) + 1)
    table = np.vstack([np.zeros((1, len(names))), weights[used] * idf[used, None]]).astype(np.float32)
    return Model(names, at, table, bias, temperature)


_FIELDS = [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())]


def with_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append the predicted language and its calibrated probability."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        found = [model.predict(t) for t in texts.to_pylist()]
        return [pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

    return add_columns(df, text, _FIELDS, compute)


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``."""
    model = train(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held_out: Column = fold_of("doc_id", 4) == 2
    return with_language(rows, model).select(
        "doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score")
    )


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised with score ``least`` or more."""
    known = (F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)
    own, at = own_names(docs)
    judged = with_language(own, train(own, at["doc_id"], at["text"], at["lang"]), at["text"])
    return judged.filter(known).select(*own.columns).toDF(*docs.columns)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(read(spark, folder, "documents", "doc_id", "text", "lang"))
