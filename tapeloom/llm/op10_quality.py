"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded: shares of character
classes, word lengths, repeated and distinct words, capitals, then a learned tanh layer. Gated
attention (Ilse, Tomczak and Welling, 2018) weighs the passages, and a logistic unit scores the
weighted sum. Only the labels of whole documents are given; the weights of passages are learned
from them by gradient descent (Adam) on a bounded sample, about ``per_class`` labelled documents
of each class chosen by a hash of the id. Each class counts in the loss by its true share, so a
score is a probability.

Labels of fold 1 of 3 are never read. Labels, language, source and id are no inputs of a score.
Whole texts are scored; null and empty texts are a bag of one empty passage. A document labelled
twice counts as labelled 1 if any label says so. Without labels of both classes every score is
the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import add_columns, fold_of, read

WORDS = 64
CLASSES = 13
FEATURES = CLASSES + 9
ENCODED, GATED = 16, 8
#: Code points that are encoded at once; a longer text is cut at a passage's end.
PART = 1 << 20


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: letters by case, digits, blanks, line breaks, common signs, the rest."""
    signs = {" ": 3, "\n": 4, "\r": 4, ".": 5, ",": 6, "!": 7, "|": 8, **dict.fromkeys("#$%&*@^~+=<>\\/_", 9)}
    kinds = {"Ll": 0, "Lu": 1, "Nd": 2, "Lo": 11, "Lt": 1, "Lm": 11, "Zs": 3}
    return np.array(
        [signs.get(chr(c), kinds.get(k := unicodedata.category(chr(c)), 10 if k[0] in "PS" else 12)) for c in range(0x110000)],
        np.uint8,
    )


def _per(count: int, which: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(which, weights, count)


def passages(text: str) -> np.ndarray:
    """Feature vectors of a text's passages, at least one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _classes()[codes]
    blank = (kinds == 3) | (kinds == 4) | (codes == 9)
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(codes) else np.empty(0, int)
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    word_of = np.maximum(np.cumsum(~blank & np.r_[True, blank[:-1]]) - 1, 0)
    at = np.arange(len(codes)) - starts[word_of]
    words, count = len(starts), -(-len(starts) // WORDS)
    passage, of_char = np.arange(words) // WORDS, word_of // WORDS
    size = _per(words, word_of, ~blank)
    mixed = (codes * np.uint32(0x9E3779B1)) ^ (at.astype(np.uint32) * np.uint32(0x85EBCA77))
    mixed = np.where(blank, np.uint32(0), mixed * np.uint32(0xC2B2AE3D))
    names = np.add.reduceat(mixed, starts, dtype=np.uint32)
    upper = _per(words, word_of, kinds == 1)
    same = [np.r_[np.zeros(min(lag, words), bool), names[lag:] == names[:-lag]] for lag in (1, 2)]
    distinct = np.unique(passage.astype(np.uint64) << np.uint64(32) | names)
    chars, n = _per(count, of_char), _per(count, passage)
    mean = _per(count, passage, size) / n
    shares = np.bincount(of_char * CLASSES + kinds, minlength=count * CLASSES).reshape(count, CLASSES) / chars[:, None]
    rest = [
        mean / 10,
        np.sqrt(np.maximum(_per(count, passage, size * size) / n - mean * mean, 0)) / 10,
        *(_per(count, passage, s) / n for s in same),
        _per(count, (distinct >> np.uint64(32)).astype(int)) / n,
        _per(count, passage, (upper > 0) & (kinds[starts] == 1)) / n,
        _per(count, passage, upper >= np.maximum(size - 3, 2)) / n,
        np.log1p(n) / 4,
        np.ones(count),
    ]
    return np.column_stack([shares, *rest]).astype(np.float32)


def bag(text: str | None) -> np.ndarray:
    text, found = text or "", []
    while len(text) > PART:
        cut = max(text.rfind(" ", 0, PART) + 1, text.rfind("\n", 0, PART) + 1) or PART
        found.append(passages(text[:cut]))
        text = text[cut:]
    return np.concatenate([*found, passages(text)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    share: float

    def score(self, rows: np.ndarray) -> float:
        if not self.parts:
            return self.share
        return float(_forward(self.parts, (rows - self.mean) / self.scale, np.array([0]))["p"][0])


def _forward(w: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    """Bags lie one after the other; ``starts`` has the first passage of each."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"] + w["v"]), _sigmoid(h @ w["U"] + w["u"])
    gate = (t * s) @ w["a"]
    sizes = np.diff(np.r_[starts, len(x)])
    top = np.repeat(np.maximum.reduceat(gate, starts), sizes)
    power = np.exp(gate - top)
    weight = power / np.repeat(np.add.reduceat(power, starts), sizes)
    z = np.add.reduceat(weight[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "p": _sigmoid(z @ w["c"] + w["d"]), "sizes": sizes}


def _gradient(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict:
    f = _forward(w, x, starts)
    h, t, s, weight, sizes = f["h"], f["t"], f["s"], f["weight"], f["sizes"]
    miss = (f["p"] - y) * importance / importance.sum()
    dz = np.repeat(miss, sizes)[:, None] * w["c"]
    pull = (dz * h).sum(axis=1)
    dgate = weight * (pull - np.repeat(np.add.reduceat(weight * pull, starts), sizes))
    dt, ds = dgate[:, None] * w["a"] * s * (1 - t * t), dgate[:, None] * w["a"] * t * s * (1 - s)
    dh = (weight[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ ds, "u": ds.sum(0),
        "a": (t * s).T @ dgate, "c": f["z"].T @ miss, "d": miss.sum(),
    }


def learn(bags: list[np.ndarray], y: np.ndarray, importance: np.ndarray, steps: int = 600, batch: int = 256) -> Model:
    rng = np.random.default_rng(11)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    shapes = {
        "W": (FEATURES, ENCODED), "b": (ENCODED,), "V": (ENCODED, GATED), "v": (GATED,), "U": (ENCODED, GATED), "u": (GATED,),
        "a": (GATED,), "c": (ENCODED,), "d": (),
    }
    w = {k: rng.normal(0, 0.3, shape) if k in "WVUac" else np.zeros(shape) for k, shape in shapes.items()}
    m, v = ({k: np.zeros(shape) for k, shape in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(bags), min(batch, len(bags)))
        starts = np.r_[0, np.cumsum([len(bags[i]) for i in pick])[:-1]]
        g = _gradient(w, np.concatenate([bags[i] for i in pick]), starts, y[pick], importance[pick])
        rate = 0.02 * (1 - step / (steps + 1))
        for k in w:
            slope = g[k] + 1e-4 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * slope
            v[k] = 0.999 * v[k] + 0.001 * slope**2
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, float(np.average(y, weights=importance)))


def _bags(batches):
    for batch in batches:
        rows = [bag(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "bag"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``."""
    rows = labels.filter((fold_of("doc_id", 3) != 1) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    marked = rows.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 31))
    limit = F.when(F.col("quality") == 1, min(1 << 31, (per_class << 31) // max(1, sizes.get(1, 0)))).otherwise(
        min(1 << 31, (per_class << 31) // max(1, sizes.get(0, 0)))
    )
    drawn = {r["doc_id"]: r["quality"] for r in marked.filter(draw < limit).collect()}  # about two per_class
    texts = docs.filter(F.col("doc_id").isin(list(drawn))).select("doc_id", "text")
    found = texts.mapInArrow(_bags, "doc_id bigint, bag binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in found]
    y = np.array([drawn[r["doc_id"]] for r in found], float)
    if not 0 < y.sum() < len(y):
        none = np.zeros(FEATURES)
        return Model(none, none + 1, {}, share)
    return learn(bags, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))


def with_score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([model.score(bag(t)) for t in texts.to_pylist()], pa.float64())]

    return add_columns(df, text, [T.StructField("score", T.DoubleType())], compute)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
    rows = with_score(docs, train(docs, labels)).drop("text")
    return rows.select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return scored(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "labels", "doc_id", "quality"))
