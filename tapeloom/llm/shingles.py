"""Near copies by the Jaccard similarity of word shingles, every link checked on the whole sets.

A text is lower-cased (A-Z), cut into words at white space and into runs of ``words`` words; a
shorter text is one run. Its set of XXH64 values (seed 42) is named by a digest, so texts of one
set are one node.

Candidates: ``BANDS`` bands of ``ROWS`` least values (MinHash). A pair of similarity ``s`` shares
no band with probability ``(1 - s ** ROWS) ** BANDS``: 3e-6 at 0.8, less above. Only nodes that
share a band are read again for their sets. Members of a band with few of them meet pair by pair.
A crowded band is cut into blocks and every two blocks meet in a task of their own, which returns
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import ROWS as TEXTS
from tapeloom.llm.common import add_columns, utf8
from tapeloom.plans.stage import written

SEED, BANDS, ROWS = 42, 24, 4
#: Members of a band that meet pair by pair.
FEW = 8
#: Set members of one block of a crowded band.
BLOCK = 1 << 19
_RNG = np.random.default_rng(SEED)
FLIPS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
FACTORS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's word runs, sorted."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = list(accumulate(len(w) + 1 for w in parts))
    last = ends[words - 1 :] or [ends[-1]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : z - 1], SEED) for a, z in zip([0, *ends], last)), np.uint64, len(last)))


def _name(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), SEED)


def bands(values: np.ndarray) -> np.ndarray:
    """A value per band; equal values mean equal least hashes. An empty set has none."""
    if not len(values):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), 4096):
        least = np.minimum(least, ((values[at : at + 4096] ^ FLIPS) * FACTORS).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)))


FIELDS = {"__fp": T.LongType(), "__bands": T.ArrayType(T.LongType()), "__set": T.ArrayType(T.LongType())}


def shingle_marks(words: int, *outputs: str) -> Callable[[pa.Array], list[pa.Array]]:
    """What makes the named columns of ``FIELDS`` from a column of texts."""

    def compute(column: pa.Array) -> list[pa.Array]:
        sets = [shingles(t, words) for t in utf8(column)]
        make = {
            "__fp": lambda: pa.array(np.array([_name(s) for s in sets], np.uint64).view(np.int64)),
            "__bands": lambda: _lists([bands(s) for s in sets]),
            "__set": lambda: _lists(sets),
        }
        return [make[name]() for name in outputs]

    return compute


def with_shingles(df: DataFrame, text: str, words: int, *outputs: str) -> DataFrame:
    """Append the name of each text's shingle set (``__fp``), its ``__bands`` or the ``__set`` itself."""
    return add_columns(df, text, [T.StructField(name, FIELDS[name]) for name in outputs], shingle_marks(words, *outputs))


def forest(names: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect the members as all their links do."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    found, places = np.unique(np.concatenate(sets), return_inverse=True)
    here, open_, edges = np.zeros(len(found), np.int32), np.ones(len(sets), bool), []
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start], front = False, [start]
        while front and open_.any():
            x = front.pop()
            own = places[starts[x] : starts[x] + sizes[x]]
            here[own] = 1
            shared = np.add.reduceat(here[places], starts)
            here[own] = 0
            reached = np.flatnonzero(open_ & (shared / (sizes + sizes[x] - shared) >= similarity))
            open_[reached] = False
            edges += [(int(names[x]), int(names[y])) for y in reached]
            front += reached.tolist()
    return edges


def _forests(similarity: float):
    def run(batches):
        """Rows of a group follow each other."""
        here, names, sets = None, [], []

        def edges():
            made = list(dict(zip(names, sets)).items())
            found = forest(np.array([m[0] for m in made]), [m[1] for m in made], similarity) if len(made) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            fps, lists = batch.column(3).to_pylist(), batch.column(4)
            for i, key in enumerate(keys):
                if key != here:
                    if names:
                        yield edges()
                    here, names, sets = key, [], []
                names.append(fps[i])
                sets.append(lists[i].values.to_numpy())
        if names:
            yield edges()

    return run


def links(
    docs: DataFrame, distinct: DataFrame, text: str, words: int, similarity: float, few: int = FEW, block: int = BLOCK,
    proposed: DataFrame | None = None,
) -> DataFrame:
    """Links ``(a, b)`` that connect the sets ``distinct(__fp, __bands)`` of ``docs`` as all similar pairs do.

    ``proposed(a, b)``, with a < b, are pairs to check beside those that share a band.
    """
    keyed = distinct.select("__fp", F.explode("__bands").alias("band"))
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    shared = written(keyed.join(sizes, "band"), "shared_bands")
    suspects = shared.select("__fp")
    if proposed is not None:
        suspects = suspects.unionByName(proposed.select(F.explode(F.array("a", "b")).alias("__fp")))
    suspects = suspects.distinct()
    texts = with_shingles(docs.select(F.col(text).alias("__text")), "__text", words, "__fp")
    again = texts.join(suspects.hint("merge"), "__fp", "left_semi").groupBy("__fp").agg(F.first("__text").alias("__text"))
    sets = written(with_shingles(again, "__text", words, "__set").drop("__text"), "suspect_sets", TEXTS)

    one = shared.filter(F.col("__n") <= few).select("band", F.col("__fp").alias("a"))
    two = one.select("band", F.col("a").alias("b"))
    pairs = one.join(two, "band").filter("a < b").select("a", "b")
    if proposed is not None:
        pairs = pairs.unionByName(proposed)
    pairs = pairs.distinct()
    sets_a = sets.select(F.col("__fp").alias("a"), F.col("__set").alias("__a"))
    sets_b = sets.select(F.col("__fp").alias("b"), F.col("__set").alias("__b"))
    both = pairs.join(sets_a.hint("merge"), "a").join(sets_b.hint("merge"), "b")
    common = F.size(F.array_intersect("__a", "__b"))
    total = F.size("__a") + F.size("__b")
    apart = both.filter(common / (total - common) >= F.lit(similarity)).select("a", "b")

    crowded = shared.filter(F.col("__n") > few).join(sets.hint("merge"), "__fp")
    lots = crowded.groupBy("band").agg(F.ceil(F.sum(F.size("__set")) / F.lit(block)).cast("int").alias("__blocks"))
    dealt = crowded.join(lots, "band").withColumn("__own", F.pmod(F.xxhash64("__fp", "band"), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    met = dealt.select("band", F.least("__own", "__other").alias("lo"), F.greatest("__own", "__other").alias("hi"), "__fp", "__set")
    runs = met.repartition(F.xxhash64("band", "lo", "hi")).sortWithinPartitions("band", "lo", "hi")
    return apart.unionByName(runs.mapInArrow(_forests(similarity), "a bigint, b bigint"))
