"""SimHash near-duplicates with a pigeonring filter.

Fingerprints: a text is lower-cased (A-Z), cut into words at white space and into runs of three
words, joined by a space; a shorter text is one run. Bit ``j`` of the fingerprint is set when it
is set in more than half of the XXH64 values (seed 42) of the runs. No words: fingerprint zero.

Links: the 64 bits form a ring of five segments. If two fingerprints differ in at most two bits,
some segment starts a chain whose first ``l`` segments differ in at most ``2 * l / 5`` bits, for
every ``l``: budgets 0, 0, 1, 1, 2. So, from that start, two segments are equal, and of the next
two at least one is. Each distinct fingerprint is dealt out under these ten keys (38 or 39 equal
bits); inside a key the rest of the chain is tested before the full distance.

A key with many members is cut into blocks and every two blocks meet in a task of their own, so
no task holds an unbounded group. A task returns a spanning forest of its links, never all
pairs. Components of the forest edges are those of all links.

``near_duplicates`` links by these fingerprints. ``drop_near_duplicates`` does too unless it is
given a similarity; then its links and the MinHash bands of ``tapeloom.llm.shingles`` propose pairs of
texts, of which those stay whose sets of word shingles have that Jaccard similarity or more. Two of 64 bits
alone miss most pairs at 0.8.

Every row gets a result. Null text counts as empty. Rows that repeat an id are linked like any
others; a null id never names a component unless all ids in it are null.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import ROWS, add_columns, own_names, read, utf8
from tapeloom.llm.components import components
from tapeloom.llm.shingles import FIELDS, shingle_marks, with_shingles
from tapeloom.llm.shingles import links as shingle_links
from tapeloom.plans.stage import written

SEED, WORDS, BITS, REACH = 42, 3, 64, 2
#: Bounds of the ring's segments.
CUTS = [0, 13, 26, 39, 52, 64]
RING = len(CUTS) - 1
#: Members of one block of a crowded key.
BLOCK = 2048
#: Parts in which sets of one fingerprint are tied together.
SLOTS = 256


def _mask(segments: list[int]) -> int:
    mask = 0
    for s in segments:
        lo, hi = CUTS[s % RING], CUTS[s % RING + 1]
        mask |= ((1 << (hi - lo)) - 1) << lo
    return mask


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


#: Segments that are equal under each key: the start, the next, and one of the two after.
KEYS = [[start, start + 1, start + third] for start in range(RING) for third in (2, 3)]
MASKS = np.array([_mask(k) for k in KEYS], np.uint64)
#: Of each key's chain: masks of its first three and four segments, and their budgets.
CHAINS = [[(np.uint64(_mask(list(range(k[0], k[0] + l)))), REACH * l // RING) for l in (3, 4)] for k in KEYS]


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total, ones = max(1, len(words) - WORDS + 1), np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, 1 << 16):
        to = min(total, at + (1 << 16))
        last = ends[at + WORDS - 1 : to + WORDS - 1] or [ends[-1]]
        hashes = np.array([digest(joined[a : z - 1], SEED) for a, z in zip(starts[at:to], last)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _prints(text: pa.Array) -> list[pa.Array]:
    return [pa.array(np.array([fingerprint(t) for t in utf8(text)], np.uint64).view(np.int64))]


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    return add_columns(df, text, [T.StructField("__fp", T.LongType())], _prints)


def near(a: np.ndarray, b: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of ``a`` and ``b`` within reach; the chain prunes before the full check."""
    apart = a[:, None] ^ b[None, :]
    open_ = np.ones(apart.shape, bool)
    for mask, budget in CHAINS[key]:
        open_ &= np.bitwise_count(apart & mask) <= budget
    i, j = np.nonzero(open_)
    within = np.bitwise_count(apart[i, j]) <= REACH
    return i[within], j[within]


def forest(members: np.ndarray, key: int) -> list[tuple[int, int]]:
    """Edges that connect the members as all their links do."""
    edges, rest = [], members
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = front[:256]
            i, j = near(step, rest, key)
            reached, first = np.unique(j, return_index=True)
            edges += zip(step[i[first]].view(np.int64).tolist(), rest[reached].view(np.int64).tolist())
            front = np.concatenate([front[256:], rest[reached]])
            rest = np.delete(rest, reached)
    return edges


def _forests(batches):
    """Forest edges of each run of equal (key, bits, lo, hi); rows come sorted by these."""
    here, held = None, []
    for batch in batches:
        keys = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]) if batch.num_rows else np.empty((0, 4))
        values = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
        edges = []
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            group = tuple(keys[a])
            if group != here:
                if held:
                    edges += forest(np.concatenate(held), here[0])
                here, held = group, []
            held.append(values[a:b])
        if edges:
            yield _links(edges)
    if held:
        yield _links(forest(np.concatenate(held), here[0]))


def _links(edges):
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Forest links ``(a, b)`` between the distinct fingerprints ``__fp``."""
    masks = F.array(*[F.lit(_signed(int(m))) for m in MASKS])
    keyed = prints.select(F.posexplode(masks).alias("key", "__mask"), "__fp").select(
        "key", F.col("__fp").bitwiseAND(F.col("__mask")).alias("bits"), "__fp"
    )
    sizes = keyed.groupBy("key", "bits").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    blocks = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    dealt = keyed.join(sizes, ["key", "bits"]).withColumn("__blocks", blocks)
    dealt = dealt.withColumn("__own", F.pmod(F.xxhash64("__fp", "key"), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    pairs = dealt.select(
        "key", "bits", F.least("__own", "__other").alias("lo"), F.greatest("__own", "__other").alias("hi"), "__fp"
    )
    runs = pairs.repartition("key", "bits", "lo", "hi").sortWithinPartitions("key", "bits", "lo", "hi")
    return runs.mapInArrow(_forests, "a bigint, b bigint")


def classes(narrow: DataFrame) -> DataFrame:
    """``(__fp, __first, __root)`` of each distinct fingerprint of ``narrow(doc_id, __fp)``."""
    distinct = written(narrow.groupBy("__fp").agg(F.min("doc_id").alias("__first")), "fingerprints")
    return _classes(distinct, links(distinct))


def _classes(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    # XXH64 maps 64-bit integers one to one, so its values name the fingerprints
    found = components(linked.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    named = distinct.withColumn("node", F.xxhash64("__fp"))
    return named.join(found, "node", "left").select("__fp", "__first", F.coalesce("root", "node").alias("__root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    narrow = written(with_fingerprint(docs).drop("text"), "marked")
    by_print = written(classes(narrow), "classes")
    roots = by_print.groupBy("__root").agg(F.min("__first").alias("component_id"))
    named = by_print.join(roots, "__root").select("__fp", "component_id")
    return narrow.join(named, "__fp").select(
        "doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _print_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets(__fp, __print)`` that fingerprint links propose: every set is tied to one of its
    own fingerprint, and such sets to each other as ``links`` ties the fingerprints. They are still to be checked."""
    slot = F.pmod(F.xxhash64("__fp"), F.lit(SLOTS))  # many sets of one fingerprint must not all meet one of them
    parts = written(sets.groupBy("__print", slot.alias("__slot")).agg(F.min("__fp").alias("__part")), "print_parts")
    prints = written(parts.groupBy("__print").agg(F.min("__part").alias("__own")), "prints")
    linked = links(prints.select(F.col("__print").alias("__fp")))
    of_a = prints.select(F.col("__print").alias("a"), F.col("__own").alias("__a"))
    of_b = prints.select(F.col("__print").alias("b"), F.col("__own").alias("__b"))
    tied = linked.join(of_a, "a").join(of_b, "b").select("__a", "__b")
    within = parts.join(prints, "__print").select(F.col("__own").alias("__a"), F.col("__part").alias("__b"))
    members = sets.withColumn("__slot", slot).join(parts, ["__print", "__slot"]).select(F.col("__part").alias("__a"), F.col("__fp").alias("__b"))
    ends = tied.unionAll(within).unionAll(members)
    return ends.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).filter("a < b").distinct()


def _with_marks(df: DataFrame, text: str, words: int) -> DataFrame:
    """Append fingerprint (``__print``), shingle set name and bands in one pass: a second pass over the texts would
    be a second Python worker beside each task's first."""
    fields = [T.StructField("__print", T.LongType()), *(T.StructField(name, FIELDS[name]) for name in ("__fp", "__bands"))]
    sets = shingle_marks(words, "__fp", "__bands")
    return add_columns(df, text, fields, lambda texts: [*_prints(texts), *sets(texts)])


def _similar(docs: DataFrame, doc_id: str, text: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, __fp)`` of each row and the classes of similar shingle sets, as ``classes`` gives them.

    Fingerprint links and shared bands propose pairs; each is checked on the whole sets.
    """
    rows = _with_marks(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text), text, words)
    narrow = written(rows.select("doc_id", "__fp", "__bands", "__print"), "marked", ROWS)
    # texts of one set may differ in their repeats, so in their fingerprints
    prints = narrow.select("__fp", "__print").distinct()
    sets = narrow.groupBy("__fp").agg(F.min("doc_id").alias("__first"), F.first("__bands").alias("__bands"))
    distinct = written(sets, "shingle_sets")
    proposed = written(_print_pairs(prints), "print_pairs")
    found = _classes(distinct.drop("__bands"), shingle_links(docs, distinct, text, words, similarity, proposed=proposed))
    return narrow.drop("__bands", "__print"), found


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None, words: int = 5
) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the smallest id.

    With a ``similarity``, components are those of shingles of ``words`` words at that similarity.
    """
    own, at = own_names(docs)
    return _stay(own, at[doc_id], at[text], similarity, words).toDF(*docs.columns)


def _stay(docs: DataFrame, doc_id: str, text: str, similarity: float | None, words: int) -> DataFrame:
    if similarity is None:
        marked = with_fingerprint(docs, text)
        narrow = written(marked.select(F.col(doc_id).cast("bigint").alias("doc_id"), "__fp"), "marked")
        named = classes(narrow)
    else:
        marked = with_shingles(docs, text, words, "__fp")
        narrow, named = _similar(docs, doc_id, text, words, similarity)
    best = F.min(F.struct(F.col("__first").isNull().alias("late"), "__first", "__fp")).alias("__best")
    kept = named.groupBy("__root").agg(best).select(
        F.col("__best.__first").alias("__id"), F.col("__best.__fp").alias("__kept")
    )
    rows = narrow.groupBy("doc_id", "__fp").agg(F.count(F.lit(1)).alias("__n"))
    stays = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__kept"))
    judged = rows.join(kept, stays, "left").select("doc_id", F.col("__fp").alias("__name"), "__n", F.col("__kept").isNotNull().alias("__stays"))
    # rows to take out: those that go, and repeated ones, of which one comes back
    out = written(judged.filter("not __stays or __n > 1").withColumnRenamed("doc_id", "__id"), "taken_out")
    again = written(out.filter("__stays"), "repeated")
    same = F.col(f"`{doc_id}`").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__name"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = marked.join(out.hint("merge"), same, "left_anti").select(*columns)
    repeated = marked.join(again, same, "left_semi")
    row = F.min_by(F.struct(*columns), F.struct(F.col(text))).alias("__row")
    one = repeated.groupBy(F.col(doc_id).alias("__doc"), "__fp").agg(row)
    return rest.unionAll(one.select("__row.*"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents", "doc_id", "text"))
