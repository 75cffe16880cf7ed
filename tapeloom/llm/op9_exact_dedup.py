"""Exact deduplication through counting quotient filters.

1. One pass over the texts writes a narrow table: id, 64-bit fingerprint, SHA-256 and length.
2. Every partition builds a counting quotient filter of its fingerprints, a part per block of high
   bits: quotients have an occupied bit, their remainders lie in sorted runs with run-end bits, and
   counts above one are counters in the slots after their remainder. The filters of all partitions
   meet per block and merge by their sorted remainders, adding counts. Nothing is lost: equal
   fingerprints, and only those, share an entry. An entry takes 6 to 7 bytes.
3. Fingerprints counted once are settled. Texts of all others are read again and compared byte
   for byte, by grouping on the normalised text itself; partial aggregation turns the copies
   inside a task into one row before anything moves.
4. Each group keeps the row with the most code points, then the smallest id.

Texts are equal when identical after deleting white space (space, tab to carriage return). Null
text counts as empty; empty texts are copies of each other. Rows that share an id and an equal
text are one repeated document and give one row. A null id sorts after all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import WHITE, add_columns, own_names, read, utf8
from tapeloom.plans.stage import written

#: High bits of a fingerprint name the block in which filters meet; the rest is quotient and remainder.
BLOCK_BITS = 12
KEY_BITS = 64 - BLOCK_BITS
#: Entries that wait before runs of a block are merged.
HELD = 1 << 18

_BASE = "cast(36893488147419103232 as decimal(20,0))"  # 2 ** 65


def _marks(text: pa.Array) -> list[pa.Array]:
    plain = [value.translate(None, WHITE) for value in utf8(text)]
    return [
        pa.array(np.array([xxhash.xxh64_intdigest(p) for p in plain], np.uint64).view(np.int64)),
        pa.array([hashlib.sha256(p).digest() for p in plain], pa.binary()),
        pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64()),
    ]


def _marks_and_text(text: pa.Array) -> list[pa.Array]:
    return [*_marks(text), pa.array([value.translate(None, WHITE) for value in utf8(text)], pa.binary())]


_MARKS = [
    T.StructField("__fp", T.LongType()),
    T.StructField("__sha", T.BinaryType()),
    T.StructField("__cp", T.LongType()),
]
_TEXT = T.StructField("__plain", T.BinaryType())


def with_marks(df: DataFrame, text: str = "text") -> DataFrame:
    """Append fingerprint, SHA-256 of the normalised text and code points of the original."""
    return add_columns(df, text, _MARKS, _marks)


def encode(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The counting quotient filter of rising ``keys`` (of ``KEY_BITS``) and their counts.

    With 2 ** q quotients and remainders of r bits: a byte q, occupied bits (one per quotient), run-end and
    counter bits (one per slot), then the slots. A quotient's run starts at the slot of its number, or where
    the run before it ends; a count above one goes, less one, into the slots after its remainder,
    which are marked as counters. Filters are built at once, so q makes them full: n entries have
    between n / 2 and n quotients.
    """
    q = min(max(len(keys).bit_length() - 1, 0), KEY_BITS - 32)
    r = KEY_BITS - q
    low = np.uint64((1 << r) - 1)
    quotients = (keys >> np.uint64(r)).astype(np.int64)
    sizes = 1 + (counts > 1) + (counts > 1 << r)
    before = np.cumsum(sizes) - sizes
    at = before + np.maximum.accumulate(quotients - before)
    n = int(at[-1] + sizes[-1])
    slots, flags, occupied = np.zeros(n, np.uint64), np.zeros((2, n), np.uint8), np.zeros(1 << q, np.uint8)
    slots[at] = keys & low
    for digit in (1, 2):
        more = np.flatnonzero(sizes > digit)
        slots[at[more] + digit] = (counts[more] - 1).astype(np.uint64) >> np.uint64(r * (digit - 1)) & low
        flags[1, at[more] + digit] = 1
    occupied[quotients] = 1
    last = np.flatnonzero(np.append(quotients[1:] != quotients[:-1], True))
    flags[0, at[last] + sizes[last] - 1] = 1
    bits = np.unpackbits(slots.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - r :]
    return bytes([q]) + np.packbits(np.concatenate([occupied, flags.ravel(), bits.ravel()])).tobytes()


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rising keys and counts of a filter, run by run."""
    q = data[0]
    r = KEY_BITS - q
    n = ((len(data) - 1) * 8 - (1 << q)) // (2 + r)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=1))
    occupied, ends, counter, packed = np.split(bits[: (1 << q) + n * (2 + r)], np.cumsum([1 << q, n, n]))
    wide = np.zeros((n, 64), np.uint8)
    wide[:, 64 - r :] = packed.reshape(n, r)
    slots = np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
    occupied, ends = np.flatnonzero(occupied), np.flatnonzero(ends)
    starts = np.maximum(occupied, np.append(0, ends[:-1] + 1))
    lengths = ends - starts + 1
    used = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    quotients, slots, counter = np.repeat(occupied, lengths).astype(np.uint64), slots[used], counter[used]
    head, digits = np.flatnonzero(counter == 0), np.flatnonzero(counter)
    entry = np.cumsum(counter == 0) - 1
    counts = np.ones(len(head), np.int64)
    shift = (digits - head[entry[digits]] - 1) * r
    np.add.at(counts, entry[digits], slots[digits].astype(np.int64) << shift)
    return quotients[head] << np.uint64(r) | slots[head], counts


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of all filters of a block as one, counts of equal keys added up."""
    keys, counts = (np.concatenate(part) for part in zip(*runs))
    order = np.argsort(keys, kind="stable")  # a merge sort that takes sorted stretches as they are
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def _filter(batches):
    """The counting quotient filter of one partition, a row per block."""
    prints = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
    if not sum(map(len, prints)):
        return
    values, counts = np.unique(np.concatenate(prints), return_counts=True)
    blocks = (values >> np.uint64(KEY_BITS)).astype(np.int32)
    keys = values & np.uint64((1 << KEY_BITS) - 1)
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    ends = np.append(starts[1:], len(values))
    for at in range(0, len(starts), 4096):
        part = list(zip(starts[at : at + 4096], ends[at : at + 4096]))
        packed = [encode(keys[a:b], counts[a:b]) for a, b in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks[starts[at : at + 4096]]), pa.array(packed, pa.binary())], names=["block", "filter"]
        )


def _merge(batches):
    """Fingerprints counted more than once; the filters of a block come one after the other.

    Runs wait until they have as many entries as what is merged already, so each entry is
    merged a few times only, and a task holds the entries of one block.
    """
    here, runs, waiting = None, [], 0

    def found():
        keys, counts = merged(runs)
        return keys[counts > 1] | np.uint64(here) << np.uint64(KEY_BITS)

    for batch in batches:
        out = []
        for block, data in zip(*(c.to_pylist() for c in batch.columns)):
            if block != here:
                if runs:
                    out.append(found())
                here, runs, waiting = block, [], 0
            runs.append(decode(data))
            waiting += len(runs[-1][0])
            if waiting > max(HELD, 2 * len(runs[0][0])):
                runs = [merged(runs)]
                waiting = len(runs[0][0])
        yield _prints(out)
    if runs:
        yield _prints([found()])


def _prints(parts):
    values = np.concatenate([np.empty(0, np.uint64), *parts])
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["__fp"])


def repeated_fingerprints(narrow: DataFrame) -> DataFrame:
    """Fingerprints that the merged filters count more than once."""
    filters = narrow.select("__fp").mapInArrow(_filter, "block int, filter binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "__fp bigint")


def verified_groups(docs: DataFrame, repeated: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(__sha, __keep, __size)`` of the texts behind ``repeated``, compared byte for byte."""
    full = add_columns(docs.select(doc_id, text), text, [*_MARKS, _TEXT], _marks_and_text).drop(text)
    # merged at every size, so that what is measured on a small table holds for a large one
    suspects = full.join(repeated.hint("merge"), "__fp", "left_semi")
    # one number orders by code points, then by smaller id, a null id last
    room = f"coalesce(cast(9223372036854775808 as decimal(20,0)) - cast(`{doc_id}` as decimal(20,0)), cast(0 as decimal(20,0)))"
    groups = suspects.groupBy("__plain", "__sha").agg(
        F.count(F.lit(1)).alias("__size"),
        F.max(F.expr(f"cast(__cp as decimal(12,0)) * {_BASE} + {room}")).alias("__best"),
    )
    left = F.expr(f"__best % {_BASE}")
    keep = F.when(left == 0, F.lit(None)).otherwise(F.expr("cast(9223372036854775808 as decimal(20,0))") - left)
    return groups.select("__sha", keep.cast("bigint").alias("__keep"), "__size")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``, and its rows ``n_rows``."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    narrow = written(with_marks(docs).drop("text", "__cp"), "fingerprints")
    groups = verified_groups(docs, repeated_fingerprints(narrow))
    rows = narrow.groupBy("doc_id", "__sha").agg(F.count(F.lit(1)).alias("__n"))
    found = rows.join(groups, "__sha", "left")
    single = F.col("__size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("__keep"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("__size", "__n").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
        F.col("__n").alias("n_rows"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay; repeated rows of the kept id give one."""
    own, at = own_names(docs)
    return _stay(own, at[doc_id], at[text]).toDF(*docs.columns)


def _stay(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    found = exact_duplicates(docs, doc_id, text)
    name = [F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__name"), "n_rows"]
    # rows to take out: those that go, and repeated ones, of which one comes back
    out = written(found.filter("not kept or n_rows > 1").select(*name, "kept"), "taken_out")
    again = written(out.filter("kept"), "repeated")
    marked = with_marks(docs, text)
    same = F.col(f"`{doc_id}`").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__name"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = marked.join(out.hint("merge"), same, "left_anti").select(*columns)
    order = F.struct(F.col("__cp"), F.col(text))
    repeated = marked.join(again, same, "left_semi")
    one = repeated.groupBy(F.col(doc_id).alias("__doc"), "__sha").agg(F.max_by(F.struct(*columns), order).alias("__row"))
    return rest.unionAll(one.select("__row.*"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(read(spark, folder, "documents", "doc_id", "text")).drop("n_rows")


SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain
  FROM documents
), r AS (
  SELECT doc_id, plain,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(plain) AS text_sha256 FROM r
"""
