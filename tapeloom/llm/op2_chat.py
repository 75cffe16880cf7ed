"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A log often holds a conversation many times, each time a few turns longer. The turns of each
conversation are numbered in order, and a rolling hash covers every prefix: the exclusive or of
two 64-bit hashes of (number, role, text), so the hash of a prefix depends on all its turns and
their places. A conversation that equals a prefix of a longer one is removed by an anti-join on
length and hash; of conversations with equal turns the one with the smallest id stays. What is
left is rendered.

Numbering and hashing are ordered scans cut into buckets of turns, so a conversation of any
length is shared by many tasks, and rendered text comes in pieces of at most ``PIECE`` turns:
``conv_id, piece, n_turns, rendered``. The pieces of a conversation in order are its text.

Order: turn, then role, then text; a null turn comes first, a null role or text counts as empty.
Rows without a conversation id belong to no conversation and are left out; repeated rows are
turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import read
from tapeloom.plans.stage import written

PIECE = 256
START, END = "<|im_start|>", "<|im_end|>"
FIRST = -(1 << 62)


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, at, role, text`` with turns numbered from 0, ``one`` and ``two`` the hashes of the prefix."""
    rows = turns.filter("conv_id is not null").select(
        "conv_id",
        F.coalesce(F.col("turn").cast("bigint"), F.lit(FIRST)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = written(rows.withColumn("bucket", F.floor(F.col("turn") / PIECE)), "turns")
    # how many turns, and which hash, each bucket takes over from those before it
    counts = rows.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("conv_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text")
    local = rows.withColumn("at", F.row_number().over(inside) - 1)
    placed = local.join(offsets, ["conv_id", "bucket"]).withColumn("at", F.col("at") + F.col("offset")).drop("offset")
    hashed = placed.withColumn("one", _turn_hash(0)).withColumn("two", _turn_hash(1))
    hashed = written(hashed, "hashed")
    sums = hashed.groupBy("conv_id", "bucket").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    carry = [F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("bigint")).alias(f"__{c}") for c in ("one", "two")]
    carried = written(sums.select("conv_id", "bucket", *carry), "carried")
    run = Window.partitionBy("conv_id", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolling = hashed.select("conv_id", "bucket", "at", "role", "text", *[F.bit_xor(c).over(run).alias(c) for c in ("one", "two")])
    joined = rolling.join(carried, ["conv_id", "bucket"])
    return joined.select(
        "conv_id", "at", "role", "text", *[F.col(c).bitwiseXOR(F.col(f"__{c}")).alias(c) for c in ("one", "two")]
    )


def _turn_hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("at").cast("bigint"), F.col("role"), F.lit(salt), F.col("text"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are no prefix of a longer one."""
    narrow = prefixes.select("conv_id", (F.col("at") + 1).alias("n_turns"), "one", "two")
    last = narrow.groupBy("conv_id").agg(F.max(F.struct("n_turns", "one", "two")).alias("last"))
    ends = written(last.select("conv_id", "last.*"), "ends")
    one_each = ends.groupBy("n_turns", "one", "two").agg(F.min("conv_id").alias("conv_id"))
    inner = narrow.join(ends.select("conv_id", F.col("n_turns").alias("full")), "conv_id").filter("n_turns < full")
    known = inner.select("n_turns", "one", "two").distinct()
    return one_each.join(known, ["n_turns", "one", "two"], "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame) -> DataFrame:
    """Pieces of rendered text from ``conv_id, at, role, text``."""
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    listed = turns.groupBy("conv_id", F.floor(F.col("at") / PIECE).cast("bigint").alias("piece")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", piece.alias("piece")))).alias("turns")
    )
    return listed.select("conv_id", "piece", "n_turns", F.array_join("turns.piece", "").alias("rendered"))


def chats(turns: DataFrame) -> DataFrame:
    prefixes = written(numbered(turns), "prefixes")
    kept = written(maximal(prefixes).select("conv_id"), "kept")
    return render(prefixes.join(kept, "conv_id", "left_semi"))


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chats(read(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, {FIRST}), coalesce(role, ''), coalesce(text, '')) - 1 AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, n, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY n) AS prefix FROM t
), f AS (
  SELECT conv_id, max(n) AS n, max_by(prefix, n) AS whole FROM p GROUP BY conv_id
), k AS (
  SELECT whole, n, min(conv_id) AS conv_id FROM f GROUP BY whole, n
), i AS (
  SELECT DISTINCT p.prefix FROM p JOIN f USING (conv_id) WHERE p.n < f.n
), m AS (
  SELECT conv_id FROM k WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.prefix = k.whole)
)
SELECT conv_id, CAST(n // {PIECE} AS BIGINT) AS piece, count(*) AS n_turns,
       string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' ORDER BY n) AS rendered
FROM t SEMI JOIN m USING (conv_id) GROUP BY ALL
"""
