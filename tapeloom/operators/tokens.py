"""Where a decoded token stream ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Decoding limits.
MAX_TOKENS = 64
REPEAT_LIMIT = 4


def cut_token_stream(
    tokens: DataFrame, end_token: int | str, max_tokens: int = MAX_TOKENS,
    repeat_limit: int = REPEAT_LIMIT, special: list | None = None, limit: str | None = None,
) -> DataFrame:
    """Tokens kept per clip, with why the stream stopped.

    ``tokens`` holds (clip_id, step, token) with unique steps from 0. Steps at or past
    ``max_tokens`` can never be kept, so a clip brings at most that many rows to its
    window. The end token is dropped, the token that completes a repeat is kept. ``limit`` may
    name a column with a lower limit per clip, such as the room that a prompt leaves in the context.
    """
    if max_tokens <= 0:
        raise ValueError("the limit of decoded tokens must be above zero")
    by_step = Window.partitionBy("clip_id").orderBy("step")
    room = F.lit(max_tokens) if limit is None else F.least(F.lit(max_tokens), F.greatest(F.col(limit), F.lit(0)))
    near = tokens.filter((F.col("step") >= 0) & (F.col("step") < room))
    same = F.lit(repeat_limit >= 2)
    for back in range(1, repeat_limit):
        same = same & F.coalesce(F.lag("token", back).over(by_step) == F.col("token"), F.lit(False))
    marked = near.withColumn("collapsed", same)
    whole = Window.partitionBy("clip_id")
    stops = marked.withColumn(
        "end_at", F.min(F.when(F.col("token") == end_token, F.col("step"))).over(whole)
    ).withColumn("repeat_at", F.min(F.when(F.col("collapsed"), F.col("step"))).over(whole))
    end_first = F.col("end_at").isNotNull() & (F.col("repeat_at").isNull() | (F.col("end_at") < F.col("repeat_at")))
    reason = (
        F.when(end_first, "end_of_text")
        .when(F.col("repeat_at").isNotNull(), "repeated_token_collapse")
        .otherwise("max_decode_tokens")
    )
    keep = F.when(end_first, F.col("step") < F.col("end_at")).otherwise(
        F.col("repeat_at").isNull() | (F.col("step") <= F.col("repeat_at"))
    )
    kept = stops.select("clip_id", "step", "token", reason.alias("stop_reason"), keep.alias("keep")).filter("keep")
    if special:
        kept = kept.filter(~F.col("token").isin(*special))
    return kept.drop("keep")


def stop_reasons(
    tokens: DataFrame, end_token: int | str, max_tokens: int = MAX_TOKENS, repeat_limit: int = REPEAT_LIMIT
) -> DataFrame:
    """Per clip: tokens kept and the stop reason, also for clips that end at once."""
    cut = cut_token_stream(tokens, end_token, max_tokens, repeat_limit)
    kept = cut.groupBy("clip_id").agg(F.count("*").alias("n_tokens"), F.first("stop_reason").alias("stop_reason"))
    return (
        tokens.select("clip_id").distinct().join(kept, "clip_id", "left")
        .select(
            "clip_id", F.coalesce("n_tokens", F.lit(0).cast("bigint")).alias("n_tokens"),
            F.coalesce("stop_reason", F.lit("end_of_text")).alias("stop_reason"),
        )
    )
