"""Token counts behind a digest cache.

A count depends on the content and on the tokenizer, so the cache is a Parquet table keyed by the
SHA-256 of the normalised content and the SHA-256 of the tokenizer's version: library, its
release and the model's bytes. Normalising may not change a count; it turns null into the empty
text and text into UTF-8 bytes, nothing else.

1. Texts are brought together by digest, copies inside a task becoming one row before they move.
2. Digests that the cache has are dropped by an anti-join; the rest, each distinct text once, are
   encoded and appended to the cache.
3. Every row takes its count from the cache by its digest.

A job that is repeated, or two that run at once, may append a count twice; readers take one row
per digest. Appends are committed by Spark, so a lost executor leaves no partial rows.

Counts are those of the library for a whole text, without begin, end or added special tokens,
not cut or padded: tokenizers for ``.json``, sentencepiece for ``.model``. A null id is kept.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import add_columns, in_bytes, read, utf8
from tapeloom.plans.stage import written
from tapeloom.session import fresh_folder

LIMIT = 4096
CALL_BYTES = 1 << 20
CACHE_DDL = "content binary, n_tokens bigint, version string"


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str, model: bytes) -> str:
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {version(library)} ".encode() + model).hexdigest()


@lru_cache(4)
def _counter(kind: str, model: bytes):
    if kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    built = Tokenizer.from_buffer(model)
    built.no_truncation()
    built.no_padding()
    return lambda texts: [len(e.ids) for e in built.encode_batch_fast(texts, add_special_tokens=False)]


def _digests(text: pa.Array) -> list[pa.Array]:
    rows = utf8(text)
    return [
        pa.array([hashlib.sha256(r).digest() for r in rows], pa.binary()),
        pa.array([len(r) for r in rows], pa.int64()),
    ]


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    fields = [T.StructField("content", T.BinaryType()), T.StructField("n_bytes", T.LongType())]
    return add_columns(df, text, fields, _digests)


def read_cache(spark: SparkSession, cache: str, digest: str) -> DataFrame:
    """One row per content that the cache has for a tokenizer version; none if there is no cache yet."""
    try:
        rows = spark.read.schema(CACHE_DDL).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_DDL)
    return rows.filter(F.col("version") == digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, cache: str, path: str, text: str = "text") -> str:
    """Count what the cache lacks, append it, and return the tokenizer's version digest."""
    spark, model = docs.sparkSession, Path(path).read_bytes()
    digest, kind = version_digest(path, model), path.rpartition(".")[2]

    def count(batches):
        run = _counter(kind, model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [n for a, b in in_bytes(texts, len, CALL_BYTES) for n in run(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    marked = with_digest(docs.select(F.col(text).alias("text"))).drop("n_bytes")
    distinct = marked.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, digest), "content", "left_anti")
    counted = misses.mapInArrow(count, "content binary, n_tokens bigint")
    counted.withColumn("version", F.lit(digest)).write.mode("append").parquet(cache)
    return digest


def token_counts(
    docs: DataFrame,
    cache: str,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``."""
    path = path or tokenizer_file()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    digest = fill_cache(rows, cache, path)
    narrow = written(with_digest(rows).drop("text"), "digests")
    # written, so that the join can split a content that very many rows share
    counts = written(read_cache(docs.sparkSession, cache, digest), "counts")
    counted = narrow.join(counts, "content")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents", "doc_id", "text"), fresh_folder(spark, "token-cache"))
