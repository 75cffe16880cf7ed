"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed field by field and rebuilt: the normaliser with its character map,
the metaspace marker and dummy prefix, unigram scores or the merges that BPE scores imply, and
byte fallback. Batches are encoded by several threads. Every text is also encoded by the
sentencepiece library itself, and ``parity`` says whether the ids are the same.

No begin, end or other special tokens are added, nothing is cut or padded; the names of special
tokens inside a text are ordinary text. Null text counts as empty and has no ids. ``restored``
says whether decoding the ids gives the text back; it is false where the model's normaliser
changes the text, or where the text holds the marker character itself.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import add_columns, in_bytes, read

MARK = "▁"
#: Fixed values of the model format: piece types and model types.
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Text that one call encodes, in bytes.
CALL_BYTES = 1 << 20
KEPT_WORDS = 300_000
GROUP_WORDS = 256
HIDDEN = "\U0010ffff"


def default_model() -> bytes:
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a protobuf message."""

    def varint(at):
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


def parse(model: bytes) -> dict:
    """Pieces ``(text, score, type)``, model type, byte fallback, unknown id and normaliser settings."""
    found = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True}
    names = {2: {3: "type", 35: "byte_fallback"}, 3: {2: "charsmap", 3: "prefix", 4: "squeeze", 5: "escape"}}
    for number, value in fields(model):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            found["pieces"].append((piece.get(1, b"").decode(), score, piece.get(3, 1)))
        elif number in names:
            found.update({names[number][n]: v for n, v in fields(value) if n in names[number]})
    found["unknown"] = next((i for i, p in enumerate(found["pieces"]) if p[2] == UNKNOWN), None)
    return found


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, better scores first, then as listed."""
    plain = {p: (-score, i) for i, (p, score, kind) in enumerate(pieces) if kind not in (UNKNOWN, CONTROL, UNUSED, BYTE)}
    found = [
        (*plain[p], plain[p[:k]][1], plain[p[k:]][1], p[:k], p[k:])
        for p in plain
        for k in range(1, len(p))
        if p[:k] in plain and p[k:] in plain
    ]
    return [m[-2:] for m in sorted(found)]


@lru_cache(4)
def tokenizer(model: bytes):
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    spec = parse(model)
    pieces, unknown = spec["pieces"], spec["unknown"]
    fallback = bool(spec["byte_fallback"])
    if spec["type"] == BPE:
        rank = {p: i for i, (p, _, _) in enumerate(pieces)}
        name = pieces[unknown][0] if unknown is not None else None
        core = models.BPE(rank, merges(pieces), unk_token=name, fuse_unk=True, byte_fallback=fallback)
    elif spec["type"] == UNIGRAM:
        # pieces that text must not match get names that it does not have; their scores must not
        # lower that of an unknown character, and bytes are filled in by ``encode``
        hidden = (UNKNOWN, CONTROL, UNUSED, BYTE)
        least = min((s for _, s, kind in pieces if kind not in hidden), default=0.0)
        core = models.Unigram([(HIDDEN + p, least) if kind in hidden else (p, s) for p, s, kind in pieces], unknown, False)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
    if spec["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    blank = MARK if spec["escape"] else " "
    if spec["prefix"]:
        steps.append(normalizers.Prepend(blank))
    if spec["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    built = Tokenizer(core)
    built.normalizer = normalizers.Sequence(steps)
    own = [AddedToken(p, normalized=True) for p, _, kind in pieces if kind == USER_DEFINED]
    if own:
        built.add_tokens(own)
    ends = [decoders.Strip(" ", 1, 0)] if spec["prefix"] else []
    built.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return built


@lru_cache(4)
def library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def use_threads(threads: int) -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))


@lru_cache(4)
def _plain(model: bytes):
    """The same tokenizer for text that is normalised already."""
    from tokenizers import Tokenizer, normalizers

    plain = Tokenizer.from_str(tokenizer(model).to_str())
    plain.normalizer = normalizers.Sequence([])
    return plain


@lru_cache(4)
def _words(model: bytes):
    """The same tokenizer for text that is normalised, one integer object per id, whether it opens a word,
    and ids of words met before.

    None where words depend on each other or the normaliser does more than mark blanks.
    """
    spec = parse(model)
    if spec["charsmap"] or spec["squeeze"] or not spec["prefix"] or not spec["escape"]:
        return None
    if any(MARK in p.lstrip(MARK) or kind == USER_DEFINED for p, _, kind in spec["pieces"]):
        return None
    opens = [p.startswith(MARK) for p, _, _ in spec["pieces"]]
    return _plain(model), list(range(len(spec["pieces"]))), opens, {}


@lru_cache(4)
def _bytes(model: bytes) -> tuple[int, list[int]] | None:
    """The unknown id and the ids of the 256 bytes, where unknown characters are spelled in bytes."""
    spec = parse(model)
    spelled = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(spec["pieces"]) if kind == BYTE}
    if spec["type"] != UNIGRAM or not spec["byte_fallback"] or len(spelled) < 256:
        return None
    return spec["unknown"], [spelled[b] for b in range(256)]


def _spelled(model: bytes, texts: list[str]) -> list[list[int]]:
    """Ids of each text by a unigram model, unknown stretches spelled in bytes."""
    unknown, spelled = _bytes(model)
    normal = [tokenizer(model).normalizer.normalize_str(t) for t in texts]
    plain = _plain(model).encode_batch(normal, add_special_tokens=False)
    found = []
    for text, e in zip(normal, plain):
        ids = []
        for i, (a, b) in zip(e.ids, e.offsets):
            ids += [i] if i != unknown else [spelled[x] for x in text[a:b].encode()]
        found.append(ids)
    return found


def encode(model: bytes, texts: list[str]) -> list[list[int]]:
    """Ids of each text.

    Where no piece reaches over the start of a word, words are independent: each new word is
    encoded once, and its ids are kept (at most ``KEPT_WORDS`` words). Texts with runs of blanks
    are encoded whole.
    """
    if _bytes(model):
        return _spelled(model, texts)
    words = _words(model)
    rows = [
        t.split(" ") if words and t and t[0] != " " and "  " not in t and MARK not in t else None for t in texts
    ]
    whole = [t for t, row in zip(texts, rows) if row is None]
    rest = iter(tokenizer(model).encode_batch_fast(whole, add_special_tokens=False) if whole else [])
    if not words:
        return [e.ids for e in rest]
    plain, same, opens, known = words
    if len(known) > KEPT_WORDS:
        known.clear()
    new = list({w for row in rows if row for w in row if w not in known})
    # many words make one text; a piece that starts with the mark opens the next word
    groups = [[w for w in new[a : a + GROUP_WORDS] if w] for a in range(0, len(new), GROUP_WORDS)]
    groups = [g for g in groups if g] + [[w] for w in new if not w]
    for group, e in zip(groups, plain.encode_batch_fast(["".join(MARK + w for w in g) for g in groups], add_special_tokens=False)):
        ids = list(map(same.__getitem__, e.ids))
        starts = [k for k, i in enumerate(ids) if opens[i]]
        if len(starts) != len(group):
            raise ValueError("a piece reached over the start of a word")
        known.update(zip(group, [tuple(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]))
    return [
        next(rest).ids if row is None else list(chain.from_iterable(map(known.__getitem__, row))) for row in rows
    ]


@lru_cache(4)
def _surfaces(model: bytes) -> tuple[list[bytes], bool]:
    spec = parse(model)
    surface = [
        bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in spec["pieces"]
    ]
    return surface, bool(spec["prefix"])


def decode(model: bytes, ids: list[list[int]]) -> list[str]:
    """Texts of ids by a table of surfaces: what the rebuilt tokenizer's decoder gives, at a sixth of its cost."""
    surface, prefix = _surfaces(model)
    texts = [b"".join(map(surface.__getitem__, row)).decode("utf-8", "replace") for row in ids]
    return [t[1:] if prefix and t[:1] == " " else t for t in texts]


_FIELDS = {
    "ids": T.StructField("ids", T.ArrayType(T.IntegerType())),
    "n_tokens": T.StructField("n_tokens", T.LongType()),
    "ids_xxh64": T.StructField("ids_xxh64", T.LongType()),
    "decoded_sha256": T.StructField("decoded_sha256", T.StringType()),
    "restored": T.StructField("restored", T.BooleanType()),
    "parity": T.StructField("parity", T.BooleanType()),
}


def with_pieces(
    df: DataFrame, outputs: list[str], model: bytes | None = None, text: str = "text", threads: int = 2
) -> DataFrame:
    """Append the named outputs: ``ids, n_tokens, ids_xxh64, decoded_sha256, restored, parity``."""
    model = model or default_model()

    def compute(column: pa.Array) -> list[pa.Array]:
        import numpy as np
        import xxhash

        use_threads(threads)
        texts = [t or "" for t in column.to_pylist()]
        found = {name: [] for name in outputs}
        for a, b in in_bytes(texts, len, CALL_BYTES):
            part = texts[a:b]
            ids = encode(model, part)
            if "ids" in found:
                found["ids"] += ids
            if "n_tokens" in found:
                found["n_tokens"] += map(len, ids)
            if "ids_xxh64" in found:
                digests = np.array([xxhash.xxh64_intdigest(np.array(i, np.int32).tobytes()) for i in ids], np.uint64)
                found["ids_xxh64"] += digests.view(np.int64).tolist()
            if "restored" in found or "decoded_sha256" in found:
                decoded = decode(model, ids)
            if "decoded_sha256" in found:
                found["decoded_sha256"] += [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
            if "restored" in found:
                found["restored"] += [x == y for x, y in zip(decoded, part)]
            if "parity" in found:
                found["parity"] += [x == y for x, y in zip(library(model).encode(part, num_threads=threads), ids)]
        kinds = {"ids": pa.list_(pa.int32()), "decoded_sha256": pa.string(), "restored": pa.bool_(), "parity": pa.bool_()}
        return [pa.array(found[name], kinds.get(name, pa.int64())) for name in outputs]

    return add_columns(df, text, [_FIELDS[name] for name in outputs], compute)


def with_text(df: DataFrame, model: bytes | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text that ids stand for; null ids give null."""
    model = model or default_model()

    def compute(column: pa.Array) -> list[pa.Array]:
        rows = column.to_pylist()
        texts = iter(decode(model, [r for r in rows if r is not None]))
        return [pa.array([None if r is None else next(texts) for r in rows], pa.string())]

    return add_columns(df, ids, [T.StructField(out, T.StringType())], compute)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, restored, parity`` of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_pieces(rows, ["n_tokens", "ids", "restored", "parity"]).drop("text")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents", "doc_id", "text")
    return with_pieces(rows, ["n_tokens", "ids", "ids_xxh64", "decoded_sha256", "restored", "parity"]).drop("text")
