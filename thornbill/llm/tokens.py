"""Encoding texts with a public byte-level BPE vocabulary, through a sentencepiece model made from it."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thornbill.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker remembers; beyond that it starts afresh, so its memory is bounded.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    at = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


_CHARACTERS = byte_characters()
_AS_CHARACTERS = {b: c for b, c in enumerate(_CHARACTERS)}
_AS_BYTE = {c: b for b, c in enumerate(_CHARACTERS)}


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model in wire format: byte-mapped pieces scored by negative rank, no normalisation.

    The id of a piece is its rank; one unknown piece, which no byte-mapped text can reach, follows the last.
    """
    normal, unknown, bpe = 1, 2, 2
    pieces = [("".join(map(_AS_CHARACTERS.get, token)), -float(rank), normal) for rank, token in enumerate(vocabulary)]
    pieces.append(("<unk>", 0.0, unknown))
    out = [_block(1, _block(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _number(3, kind)) for p, s, kind in pieces]
    minus_one = (1 << 64) - 1
    out.append(_block(2, _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(vocabulary)) + _number(41, minus_one) + _number(42, minus_one) + _number(43, minus_one)))
    out.append(_block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder over a serialised model."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for a null or empty text."""
        ids: list[int] = []
        if not text:
            return ids
        known = self.known
        tokens = self.pieces.findall(text)
        if new := [t for t in dict.fromkeys(tokens) if t not in known]:
            mapped = ["".join([_CHARACTERS[b] for b in t.encode()]) for t in new]
            for t, found in zip(new, self.processor.encode(mapped, num_threads=1)):
                known[t] = found
        for t in tokens:
            ids += known[t]
        if len(known) > REMEMBERED:
            known.clear()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are."""
        return bytes(_AS_BYTE[c] for i in ids for c in self.processor.id_to_piece(int(i))).decode(errors="replace")


@lru_cache(maxsize=4)
def coder(model: bytes) -> ByteBpe:
    return ByteBpe(model)


def encode_texts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``key, ids array<int>``: one row for each row of ``df``. Null and empty texts get the empty array, blank texts
    are encoded like any other. Narrow: no shuffle, whole texts, and the model, of a size fixed by the vocabulary,
    travels with the code, so executors need no file."""
    model = serialise_model(read_vocabulary(path))
    keyed = df.select(F.col(key), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model)
        for batch in batches:
            ends, parts = [0], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                ends.append(ends[-1] + len(ids))
                parts.append(np.array(ids, dtype=np.int32))
            flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[key, "ids"])

    return keyed.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """``key, text``: the inverse of :func:`encode_texts`; null ids give a null text, no ids the empty text."""
    model = serialise_model(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` of every document by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, n_chars, same``: whether decoding the ids gives the text back (null counts as empty)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode_texts(docs, "doc_id", "text")
    back = decode_ids(ids, "doc_id", "ids").withColumnRenamed("text", "decoded")
    return ids.select("doc_id", F.size("ids").alias("n_ids")).join(back, "doc_id").join(docs, "doc_id").select("doc_id", "n_ids", F.length("text").alias("n_chars"), (F.col("text") == F.col("decoded")).alias("same"))


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip}
ORACLES: dict[str, str] = {}
