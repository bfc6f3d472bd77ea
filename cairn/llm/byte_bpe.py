"""Byte-level BPE encoding and decoding by a sentencepiece model serialised from a rank file (operator 8).

The rank file's tokens become pieces: each byte is written as one printable character, each piece is scored by its
negative rank, and the normaliser is the identity, so sentencepiece merges in rank order over bytes. Texts are split by
the vocabulary's pattern and each pre-token is encoded by itself; a pre-token that is a token is that token, as in the
rank file's own library. Ids decode by the inverse byte map.

Cases: a null text is the empty text (no ids, the digests of no bytes); very long texts are encoded whole; repeated
rows, rows that share a doc_id and rows with a null one give a row each; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import arrow_map, documents
from cairn.llm.pretokens import PretokenIds


@functools.cache
def byte_chars() -> str:
    """Character i stands for byte i: itself where it is printable Latin-1, else the next free one from U+0100."""
    free = iter(range(0x100, 0x200))
    return "".join(chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF else chr(next(free)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in rank order. Ranks are ids and run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [rank for rank, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranks]


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece 0 is the unknown piece, piece i + 1 is token i."""
    chars = byte_chars()
    unknown = "⁇"  # outside the byte characters: no text has it after the byte map

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece(unknown, 0.0, 2)]
    pieces += [piece(token.decode("latin-1").translate(chars), -float(rank), 1) for rank, token in enumerate(tokens)]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + b"".join(_number(f, -1) for f in (41, 42, 43)) + _bytes(45, unknown.encode())
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class ByteBpe:
    """encode: texts -> ids as little-endian unsigned 32-bit bytes; decode: such bytes -> the text's bytes."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        chars = byte_chars()
        self.from_chars = {ord(c): b for b, c in enumerate(chars)}
        self.pieces = [self.model.id_to_piece(i + 1).translate(self.from_chars).encode("latin-1") for i in range(len(self.tokens))]
        self.memo = PretokenIds(pattern, self._encode_many)

    def _encode_many(self, words: list[str]) -> list[list[int]]:
        raw = [word.encode() for word in words]
        out: list[list[int] | None] = [[rank] if (rank := self.whole.get(b)) is not None else None for b in raw]
        rest = [i for i, ids in enumerate(out) if ids is None]
        chars = byte_chars()
        found = self.model.encode([raw[i].decode("latin-1").translate(chars) for i in rest], num_threads=1) if rest else []
        for i, ids in zip(rest, found, strict=True):
            out[i] = [x - 1 for x in ids]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memo.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded (binary) of every text."""
    return _mapped(docs, path, pattern, "doc_id long, ids binary, decoded binary", lambda d, ids, back: {"doc_id": d, "ids": ids, "decoded": back})


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digests of encode_documents, made where the ids are, so that no ids travel."""

    def digests(doc_ids, ids, back):
        return {
            "doc_id": doc_ids,
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
        }

    return _mapped(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, shape) -> DataFrame:
    def make():
        coder = ByteBpe(path, pattern)

        def step(columns: dict) -> dict:
            ids = coder.encode([text or "" for text in columns["text"]])
            return shape(columns["doc_id"], ids, [coder.decode(x) for x in ids])

        return step

    return arrow_map(docs.select("doc_id", "text"), make, schema, [f.split()[0] for f in schema.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
