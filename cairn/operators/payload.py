"""Operators on block payloads, in Arrow batches: zero tests, the ordered image hash, zstd frames, and the chunk container.

Payloads are large (512 KiB a block): batches are walked row by row without leaving Arrow, and metadata queries never read
these columns.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

#: Fixed values of the container format: magic, version, and sizes of header, record header and footer.
MAGIC, CONTAINER_VERSION, HEADER, RECORD, FOOTER = b"SZTC", 1, 8, 16, 16
_ZEROS = bytes(1 << 20)


def all_zero(data: bytes | memoryview) -> bool:
    view = memoryview(data)
    return all(view[i : i + len(_ZEROS)] == _ZEROS[: min(len(_ZEROS), len(view) - i)] for i in range(0, len(view), len(_ZEROS)))


def batched(rows: Iterable[tuple], schema: pa.Schema, sizes: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `limit` bytes; sizes: the place of the payload in a row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sizes])
        if size >= limit:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema=schema)


def zero_flags(blocks: DataFrame, data: str = "data") -> DataFrame:
    """blocks with `zero` instead of the payload."""
    keep = [c for c in blocks.columns if c != data]
    schema = blocks.select(*keep, F.lit(True).alias("zero")).schema

    def run(batches):
        for batch in batches:
            flags = [None if x.as_py() is None else all_zero(x.as_buffer()) for x in batch.column(data)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(flags, pa.bool_())], names=[*keep, "zero"])

    return blocks.mapInArrow(run, schema)


def _zeros(digest, n: int) -> None:
    while n > 0:
        digest.update(_ZEROS[: min(n, len(_ZEROS))])
        n -= len(_ZEROS)


def image_hash(blocks: DataFrame, logical_size: int, offset: str = "byte_offset", data: str = "data") -> DataFrame:
    """image_sha256, n_blocks: the hash of the whole image, holes and tail as zeros.

    SHA-256 states cannot be merged, so one task folds the bytes in order, streaming; for a digest that scales use
    merkle_digest. Blocks that overlap or pass the end are an error.
    """

    def run(batches):
        digest, at, n = hashlib.sha256(), 0, 0
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = payload.as_buffer()
                if start < at or start + len(view) > logical_size:
                    raise ValueError(f"block at {start} overlaps or passes the end")
                _zeros(digest, start - at)
                digest.update(view)
                at, n = start + len(view), n + 1
        _zeros(digest, logical_size - at)
        yield pa.RecordBatch.from_pydict({"image_sha256": [digest.hexdigest()], "n_blocks": pa.array([n - 1], pa.int64())})

    # an empty block at the end: an image without blocks has a task too. One task is what a sequential hash means
    end = blocks.sparkSession.range(1).select(F.lit(logical_size).cast("long").alias(offset), F.lit(b"").alias(data))
    return blocks.select(F.col(offset).cast("long"), data).union(end).repartition(1).sortWithinPartitions(offset).mapInArrow(run, "image_sha256 string, n_blocks long")


def merkle_digest(blocks: DataFrame, index: str = "idx", sha256: str = "sha256", bits: int = 12) -> DataFrame:
    """digest: a hash over hashes of 2^bits neighbours, for images too large to hash in one task. Not the image's SHA-256."""
    part = blocks.groupBy(F.shiftright(F.col(index), bits).alias("g")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, sha256))), lambda s: F.concat(s[index].cast("string"), F.lit("="), s[sha256])), ";"), 256).alias("h")
    )
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda s: F.concat(s["g"].cast("string"), F.lit("="), s["h"])), ";"), 256).alias("digest"))


def encode_frames(blocks: DataFrame, level: int = 3, index: str = "idx", offset: str = "byte_offset", data: str = "data") -> DataFrame:
    """idx, byte_offset, raw_len, stored_len, raw_sha256, frame: a zstd frame for each block that is not all zeros."""
    schema = pa.schema([("idx", pa.int64()), ("byte_offset", pa.int64()), ("raw_len", pa.int32()), ("stored_len", pa.int32()), ("raw_sha256", pa.string()), ("frame", pa.binary())])

    def rows(batches):
        codec = pa.Codec("zstd", compression_level=level)
        for batch in batches:
            for idx, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = value.as_buffer()
                if payload is not None and not all_zero(payload):
                    frame = codec.compress(payload, asbytes=True)
                    yield idx, start, len(payload), len(frame), hashlib.sha256(payload).hexdigest(), frame

    return blocks.select(F.col(index).cast("long"), F.col(offset).cast("long"), data).mapInArrow(lambda batches: batched(rows(batches), schema, 5), "idx long, byte_offset long, raw_len int, stored_len int, raw_sha256 string, frame binary")


def decode_frames(frames: DataFrame) -> DataFrame:
    """idx, byte_offset, data: frames back to payloads, each checked against its hash."""
    schema = pa.schema([("idx", pa.int64()), ("byte_offset", pa.int64()), ("data", pa.binary())])

    def rows(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            for idx, start, size, want, frame in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                data = codec.decompress(frame.as_buffer(), decompressed_size=size, asbytes=True)
                if hashlib.sha256(data).hexdigest() != want:
                    raise ValueError(f"chunk at {start} does not match its hash")
                yield idx, start, data

    return frames.select("idx", "byte_offset", "raw_len", "raw_sha256", "frame").mapInArrow(lambda batches: batched(rows(batches), schema, 2), "idx long, byte_offset long, data binary")


def write_container(frames: Iterable[tuple[int, int, str, bytes]], path: str, snapshot_id: str, volume_gib: int, block_size: int, logical_size: int, image_sha256: str) -> dict:
    """A chunk container from (offset, raw_len, raw_sha256, frame) in the order of offsets, written beside and renamed at
    the end. Returns the trailer."""
    chunks, last = [], 0
    with tempfile.NamedTemporaryFile("wb", dir=os.path.dirname(os.path.abspath(path)), delete=False) as out:
        try:
            out.write(MAGIC + struct.pack(">I", CONTAINER_VERSION))
            for offset, raw_len, digest, frame in frames:
                if offset < last or offset + raw_len > logical_size or not 0 < raw_len <= block_size:
                    raise ValueError(f"chunk at {offset} is out of order or out of bounds")
                out.write(struct.pack(">QII", offset, raw_len, len(frame)))
                chunks.append({"o": offset, "l": raw_len, "s": out.tell(), "c": len(frame), "h": digest})
                out.write(frame)
                last = offset + raw_len
            trailer = {"version": CONTAINER_VERSION, "snapshotId": snapshot_id, "volumeGiB": volume_gib, "blockSize": block_size, "logicalSize": logical_size, "imageSha256": image_sha256, "chunks": chunks}
            said, at = json.dumps(trailer, separators=(",", ":")).encode(), out.tell()
            out.write(said + struct.pack(">QII", at, len(said), zlib.crc32(said)))
            out.flush()
            os.fsync(out.fileno())
        except BaseException:
            os.unlink(out.name)
            raise
    os.replace(out.name, path)
    return trailer


def open_container(path: str) -> dict:
    """The trailer of a container, with every rule of the format checked."""
    size = os.path.getsize(path)
    if size < HEADER + FOOTER:
        raise ValueError("too small for a container")
    with open(path, "rb") as f:
        magic, version = struct.unpack(">4sI", f.read(HEADER))
        if magic != MAGIC or version != CONTAINER_VERSION:
            raise ValueError("not a container of this version")
        f.seek(size - FOOTER)
        at, length, crc = struct.unpack(">QII", f.read(FOOTER))
        if at < HEADER or at + length + FOOTER != size:
            raise ValueError("the footer does not fit the file")
        f.seek(at)
        said = f.read(length)
    if zlib.crc32(said) != crc:
        raise ValueError("the trailer's CRC differs")
    trailer = json.loads(said)
    if trailer.get("version") != CONTAINER_VERSION or min(trailer.get(k, 0) for k in ("volumeGiB", "blockSize", "logicalSize")) <= 0:
        raise ValueError("the trailer's version or geometry is wrong")
    trailer["chunks"].sort(key=lambda c: c["o"])
    end = 0
    for c in trailer["chunks"]:
        if c["o"] < end or not 0 < c["l"] <= trailer["blockSize"] or c["o"] + c["l"] > trailer["logicalSize"] or c["s"] < HEADER + RECORD or c["s"] + c["c"] > at:
            raise ValueError(f"chunk at {c['o']} overlaps or is out of bounds")
        end = c["o"] + c["l"]
    return trailer


def read_chunk(path: str, chunk: dict) -> bytes:
    with open(path, "rb") as f:
        f.seek(chunk["s"])
        data = pa.Codec("zstd").decompress(f.read(chunk["c"]), decompressed_size=chunk["l"], asbytes=True)
    if hashlib.sha256(data).hexdigest() != chunk["h"]:
        raise ValueError(f"chunk at {chunk['o']} does not match its hash")
    return data


def read_range(path: str, offset: int, length: int, trailer: dict | None = None) -> bytes:
    """Bytes of the image; what no chunk holds reads as zeros. Only chunks that the range touches are decoded."""
    import bisect

    trailer = trailer or open_container(path)
    if offset < 0 or length < 0 or offset + length > trailer["logicalSize"]:
        raise ValueError("the range is out of bounds")
    out, chunks = bytearray(length), trailer["chunks"]
    at = max(0, bisect.bisect_right(chunks, offset, key=lambda c: c["o"]) - 1)
    while at < len(chunks) and chunks[at]["o"] < offset + length:
        c = chunks[at]
        low, high = max(offset, c["o"]), min(offset + length, c["o"] + c["l"])
        if low < high:
            out[low - offset : high - offset] = read_chunk(path, c)[low - c["o"] : high - c["o"]]
        at += 1
    return bytes(out)


def image_pieces(path: str, trailer: dict) -> Iterator[bytes]:
    """The image in order, in pieces: chunks, and zeros between them."""
    at = 0
    for c in [*trailer["chunks"], {"o": trailer["logicalSize"], "l": 0}]:
        while at < c["o"]:
            n = min(c["o"] - at, len(_ZEROS))
            yield _ZEROS[:n]
            at += n
        if c["l"]:
            yield read_chunk(path, c)
            at += c["l"]


def verify_container(path: str) -> dict:
    """chunks, image_sha256 of a container whose image matches its hash; an error otherwise."""
    trailer, digest = open_container(path), hashlib.sha256()
    for piece in image_pieces(path, trailer):
        digest.update(piece)
    if digest.hexdigest() != trailer["imageSha256"]:
        raise ValueError("the image does not match its hash")
    return {"chunks": len(trailer["chunks"]), "image_sha256": digest.hexdigest()}
