"""Journals: reading, replay, pending work, resumption and the sample that distrustful resumption re-hashes."""

from __future__ import annotations

import json
import os

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from cairn.plans import ordered

ENTRY = "o INT, len BIGINT, sha STRING"
HEADER = "v INT, base STRING, id STRING, blocks INT"
VERSION, SAMPLE = 1, 32


class JournalMismatch(ValueError):
    """A journal that belongs to another version, snapshot, base or block list."""


class Writer:
    """A journal file that one writer appends to. Entries are held until `checkpoint`, which the caller calls once the blocks
    that they name are durable themselves."""

    def __init__(self, path: str, snapshot_id: str, blocks: int, base: str | None = None):
        self.held: list[dict] = []
        new = not os.path.exists(path) or not os.path.getsize(path)
        self.file = open(path, "a+b")  # noqa: SIM115
        if new:
            self.held.append({"v": VERSION, "id": snapshot_id, "blocks": blocks} | ({"base": base} if base else {}))
            self.checkpoint()
            return
        self.file.seek(-1, os.SEEK_END)
        if self.file.read(1) != b"\n":  # a torn line would swallow the next one
            self.file.write(b"\n")

    def record(self, ordinal: int, length: int, sha256: str) -> None:
        self.held.append({"o": ordinal, "len": length, "sha": sha256})

    def clear(self, ordinal: int) -> None:
        """The block is to be fetched again."""
        self.record(ordinal, 0, "")

    def checkpoint(self) -> None:
        if self.held:
            self.file.write(b"".join(json.dumps(entry, separators=(",", ":")).encode() + b"\n" for entry in self.held))
            self.held = []
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.checkpoint()
        self.file.close()


def replay(entries: DataFrame, key: str, order: str, value: list[str], cleared) -> DataFrame:
    """The last entry of each key, without keys whose last entry clears them. max_by is pre-aggregated, so a key with
    many entries costs a row for each task."""
    last = entries.groupBy(key).agg(F.max_by(F.struct(*value), F.col(order)).alias("_last"))
    return last.select(key, "_last.*").where(~cleared)


def read(spark: SparkSession, path: str, snapshot_id: str, blocks: int, base: str | None = None) -> DataFrame:
    """line_no, o, len, sha of a JSON-lines journal whose header matches; torn and malformed lines are ignored, entries
    outside the block list too."""
    lines = spark.read.text(path)
    header = lines.limit(1).first()
    try:
        said = json.loads(header.value) if header else {}
    except ValueError:
        raise JournalMismatch("the header is not JSON") from None
    if said.get("v") != VERSION or said.get("id") != snapshot_id or (said.get("base") or None) != base or said.get("blocks") != blocks:
        raise JournalMismatch(f"the journal is of {said}")
    # a journal is one file, appended to by one writer: its line order is its file order
    numbered = lines.select(F.monotonically_increasing_id().alias("line_no"), "value").where("line_no > 0")
    entry = F.from_json("value", ENTRY)
    rows = numbered.select("line_no", entry.alias("e")).select("line_no", "e.*")
    return rows.where("o IS NOT NULL AND sha IS NOT NULL").where(F.col("o").between(0, blocks - 1))


def replayed(entries: DataFrame) -> DataFrame:
    """o, len, sha of what is done: last write wins, an empty checksum clears."""
    return replay(entries, "o", "line_no", ["len", "sha"], F.col("sha") == "")


def merged(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest blocks with the journal's checksums where they have none. blocks: ordinal, ..., length, sha256."""
    j = done.select(F.col("o").alias("ordinal"), F.col("len").alias("_len"), F.col("sha").alias("_sha"))
    rows = blocks.join(j, "ordinal", "left")
    empty = (F.coalesce("sha256", F.lit("")) == "") & F.col("_sha").isNotNull()
    return rows.withColumn("length", F.when(empty, F.col("_len")).otherwise(F.col("length"))).withColumn("sha256", F.when(empty, F.col("_sha")).otherwise(F.col("sha256"))).drop("_len", "_sha")


def not_done(blocks: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Work that is left: an anti-join against what is done."""
    return blocks.join(done.select(F.col(done_key or key).alias(key)), key, "left_anti")


def stride_sample(rows: DataFrame, index: str, n: int = SAMPLE) -> DataFrame:
    """n rows at even strides of the order (places 0, s, 2s, ... with s = N div n); all rows if there are no more than n,
    or n is not positive."""
    placed = ordered.ordinal(rows, index, "_place")
    total = rows.agg(F.count("*").alias("_n"))  # one row
    stride = F.greatest(F.lit(1), F.expr(f"_n div {max(1, n)}"))
    chosen = (F.col("_place") % stride == 0) & (F.floor(F.col("_place") / stride) < n) | (F.col("_n") <= n) | F.lit(n <= 0)
    return placed.crossJoin(F.broadcast(total)).where(chosen).drop("_place", "_n")


def resume_pending(blocks: DataFrame, done: DataFrame, mismatched: DataFrame | None = None) -> DataFrame:
    """Blocks to fetch: those without a checksum of their own or of the journal, and sampled ones whose bytes differ
    (ordinal). Blocks carried from a base have checksums and are not fetched again."""
    left = merged(blocks, done).where(F.coalesce("sha256", F.lit("")) == "")
    if mismatched is None:
        return left
    wrong = merged(blocks, done).join(mismatched.select("ordinal").distinct(), "ordinal", "left_semi")
    return left.unionByName(wrong).dropDuplicates(["ordinal"])
