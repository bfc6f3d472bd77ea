"""Verification of block tables against manifests."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from cairn.operators.journal import SAMPLE, stride_sample

PUSHED = 1000  # offsets that are written into a filter


def compare(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, status: ok, mismatch or missing. manifest: key, want; found: key, got. Digests alone travel."""
    rows = manifest.select(key, "want").join(found.select(key, "got", F.lit(True).alias("_f")), key, "left")
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("got").eqNullSafe(F.col("want")), "ok").otherwise("mismatch")
    return rows.select(key, status.alias("status"))


def status_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count("*").alias("n"))


def verify_blocks(manifest: DataFrame, data: DataFrame) -> DataFrame:
    """byte_offset, status of every manifest block (byte_offset, length, sha256 base64) against stored payloads; a block
    that is not stored reads as zeros: ok if the manifest says so, else missing."""
    from cairn.functions.scalars import block_checksum

    found = data.select("byte_offset", block_checksum(F.col("data")).alias("got"), F.length("data").alias("_size"))
    rows = manifest.select("byte_offset", F.col("length"), F.col("sha256").alias("want")).join(found, "byte_offset", "left")
    zeros = block_checksum(F.unhex(F.repeat(F.lit("00"), F.col("length").cast("int"))))
    got = F.coalesce("got", zeros)
    right = (got == F.col("want")) & (F.coalesce(F.col("_size"), F.col("length")) == F.col("length"))
    return rows.select("byte_offset", F.when(right, "ok").when(F.col("got").isNull(), "missing").otherwise("mismatch").alias("status"))


def verify_sample(manifest: DataFrame, data: DataFrame, n: int = SAMPLE) -> DataFrame:
    """verify_blocks of n manifest blocks at even strides of their index. The sample is at most n rows, so its offsets become
    a filter of the scan: other payloads are neither read nor hashed."""
    rows = stride_sample(manifest.select("idx", "byte_offset", "length", "sha256"), "idx", n)
    if n <= 0 or n > PUSHED:
        return verify_blocks(rows, data)
    chosen = rows.collect()
    rows = manifest.sparkSession.createDataFrame(chosen, manifest.select("idx", "byte_offset", "length", "sha256").schema)
    return verify_blocks(rows, data.where(F.col("byte_offset").isin([r.byte_offset for r in chosen])))
