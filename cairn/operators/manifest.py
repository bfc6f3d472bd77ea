"""Manifests: schema, constraints, construction from a listing, and reconciliation of a listing with a manifest."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from cairn.functions.scalars import GIB
from cairn.plans import ordered

BLOCKS = "idx BIGINT, byte_offset BIGINT, length BIGINT, sha256 STRING"
SCHEMA = (
    "version INT, toolVersion STRING, kind STRING, snapshotId STRING, volumeSizeGiB BIGINT, blockSize BIGINT, logicalSize BIGINT, "
    "blockCount INT, allocatedBytes BIGINT, imageSha256 STRING, imageFile STRING, "
    "blocks ARRAY<STRUCT<index:BIGINT,offset:BIGINT,length:BIGINT,sha256:STRING>>, "
    "compression STRUCT<algorithm:STRING,level:INT,size:BIGINT,sha256:STRING,verified:BOOLEAN>, "
    "ami STRUCT<id:STRING,name:STRING,description:STRING,rootDevice:STRING,device:STRING>, "
    "volumes ARRAY<STRUCT<device:STRING,root:BOOLEAN,snapshotId:STRING,imageFile:STRING,manifest:STRING>>"
)
VERSION = 1


def length_report(blocks: DataFrame, most: int) -> DataFrame:
    """n, bad_len, distinct_idx."""
    bad = F.when((F.col("length") <= 0) | (F.col("length") > most), 1).otherwise(0)
    return blocks.agg(F.count("*").alias("n"), F.sum(bad).alias("bad_len"), F.countDistinct("idx").alias("distinct_idx"))


def violations(manifests: DataFrame) -> DataFrame:
    """snapshotId, rule, idx: a row for each broken rule of manifests in SCHEMA (idx: the block's, or null). A group
    manifest needs volumes alone; versions are checked as well."""
    group = F.col("kind") == "ami"
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {
        "version": number("version") != VERSION,
        "id": text("snapshotId") == "",
        "volumes": group & (F.coalesce(F.size("volumes"), F.lit(0)) <= 0),
        "volume size": ~group & (number("volumeSizeGiB") <= 0),
        "block size": ~group & (number("blockSize") <= 0),
        "logical size": ~group & (number("logicalSize") != number("volumeSizeGiB") * F.lit(GIB)),
        "block count": ~group & (number("blockCount") != F.greatest(F.lit(0), F.coalesce(F.size("blocks"), F.lit(0)))),
    }
    kinds = manifests.withColumn("kind", text("kind"))
    header = kinds.select("snapshotId", F.explode(F.filter(F.array(*(F.when(broken, name) for name, broken in rules.items())), lambda r: r.isNotNull())).alias("rule"), F.lit(None).cast("long").alias("idx"))
    block = kinds.where(~group).select("snapshotId", "blockSize", "logicalSize", F.explode("blocks").alias("b"))
    per_block = {
        "offset": F.col("b.offset") != F.col("b.index") * F.col("blockSize"),
        "length": (F.coalesce("b.length", F.lit(0)) <= 0) | (F.col("b.length") > F.col("blockSize")),
        "bounds": F.col("b.offset") + F.col("b.length") > F.col("logicalSize"),
    }
    rows = block.select("snapshotId", F.explode(F.filter(F.array(*(F.when(broken, name) for name, broken in per_block.items())), lambda r: r.isNotNull())).alias("rule"), F.col("b.index").alias("idx"))
    return header.union(rows)


def checked(manifests: DataFrame) -> DataFrame:
    """manifests, or an error that names a broken rule."""
    if (bad := violations(manifests).first()) is not None:
        raise ValueError(f"manifest {bad.snapshotId}: {bad.rule}" + (f" of block {bad.idx}" if bad.idx is not None else ""))
    return manifests


def skeleton(listing: DataFrame, block_size: int) -> DataFrame:
    """Manifest blocks of a fresh listing: nothing is fetched yet."""
    return listing.select("idx", (F.col("idx") * F.lit(block_size).cast("long")).alias("byte_offset"), F.lit(0).cast("long").alias("length"), F.lit("").alias("sha256"))


def reconcile(listing: DataFrame, blocks: DataFrame) -> DataFrame:
    """Places where a listing and a manifest differ, by position: ordinal, listed, known. None: they agree."""
    a = ordered.ordinal(listing.select("idx"), "idx").select("ordinal", F.col("idx").alias("listed"))
    b = ordered.ordinal(blocks.select("idx"), "idx").select("ordinal", F.col("idx").alias("known"))
    return a.join(b, "ordinal", "full_outer").where(~F.col("listed").eqNullSafe(F.col("known")))


def pending(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.coalesce("sha256", F.lit("")) == "")


def base_usable(blocks: DataFrame, image_sha256: str | None) -> bool:
    """A base has an image hash and a checksum for every block."""
    return bool(image_sha256) and pending(blocks).isEmpty()


def lineage_error(base: dict, target: dict) -> str | None:
    """Why a target geometry cannot follow a base: block sizes differ, or the volume shrank."""
    if base["block_size"] != target["block_size"]:
        return "block sizes differ"
    return "the volume shrank" if target["volume_gib"] < base["volume_gib"] else None
