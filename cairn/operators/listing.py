"""Allocation listings: offsets, pages, order and geometry."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from cairn.plans import ordered

BLOCK_SIZE, PAGE_SIZE = 512 * 1024, 10_000


def with_offset(blocks: DataFrame, index: str = "idx", block_size: int = BLOCK_SIZE, out: str = "byte_offset") -> DataFrame:
    return blocks.withColumn(out, F.col(index) * F.lit(block_size).cast("long"))


def page(blocks: DataFrame, after: int, size: int, index: str = "idx") -> DataFrame:
    """The next page: seek behind the last key, so earlier pages are not read again."""
    return blocks.where(F.col(index) > after).orderBy(index).limit(size)


def from_start(blocks: DataFrame, start: int, index: str = "idx") -> DataFrame:
    return blocks.where(F.col(index) >= start)


def page_count(n, page_size: int = PAGE_SIZE):
    """List calls for n blocks; an empty listing takes one."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(page_size)))).cast("long")


def order_violations(rows: DataFrame, position: str, value: str) -> DataFrame:
    """n, bad: rows whose value is not above that of the row before, in listing order."""
    seen = ordered.previous(rows.select(position, value), position, value, "_before")
    return seen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_before") >= F.col(value), 1).otherwise(0)), F.lit(0)).alias("bad"))


def geometry_report(pages: DataFrame) -> DataFrame:
    """ok: all pages name one positive geometry. pages: volume_gib, block_size."""
    return pages.agg(
        ((F.countDistinct("volume_gib", "block_size") == 1) & (F.min("volume_gib") > 0) & (F.min("block_size") > 0)).alias("ok"),
        F.min("volume_gib").alias("volume_gib"),
        F.min("block_size").alias("block_size"),
    )


def checked_listing(pages: DataFrame) -> DataFrame:
    """Concatenated pages (page, idx, token, expiry, volume_gib, block_size) as a listing, or an error where the pages
    disagree on geometry or indexes do not rise."""
    ok = geometry_report(pages).select("ok").first()
    if pages.isEmpty():
        return pages.select("idx", "token", "expiry")
    if not ok.ok:
        raise ValueError("pages disagree on geometry")
    located = pages.withColumn("_position", F.col("page") * F.lit(1 << 40) + F.col("position"))
    if order_violations(located, "_position", "idx").first().bad:
        raise ValueError("block indexes do not rise")
    return pages.select("idx", "token", "expiry")


IMAGES = "image_id STRING, root_device STRING, mappings ARRAY<STRUCT<device:STRING,snapshot_id:STRING>>"


def image_volumes(images: DataFrame, root_only: bool = False) -> DataFrame:
    """image_id, ordinal, device, root, snapshot_id, file: the volumes of images (IMAGES) that have a snapshot."""
    from cairn.functions.scalars import device_name

    rows = images.select("image_id", "root_device", F.posexplode("mappings").alias("ordinal", "m")).where("coalesce(m.snapshot_id, '') <> ''")
    named = rows.select("image_id", "ordinal", F.col("m.device").alias("device"), F.coalesce(F.col("m.device") == F.col("root_device"), F.lit(False)).alias("root"), F.col("m.snapshot_id").alias("snapshot_id"))
    named = named.withColumn("file", F.concat(device_name(F.col("device"), F.col("ordinal")), F.lit(".img")))
    return named.where("root") if root_only else named


def group_report(volumes: DataFrame, results: DataFrame) -> DataFrame:
    """Volumes of image_volumes with what was done for their snapshots (snapshot_id, allocated_bytes, image_sha256)."""
    return volumes.join(results, "snapshot_id", "left")
