"""Verification of what was written, by what it is: containers, archives, raw images, and folders of a group's volumes."""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from cairn.operators import payload, planner
from cairn.sources import containers, manifests

GROUP_MANIFEST = "group.manifest.json"


def manifest_of(path: str) -> str:
    """The manifest beside an image (.img) or its archive (.img.zst)."""
    for end in (".img.zst", ".img"):
        if path.endswith(end):
            return path.removesuffix(end) + ".manifest.json"
    return f"{path}.manifest.json"


def image_blocks(path: str, blocks: DataFrame) -> DataFrame:
    """blocks (byte_offset, length) with the checksums of a raw image's bytes there (got), read by the tasks: the image is on
    storage that they share."""
    import base64

    def run(batches):
        with open(path, "rb") as image:
            for batch in batches:
                got = []
                for start, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    image.seek(start)
                    got.append(base64.b64encode(hashlib.sha256(image.read(length)).digest()).decode())
                yield pa.RecordBatch.from_pydict({"byte_offset": batch.column(0), "got": got})

    return blocks.select("byte_offset", "length").mapInArrow(run, "byte_offset long, got string")


def verify_image(spark: SparkSession, path: str, manifest_path: str) -> dict:
    """blocks, image_sha256 of a raw image that its manifest describes; an error otherwise."""
    read = manifests.read(spark, f"file://{os.path.abspath(manifest_path)}")
    header = read.select("imageSha256", "blockCount", "logicalSize").first()
    blocks = manifests.blocks_of(read)
    pairs = blocks.select("byte_offset", F.col("sha256").alias("want")).join(image_blocks(path, blocks), "byte_offset")
    row = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("want") != F.col("got")).alias("bad"), F.min(F.when(F.col("want") != F.col("got"), F.col("byte_offset"))).alias("at")).first()
    if row.bad:
        raise ValueError(f"{path}: {row.bad} blocks do not match, the first at {row.at}")
    if row.n != header.blockCount or os.path.getsize(path) != header.logicalSize:
        raise ValueError(f"{path}: {row.n} of {header.blockCount} blocks, {os.path.getsize(path)} of {header.logicalSize} bytes")
    digest = hashlib.sha256()
    for piece in containers.pieces(path):
        digest.update(piece)
    if header.imageSha256 and digest.hexdigest() != header.imageSha256:
        raise ValueError(f"{path}: the image does not match its hash")
    return {"blocks": row.n, "image_sha256": digest.hexdigest()}


def verify(spark: SparkSession, path: str, manifest_path: str | None = None) -> list[dict]:
    """What was verified (path and findings), or an error: a folder by its group manifest, a container by itself, an archive
    and an image by their manifest."""
    if os.path.isdir(path):
        return verify_group(spark, path)
    if path.endswith(".szc"):
        return [{"path": path, **payload.verify_container(path)}]
    beside = manifest_path or manifest_of(path)
    if path.endswith(".img.zst"):
        header = manifests.read(spark, f"file://{os.path.abspath(beside)}").select("imageSha256", "logicalSize").first()
        if not header.imageSha256:
            raise ValueError(f"{beside} has no image hash to compare with")
        containers.restore_image(path, None, header.logicalSize, header.imageSha256)
        return [{"path": path, "image_sha256": header.imageSha256}]
    if path.endswith(".img"):
        return [{"path": path, **verify_image(spark, path, beside)}]
    raise ValueError(f"{path} is no .img, .img.zst or .szc")


def write_group(volumes: DataFrame, image_id: str, folder: str) -> None:
    """The group manifest of listing.image_volumes or group_report: a row for each volume of one image."""
    rows = volumes.orderBy("ordinal").collect()
    said = [{"device": r.device, "root": r.root, "snapshotId": r.snapshot_id, "imageFile": r.file, "manifest": os.path.basename(manifest_of(r.file))} for r in rows]
    part = os.path.join(folder, f"{GROUP_MANIFEST}.part")
    with open(part, "w") as f:
        json.dump({"version": 1, "kind": "ami", "snapshotId": image_id, "volumes": said}, f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, os.path.join(folder, GROUP_MANIFEST))


def verify_group(spark: SparkSession, folder: str) -> list[dict]:
    top = manifests.read(spark, f"file://{os.path.abspath(folder)}/{GROUP_MANIFEST}")
    if top.first().kind != "ami":
        raise ValueError(f"{folder} has no manifest of a group")
    volumes = top.selectExpr("explode(volumes) AS v").selectExpr("v.imageFile AS image", "v.manifest AS manifest")
    names = spark.createDataFrame([(n,) for n in os.listdir(folder)], "path string")
    out = []
    for r in planner.preferred_artifact(volumes, names).collect():  # volumes of one image
        if r.artifact is None:
            raise ValueError(f"{folder}: nothing of {r.image} is there")
        out += verify(spark, os.path.join(folder, r.artifact), os.path.join(folder, r.manifest))
    return out


def output_paths(target: str, out: str | None, volumes: list[str] | None = None) -> list[dict]:
    """Where images and their manifests go. A snapshot: the file `out`, `<target>.img` if none is named, or that in `out` if it is a
    folder. An image: a folder with a file for each of its volumes (names of listing.image_volumes)."""
    if volumes is None:
        path = out or f"{target}.img"
        if os.path.isdir(path):
            path = os.path.join(path, f"{target}.img")
        images = [os.path.abspath(path)]
    else:
        folder = os.path.abspath(out or target)
        os.makedirs(folder, exist_ok=True)
        images = [os.path.join(folder, v) for v in volumes]
    return [{"image": i, "manifest": manifest_of(i) if i.endswith(".img") else f"{i}.manifest.json"} for i in images]


def checked_options(level: int = 6, compress: bool = True, keep_raw: bool = False, stream: bool = False, base: str | None = None) -> None:
    """An error where options contradict each other."""
    if not 1 <= level <= 19:
        raise ValueError("levels are 1 to 19")
    if keep_raw and not compress:
        raise ValueError("without compression the raw image is what is kept")
    if stream and base:
        raise ValueError("a stream has no base")
    if stream and (keep_raw or not compress):
        raise ValueError("a stream makes a container alone")

