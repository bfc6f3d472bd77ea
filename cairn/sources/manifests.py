"""Manifest JSON: read with a fixed schema and checked; written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import manifest


def read(spark: SparkSession, path: str) -> DataFrame:
    return manifest.checked(spark.read.schema(manifest.SCHEMA).option("multiLine", True).json(path))


def blocks_of(manifests: DataFrame) -> DataFrame:
    return manifests.selectExpr("explode(blocks) AS b").selectExpr("b.index AS idx", "b.offset AS byte_offset", "b.length AS length", "b.sha256 AS sha256")


def write(spark: SparkSession, header: dict, blocks: DataFrame, path: str) -> dict:
    """A manifest of a header and blocks (idx, byte_offset, length, sha256), checked before it is written. A row takes
    about a hundred bytes and the format is one JSON document, so rows stream through the driver."""
    said = dict(header)
    said["blocks"] = [{"index": r.idx, "offset": r.byte_offset, "length": r.length, "sha256": r.sha256} for r in blocks.orderBy("idx").toLocalIterator()]
    said |= {"version": manifest.VERSION, "blockCount": len(said["blocks"]), "allocatedBytes": sum(b["length"] for b in said["blocks"])}
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
        json.dump(said, f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    try:
        manifest.checked(spark.read.schema(manifest.SCHEMA).option("multiLine", True).json(f"file://{f.name}"))
    except BaseException:
        os.unlink(f.name)
        raise
    os.replace(f.name, path)
    return said
