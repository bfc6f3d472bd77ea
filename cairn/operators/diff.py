"""Snapshot differences and the manifest of an incremental step. Snapshots are (idx, payload); payloads may be digests."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def snapshot_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """idx, kind (added, removed, modified, unchanged), old, payload."""
    b = base.select("idx", F.col("payload").alias("old"), F.lit(True).alias("_b"))
    t = target.select("idx", "payload", F.lit(True).alias("_t"))
    kind = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_t").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("payload")), "modified")
        .otherwise("unchanged")
    )
    return b.join(t, "idx", "full_outer").select("idx", kind.alias("kind"), "old", "payload")


def changed_blocks(diff: DataFrame, generation: str = "g0") -> DataFrame:
    """idx, kind, second_token: what changed; no token (empty) where the block is no longer allocated."""
    token = F.when(F.col("kind") == "removed", "").otherwise(F.concat(F.lit(f"{generation}-i"), F.col("idx").cast("string")))
    return diff.where("kind <> 'unchanged'").select("idx", "kind", token.alias("second_token"))


def data_bearing(changed: DataFrame) -> DataFrame:
    return changed.where("second_token <> ''")


def delta_payloads(diff: DataFrame) -> DataFrame:
    """idx, payload, refetch: the target's blocks, and which must be fetched."""
    return diff.where("kind <> 'removed'").select("idx", "payload", (F.col("kind") != "unchanged").alias("refetch"))


def delta_counters(diff: DataFrame) -> DataFrame:
    of = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    return diff.agg(of("added", "modified").alias("fetched"), of("removed").alias("zeroed"), of("unchanged").alias("reused"), of("added").alias("new_blocks"))


def delta_manifest(base: DataFrame, changed: DataFrame, block_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, zero plan, counters) of a step from base blocks (idx, byte_offset, length, sha256) by changed blocks
    (idx, second_token).

    Blocks without a change keep their checksum; changed ones with data wait for it (no checksum, length 0), as do new ones;
    deallocated ones go, and their ranges are zeroed if the base had them. Changed counts all entries with data; zeroed
    the deallocated ones that the base had; reused those that did not change; new those that the base did not have.
    """
    change = changed.select("idx", "second_token", F.lit(True).alias("_c"))
    old = base.select("idx", "byte_offset", "length", "sha256").join(change, "idx", "left")
    gone = F.col("_c") & (F.col("second_token") == "")
    kept = old.where(~F.coalesce(gone, F.lit(False))).select(
        "idx", "byte_offset", F.when(F.col("_c"), F.lit(0).cast("long")).otherwise(F.col("length")).alias("length"), F.when(F.col("_c"), "").otherwise(F.col("sha256")).alias("sha256")
    )
    new = data_bearing(changed).join(base.select("idx"), "idx", "left_anti")
    new = new.select("idx", (F.col("idx") * F.lit(block_size).cast("long")).alias("byte_offset"), F.lit(0).cast("long").alias("length"), F.lit("").alias("sha256"))
    zero = old.where(gone).select("byte_offset", F.lit(block_size).cast("long").alias("length"))
    counted = change.join(base.select("idx", F.lit(True).alias("_b")), "idx", "full_outer")
    has_data = F.col("second_token") != ""
    counters = counted.agg(
        F.count(F.when(has_data, 1)).alias("changed"),
        F.count(F.when(F.col("_b") & (F.col("second_token") == ""), 1)).alias("zeroed"),
        F.count(F.when(F.col("_c").isNull(), 1)).alias("reused"),
        F.count(F.when(has_data & F.col("_b").isNull(), 1)).alias("new_blocks"),
    )
    return kept.unionByName(new), zero, counters


def apply_delta(base_data: DataFrame, fetched: DataFrame, removed: DataFrame) -> DataFrame:
    """The target's block table: fetched rows replace base rows, whatever they hold (zeros too), removed ones go."""
    stay = base_data.join(fetched.select("idx").union(removed.select("idx")).distinct(), "idx", "left_anti")
    return stay.unionByName(fetched.select(base_data.columns))
