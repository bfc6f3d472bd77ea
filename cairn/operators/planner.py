"""Costs, sizes, headroom and readiness."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from cairn.operators.listing import PAGE_SIZE, page_count

#: Dollars for each request, and the default for each GB that leaves.
REQUEST_USD, EGRESS_USD_PER_GB = 0.003 / 1000, 0.09


def cost(volumes: DataFrame, rate: float = EGRESS_USD_PER_GB, page_size: int = PAGE_SIZE) -> DataFrame:
    """volumes (gets, nbytes) with list_requests, request_usd, egress_gb, egress_usd, total_usd. Egress counts only for a
    positive rate and bytes."""
    gb = F.when((F.col("nbytes") > 0) & F.lit(rate > 0), F.col("nbytes") / F.lit(1e9)).otherwise(F.lit(0.0))
    rows = volumes.withColumn("list_requests", page_count(F.col("gets"), page_size)).withColumn("egress_gb", gb)
    rows = rows.withColumn("request_usd", (F.col("list_requests") + F.col("gets")) * F.lit(REQUEST_USD)).withColumn("egress_usd", F.col("egress_gb") * F.lit(max(rate, 0.0)))
    return rows.withColumn("total_usd", F.col("request_usd") + F.col("egress_usd"))


def cost_total(costed: DataFrame) -> DataFrame:
    return costed.agg(*(F.sum(c).alias(c) for c in ("list_requests", "gets", "request_usd", "egress_gb", "egress_usd", "total_usd")))


def estimated_bytes(blocks: DataFrame, length: Column, block_size: int) -> DataFrame:
    """est_bytes: known lengths, and whole blocks where the length is not known."""
    return blocks.agg(F.sum(F.coalesce(F.nullif(length, F.lit(0)), F.lit(block_size))).cast("long").alias("est_bytes"))


def short_of_space(free: Column, allocated: Column) -> Column:
    """Less is free than what is allocated and a tenth more."""
    return free < allocated + F.floor(allocated / 10)


def volume_totals(volumes: DataFrame) -> DataFrame:
    return volumes.agg(*(F.sum(c).alias(c) for c in ("volume_gib", "logical_size", "allocated_bytes")))


def state_of(state: Column) -> Column:
    """pending, failed (error and recoverable), or ready (anything else)."""
    return F.when(state == "pending", "pending").when(state.isin("error", "recoverable"), "failed").otherwise("ready")


def readiness(states: DataFrame) -> DataFrame:
    """One row: ready, pending and failed (comma-separated ids, failed ones with state and message)."""
    kind = state_of(F.col("state"))
    name = F.col("snapshot_id")
    listed = lambda which, text: F.array_sort(F.collect_list(F.when(kind == which, F.struct(name.alias("id"), text.alias("said")))))
    joined = lambda which, text: F.array_join(F.transform(listed(which, text), lambda x: x["said"]), ", ")
    said = F.when(F.col("message").isNull(), "").otherwise(F.concat(F.lit(" ("), F.col("message"), F.lit(")")))
    with_message = F.concat(name, F.lit(": "), F.col("state"), said)
    return states.agg((F.count(F.when(kind != "ready", 1)) == 0).alias("ready"), joined("pending", name).alias("pending"), joined("failed", with_message).alias("failed"))


def preferred_artifact(volumes: DataFrame, files: DataFrame) -> DataFrame:
    """volumes with the artifact to verify: of <image>.szc, <image>.zst and <image> the first that is there (files: path)."""
    options = volumes.select("*", F.posexplode(F.array(F.concat("image", F.lit(".szc")), F.concat("image", F.lit(".zst")), F.col("image"))).alias("_rank", "path"))
    there = options.join(files.select("path"), "path", "left_semi")
    best = there.groupBy("image").agg(F.min_by("path", "_rank").alias("artifact"))
    return volumes.join(best, "image", "left")


def progress(done: Column, total: Column, nbytes: Column, total_bytes: Column, seconds: Column) -> dict[str, Column]:
    """percent of blocks, bytes_per_second, and eta_seconds (null before anything is known, and at the end)."""
    percent = F.when(total > 0, done * 100.0 / total).otherwise(0.0)
    rate = F.when((nbytes > 0) & (seconds > 0), nbytes / seconds)
    left = F.when((done > 0) & (done < total) & (nbytes > 0) & (total_bytes > nbytes), seconds / nbytes * (total_bytes - nbytes))
    return {"percent": percent, "bytes_per_second": rate, "eta_seconds": F.round(left)}


def error_hint(error_class: Column, encrypted: Column) -> Column:
    """What may help, for errors of access; else null."""
    access = F.lit("listing and reading of the snapshot's blocks must be granted")
    return F.when(error_class == "denied", F.when(encrypted, F.concat(access, F.lit("; its encryption key must be usable as well"))).otherwise(access))
