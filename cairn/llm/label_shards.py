"""Balanced label propagation into shards (operator 9), in DataFrame operations alone.

A document's label is its shard; documents with equal texts are linked. The first label is by chance. The documents of a
group that begin in one shard are a cell and move together, so a hot group has at most one row for each shard. Each round
counts the labels of every group and names the group's target: its most frequent label, and in every other round the
most frequent one among shards with room, if it can one in which it fits whole, since a full shard takes only as much as leaves it. What cells want to move is summed by pairs
of shards, as much of it is admitted as room and departures of the same round allow, and cells fill these quotas by
running sums over salts, so no task ranks a whole shard. Rounds end when they no longer bring linked documents together. At the end
shards are made even exactly: each keeps its quota, linked documents before single ones, and what is over goes to the
shards that lack rows. Law: counts at most one apart.

A group larger than a shard is cut beforehand, by a hash of the doc_id, into parts of which each fits.

Cases: a null text has size 16 and no links; empty texts are linked as any other; very long texts count by their size alone; rows that
share a doc_id, null ones too, are rows of their own; ties between labels are settled by a hash; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from cairn.llm.common import discard, documents, stored

SHARDS, OVERHEAD = 40, 16
GAIN = 0.002  # a round that brings less than this share of the scattered documents together is of no use
CELLS = 50_000  # ranked by one task


def salt(n: int, *seed):
    return F.pmod(F.xxhash64(*(F.lit(s) for s in seed), "doc_id"), F.lit(n)).cast("int")


def nodes(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, the text's digest (null: no text) and a first label that knows nothing of the links."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("g"),
    ).withColumn("shard", salt(shards, "label"))


def admitted(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """As many of the wanted moves (from, to: rows) as keep every shard within its room: two shards exchange what both want,
    and the rest goes where room is, which leaves room where it came from."""
    moves, room = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}, list(room)
    more = True
    while more:
        more = False
        for (a, b), n in wanted.items():
            if (step := min(n - moves[a, b], room[b])) > 0:
                moves[a, b] += step
                room[b] -= step
                room[a] += step
                more = True
    return moves


def chosen(room: list[int], r: int):
    """A unit's target: its most frequent label; in odd rounds among shards with room, where it fits whole if it can."""
    rooms = F.array(*(F.lit(x).cast("long") for x in room))
    odd = F.lit(r % 2 == 1)
    free = lambda x: rooms[x["shard"]]
    rank = lambda x: F.struct((odd & (free(x) + x["n"] >= F.col("total"))).alias("fits"), x["n"].alias("n"), F.xxhash64(F.lit(r), "unit", x["shard"]).alias("tie"), x["shard"].alias("shard"))
    return F.array_max(F.transform(F.filter("labels", lambda x: ~odd | (free(x) > 0) | (x["n"] == F.col("total"))), rank))["shard"]


def propagate(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Stored cells (unit, first, shard, n) with the shards that the rounds lead to."""
    shards, scattered, idle, r = len(quota), None, 0, 0
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    while True:
        labels = stored(cells.groupBy("unit", "shard").agg(F.sum("n").alias("n")), "labels")
        load = {row.shard: row["sum(n)"] for row in labels.groupBy("shard").sum("n").collect()}  # a row a shard
        apart = labels.groupBy("unit").agg((F.sum("n") - F.max("n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        idle = idle + 1 if scattered is not None and apart > scattered * (1 - GAIN) else 0
        scattered = apart if scattered is None else min(apart, scattered)
        if not apart or idle == 4:
            discard(labels)
            return cells
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        # a unit's labels: one entry for each shard at most
        units = labels.groupBy("unit").agg(F.sum("n").alias("total"), F.collect_list(F.struct("n", "shard")).alias("labels"))
        target = stored(units.select("unit", chosen(room, r).alias("target")).where("target IS NOT NULL"), "targets")
        wanted = stored(cells.join(target, "unit").where("shard <> target"), "wanted")
        asked = wanted.groupBy("shard", "target").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).collect()  # a row for each two shards
        moves = admitted({(x.shard, x.target): x.n for x in asked}, room)
        table, salts = [0] * shards * shards, [1] * shards * shards
        for x in asked:
            at = x.shard * shards + x.target
            table[at], salts[at] = moves[x.shard, x.target], 1 + x.cells // CELLS
        pair = F.col("shard") * shards + F.col("target")
        dealt = wanted.withColumn("salts", longs(salts)[pair]).withColumn("salt", F.pmod(F.xxhash64(F.lit(r), "first", "unit"), F.col("salts")))
        place = F.sum("n").over(Window.partitionBy("shard", "target", "salt").orderBy(F.xxhash64("unit", F.lit(r)), "unit", "first"))
        share = longs(table)[pair]
        # the quota is dealt over the salts without a rest
        quota_here = F.floor(share / F.col("salts")) + (F.col("salt") < share % F.col("salts")).cast("long")
        go = dealt.withColumn("place", place).where(F.col("place") <= quota_here).select("unit", "first", "target")
        after = stored(cells.join(go, ["unit", "first"], "left").select("unit", "first", F.coalesce("target", "shard").alias("shard"), "n"), "cells")
        discard(labels, target, wanted, cells)
        cells, r = after, r + 1


def numbered(rows: DataFrame, by: list[str], order: list, salts: int, name: str) -> DataFrame:
    """rows with a gapless number from 0 within `by` (columns of bounded variety), in the order of the columns in `order` of
    bounded variety and of salts: salts are numbered in parallel and start where the ones before them end."""
    salted = rows.withColumn("_salt", salt(salts, name))
    keys = [*by, *order, "_salt"]
    counts = salted.groupBy(*keys).count()
    before = Window.partitionBy(*by).orderBy(*order, "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    # starts has a row for each combination of bounded values and salts
    return salted.withColumn("_own", F.row_number().over(own)).join(F.broadcast(starts), keys).withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_salt", "_own", "_start")


def even(rows: DataFrame, shards: int, salts: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot with counts at most one apart. rows: with `single`, 0 for linked ones."""
    count = {r.shard: r["count"] for r in rows.groupBy("shard").count().collect()}  # a row for each shard
    n = sum(count.values())
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    have = [min(count.get(s, 0), q) for s, q in enumerate(quota)]
    ends, at = [], 0
    for q, h in zip(quota, have, strict=True):
        at += q - h
        ends.append(at)
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    placed = stored(numbered(rows, ["shard"], ["single"], salts, "slot"), "placed")
    kept = F.col("slot") < longs(quota)[F.col("shard")]
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    over = numbered(placed.where(~kept).drop("slot").withColumn("all", F.lit(0)), ["all"], ["shard"], salts, "spare")
    to = F.size(F.filter(longs(ends), lambda end: end <= F.col("spare")))  # one entry for each shard
    over = over.withColumn("shard", to).withColumn("slot", longs(have)[F.col("shard")] + F.col("spare") - longs([0, *ends])[F.col("shard")])
    return placed.where(kept).select(columns).union(over.select(columns))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not `key`)."""
    salts = max(8, min(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))
    base = stored(nodes(docs, shards), "nodes")
    n = base.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    groups = base.where("g IS NOT NULL").groupBy("g").count().where("count > 1")
    # a little more parts than would fill shards: a hash does not deal evenly
    groups = stored(groups.select("g", F.when(F.col("count") <= max(1, quota[-1]), 1).otherwise(1 + F.ceil(F.col("count") / max(1, quota[-1]))).alias("parts")), "groups")
    linked = base.join(groups, "g").withColumn("unit", F.xxhash64("g", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.col("parts")))).drop("g", "parts")
    linked = stored(linked.withColumnRenamed("shard", "first"), "linked")
    start = stored(linked.groupBy("unit", "first").agg(F.count("*").alias("n")).select("unit", "first", F.col("first").alias("shard"), "n"), "cells")
    cells = propagate(start, quota)
    single = base.where("g IS NULL").union(base.where("g IS NOT NULL").join(groups, "g", "left_anti").select(base.columns))
    columns = ["doc_id", "size", "text_crc32", "shard"]
    labelled = linked.join(cells.select("unit", "first", "shard"), ["unit", "first"]).select(*columns, F.lit(0).alias("single"))
    spread = even(labelled.union(single.select(*columns, F.lit(1).alias("single"))), shards, salts)
    return spread.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
