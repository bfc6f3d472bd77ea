"""The query catalogue over the star-schema tables, and the same queries as SQL.

The tables hold no blocks, so blocks are modelled on them: distinct lineitem order keys are an allocation map, orders two
snapshots, documents payloads, events journals and errors, order status readiness.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from cairn.functions import scalars
from cairn.operators import diff, extents, journal, listing, manifest, payload, planner, resilience, verify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# models


def allocation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx")).distinct()


def snapshots(spark, sf_dir):
    """(base, target): order 5 mod 13 is not in the base, 0 mod 11 not in the target, and 3 mod 7 has changed."""
    key = F.col("o_orderkey")
    payload_of = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    orders = table(spark, sf_dir, "orders").select(key.alias("idx"), payload_of.alias("payload"))
    base = orders.where("idx % 13 <> 5")
    changed = F.when(F.col("idx") % 7 == 3, F.concat("payload", F.lit("*"))).otherwise(F.col("payload"))
    return base, orders.where("idx % 11 <> 0").select("idx", changed.alias("payload"))


def diff_of(spark, sf_dir):
    return diff.snapshot_diff(*snapshots(spark, sf_dir))


# queries


@query
def allocation_listing(spark, sf_dir):
    return listing.with_offset(allocation(spark, sf_dir))


@query
def monotonic_check(spark, sf_dir):
    return listing.order_violations(table(spark, sf_dir, "events"), "event_id", "user_id").withColumn("bad", F.col("bad").cast("long"))


@query
def extents_gaps_islands(spark, sf_dir):
    return extents.islands(allocation(spark, sf_dir))


@query
def holes(spark, sf_dir):
    return extents.holes(allocation(spark, sf_dir))


@query
def changed_blocks(spark, sf_dir):
    return diff.changed_blocks(diff_of(spark, sf_dir))


@query
def delta_payloads(spark, sf_dir):
    return diff.delta_payloads(diff_of(spark, sf_dir))


def delta_of(spark, sf_dir):
    base = snapshots(spark, sf_dir)[0]
    blocks = listing.with_offset(base.select("idx", F.length("payload").cast("long").alias("length"), scalars.block_checksum(F.col("payload")).alias("sha256")))
    return diff.delta_manifest(blocks, diff.changed_blocks(diff_of(spark, sf_dir)), listing.BLOCK_SIZE)


@query
def delta_manifest(spark, sf_dir):
    return delta_of(spark, sf_dir)[0]


@query
def delta_zero_plan(spark, sf_dir):
    return delta_of(spark, sf_dir)[1]


@query
def delta_manifest_counters(spark, sf_dir):
    return delta_of(spark, sf_dir)[2]


@query
def delta_counters(spark, sf_dir):
    return diff.delta_counters(diff_of(spark, sf_dir))


@query
def pending_blocks(spark, sf_dir):
    return journal.not_done(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx")), allocation(spark, sf_dir), "idx")


@query
def stride_sample(spark, sf_dir):
    return journal.stride_sample(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", 32)


@query
def cost_by_source(spark, sf_dir):
    volumes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("gets"), F.sum("n_chars").alias("nbytes"))
    costed = planner.cost(volumes)
    return costed.select("source", "gets", F.col("list_requests").alias("pages"), F.round("request_usd", 9).alias("request_usd"), F.round("egress_usd", 12).alias("egress_usd"))


@query
def cost_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("gets"), F.sum("n_chars").alias("nbytes"))


@query
def cost_total(spark, sf_dir):
    volumes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("gets"), F.sum("n_chars").alias("nbytes"))
    total = planner.cost_total(planner.cost(volumes))
    return total.select("list_requests", "gets", *(F.round(c, 9).alias(c) for c in ("request_usd", "egress_gb", "egress_usd", "total_usd")))


def order_manifests(spark, sf_dir):
    """A manifest for each customer with the customer's orders as blocks, each rule broken for some."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    length = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 600000 ELSE 524288 END").cast("long")
    block = F.struct(key.alias("index"), (key * listing.BLOCK_SIZE + F.when(key % 13 == 0, 1).otherwise(0)).alias("offset"), length.alias("length"), F.lit("x").alias("sha256"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(block).alias("blocks"))  # a customer's orders
    gib = F.when(owner % 5 == 0, 0).otherwise(1).cast("long")
    return rows.select(
        F.when(owner % 17 == 0, 2).otherwise(1).alias("version"), F.lit("").alias("kind"), F.when(owner % 19 == 0, "").otherwise(owner.cast("string")).alias("snapshotId"),
        gib.alias("volumeSizeGiB"), F.when(owner % 23 == 0, 0).otherwise(listing.BLOCK_SIZE).cast("long").alias("blockSize"), (gib * scalars.GIB + F.when(owner % 3 == 0, 1).otherwise(0)).alias("logicalSize"),
        (F.size("blocks") + F.when(owner % 4 == 0, 1).otherwise(0)).alias("blockCount"), "blocks", F.lit(None).cast("array<string>").alias("volumes"),
    )


@query
def manifest_violations(spark, sf_dir):
    return manifest.violations(order_manifests(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


@query
def manifest_reconcile(spark, sf_dir):
    return manifest.reconcile(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx")), allocation(spark, sf_dir))


@query
def journal_merged(spark, sf_dir):
    own = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("m"), F.col("o_custkey").cast("string")))
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.when(own == "", 0).otherwise(F.col("o_custkey")).cast("long").alias("length"), own.alias("sha256"))
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.min("l_partkey").alias("len"), F.concat(F.lit("j"), F.min("l_suppkey").cast("string")).alias("sha"))
    return journal.merged(blocks, done)


@query
def journal_pending(spark, sf_dir):
    """What is left to fetch of journal_merged, and blocks that a sample found wrong."""
    rows = journal_merged(spark, sf_dir)
    none = spark.createDataFrame([], "o long, len long, sha string")
    wrong = table(spark, sf_dir, "orders").where("o_orderkey % 29 = 5").select(F.col("o_orderkey").alias("ordinal"))
    return journal.resume_pending(rows, none, wrong)


@query
def length_report(spark, sf_dir):
    length = F.expr("CASE WHEN doc_id % 29 = 7 THEN 0 WHEN doc_id % 31 = 9 THEN 600000 ELSE n_chars END")
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), length.alias("length"))
    return manifest.length_report(blocks, listing.BLOCK_SIZE).withColumn("bad_len", F.col("bad_len").cast("long"))


@query
def chunk_index(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.col("n_chars").alias("stored_len"))
    return extents.store_places(chunks, "doc_id", "stored_len")


@query
def overlap_check(spark, sf_dir):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    chunks = table(spark, sf_dir, "lineitem").select((key * 4).alias("s"), (key * 4 + line).alias("e")).distinct()
    return extents.overlaps(chunks, "s", "e").withColumn("overlaps", F.col("overlaps").cast("long"))


@query
def random_read(spark, sf_dir):
    a = F.col("o_orderkey") * 1000 + 500
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), a.alias("a"), (a + F.col("o_custkey")).alias("z"))
    return extents.read_plan(requests, allocation(spark, sf_dir), 1000)


@query
def verify_blocks(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    want = documents.select("doc_id", scalars.hex_digest(F.col("text")).alias("want"))
    text = F.when(F.col("doc_id") % 17 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    got = documents.where("doc_id % 19 <> 4").select("doc_id", scalars.hex_digest(text).alias("got"))
    return verify.status_counts(verify.compare(want, got, "doc_id"))


@query
def verify_stored_blocks(spark, sf_dir):
    """Documents as blocks: some are not stored, some hold another byte, and zeros that are not stored read as zeros."""
    offset = (F.col("doc_id") * listing.BLOCK_SIZE).alias("byte_offset")
    whole = F.when(F.col("doc_id") % 23 == 6, F.unhex(F.lit("0000"))).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = table(spark, sf_dir, "documents").select("doc_id", offset, whole.alias("data"))
    blocks = rows.select("byte_offset", F.length("data").cast("long").alias("length"), scalars.block_checksum(F.col("data")).alias("sha256"))
    changed = F.when(F.col("doc_id") % 17 == 3, F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))
    data = rows.where("doc_id % 19 <> 4 AND doc_id % 23 <> 6").select("byte_offset", changed.alias("data"))
    return verify.status_counts(verify.verify_blocks(blocks, data))


@query
def block_checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.block_checksum(F.col("text")).alias("sha256_b64"))


@query
def image_hash(spark, sf_dir):
    """All documents' bytes in order, without holes: the fold of ordered_image_hash over a dense image."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    from cairn.plans import ordered

    placed = ordered.sum_before(documents, "doc_id", F.length("data"), "byte_offset")
    size = documents.agg(F.sum(F.length("data")).alias("n")).first().n
    return payload.image_hash(placed, size).select("image_sha256")


@query
def zero_blocks(spark, sf_dir):
    data = F.when(F.col("doc_id") % 97 == 13, "0000").otherwise(F.col("text"))
    zero = F.sum(F.when(scalars.is_zero_text(data), 1).otherwise(0)).cast("long")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), zero.alias("zero_n"))


@query
def zero_flags(spark, sf_dir):
    """Blocks of bytes: some are zeros."""
    data = F.when(F.col("doc_id") % 97 == 13, F.unhex(F.lit("00000000"))).otherwise(F.encode("text", "UTF-8"))
    return payload.zero_flags(table(spark, sf_dir, "documents").select("doc_id", data.alias("data")))


@query
def next_chunk(spark, sf_dir):
    """For each order key the first allocated block at or after it, in steps of 10."""
    requests = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 1).alias("position"))
    return extents.next_chunk(requests, allocation(spark, sf_dir).select((F.col("idx") * 10).alias("at")), "position", "at", bits=10)


@query
def journal_replay(spark, sf_dir):
    return journal.replay(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type", "value"], F.col("event_type") == "error")


@query
def state_classify(spark, sf_dir):
    said = F.expr("CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'error' ELSE 'completed' END")
    rows = table(spark, sf_dir, "orders").select("o_custkey", planner.state_of(said).alias("state"))
    return rows.groupBy("o_custkey", "state").agg(F.count("*").alias("n"))


@query
def token_freshness(spark, sf_dir):
    """Events whose tokens, good for ten minutes, are stale."""
    expiry, now = F.col("ts") + F.expr("INTERVAL 10 MINUTES"), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return table(spark, sf_dir, "events").where(~scalars.token_fresh(expiry, now)).select("event_id")


@query
def error_classes(spark, sf_dir):
    code = F.expr("CASE event_type WHEN 'error' THEN 'ThrottlingException' WHEN 'signup' THEN 'InternalError' WHEN 'purchase' THEN 'ServiceUnavailable' ELSE 'AccessDenied' END")
    rows = table(spark, sf_dir, "events").select("event_type", scalars.error_class(code).alias("class"), scalars.is_retryable(code, F.lit("")).alias("retryable"))
    return rows.groupBy("event_type", "class", "retryable").agg(F.count("*").alias("n"))


@query
def aimd_replay(spark, sf_dir):
    return resilience.replay_limiter(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


@query
def backoff_bounds(spark, sf_dir):
    lo, hi = scalars.backoff(F.col("a"))
    return spark.range(10).select(F.col("id").cast("int").alias("a")).select("a", lo.alias("lo"), hi.alias("hi"))


@query
def group_totals(spark, sf_dir):
    volumes = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return volumes.groupBy("n_name").agg(F.count("*").alias("volumes"), F.sum("c_custkey").alias("total"))


def images(spark, sf_dir):
    """An image for each order, with a volume for each of its lines; some have no snapshot, some no device."""
    device = F.expr("CASE l_linenumber WHEN 4 THEN NULL WHEN 2 THEN concat('/dev/mapper/', flag, ' x') ELSE concat('/dev/sd', l_linenumber) END")
    line = F.struct("l_linenumber", device.alias("device"), F.when(F.col("l_linenumber") != 3, F.col("part").cast("string")).alias("snapshot_id"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # an order's lines
    return rows.select(F.col("l_orderkey").cast("string").alias("image_id"), F.lit("/dev/sd1").alias("root_device"), F.transform("lines", lambda x: F.struct(x["device"].alias("device"), x["snapshot_id"].alias("snapshot_id"))).alias("mappings"))


@query
def image_volumes(spark, sf_dir):
    return listing.image_volumes(images(spark, sf_dir))


@query
def group_report(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("snapshot_id"), F.col("p_size").cast("long").alias("allocated_bytes"), F.col("p_name").alias("image_sha256"))
    return listing.group_report(listing.image_volumes(images(spark, sf_dir), root_only=True), parts)


@query
def volume_totals(spark, sf_dir):
    gib = F.col("c_nationkey").cast("long")
    return planner.volume_totals(table(spark, sf_dir, "customer").select(gib.alias("volume_gib"), (gib * scalars.GIB).alias("logical_size"), F.col("c_custkey").alias("allocated_bytes")))


@query
def geometry_report(spark, sf_dir):
    return listing.geometry_report(table(spark, sf_dir, "customer").select(F.lit(8).cast("long").alias("volume_gib"), F.when(F.col("c_nationkey") >= 0, 4096).otherwise(0).alias("block_size")))


@query
def preferred_artifact(spark, sf_dir):
    key = F.col("s_suppkey")
    volumes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key.cast("string"), F.lit(".img")).alias("image"))
    ends = F.array(F.when(key % 2 == 0, ".szc"), F.when(key % 3 == 0, ".zst"), F.when(key % 5 > 0, ""))
    files = table(spark, sf_dir, "supplier").select(key, F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("end"))
    files = files.select(F.concat(F.lit("s"), key.cast("string"), F.lit(".img"), "end").alias("path"))
    return planner.preferred_artifact(volumes, files)


@query
def readiness(spark, sf_dir):
    state = F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'recoverable' ELSE 'completed' END")
    message = F.expr("CASE WHEN n_nationkey % 8 = 1 THEN 'lost' END")
    return planner.readiness(table(spark, sf_dir, "nation").select(F.col("n_name").alias("snapshot_id"), state.alias("state"), message.alias("message")))


@query
def space_warnings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", planner.short_of_space(F.col("p_partkey") * 11, F.col("p_size").cast("long") * 100).alias("short"))


@query
def progress(spark, sf_dir):
    done, total = F.col("o_orderkey") % 100, F.lit(90)
    said = planner.progress(done, total, done * 1000, total * 1000, F.col("o_custkey").cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(said["percent"], 6).alias("percent"), F.round(said["bytes_per_second"], 6).alias("bytes_per_second"))


@query
def error_hints(spark, sf_dir):
    code = F.expr("CASE event_type WHEN 'error' THEN 'AccessDenied' WHEN 'signup' THEN 'SlowDown' ELSE 'UnauthorizedOperation' END")
    hint = planner.error_hint(scalars.error_class(code), F.col("user_id") % 2 == 0)
    return table(spark, sf_dir, "events").groupBy(hint.alias("hint")).agg(F.count("*").alias("n"))


@query
def listing_from_start(spark, sf_dir):
    return listing.from_start(allocation(spark, sf_dir), 700)


@query
def device_files(spark, sf_dir):
    device = F.when(F.col("p_partkey") % 9 == 0, "/dev/").otherwise(F.concat(F.lit("/dev/"), "p_name", F.lit("/1")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.device_name(device, F.col("p_size")).alias("file"))


@query
def manifest_paths(spark, sf_dir):
    end = F.expr("CASE p_partkey % 3 WHEN 0 THEN '.img' WHEN 1 THEN '.img.zst' ELSE '.raw' END")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.manifest_path(F.concat(F.col("p_partkey").cast("string"), end)).alias("path"))


@query
def usd(spark, sf_dir):
    """Amounts without ties of rounding."""
    return table(spark, sf_dir, "orders").where("o_custkey % 25 <> 0").select("o_orderkey", scalars.usd(F.col("o_custkey") * 2 / 10000).alias("s"))


@query
def estimated_bytes(spark, sf_dir):
    known = F.expr("CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END")
    return planner.estimated_bytes(table(spark, sf_dir, "documents"), known, listing.BLOCK_SIZE)


@query
def paged_listing(spark, sf_dir):
    return listing.page(allocation(spark, sf_dir), 1000, 500)


@query
def sanitize_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.safe_name(F.col("p_name")).alias("safe_name"))


@query
def human_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.human_count(F.col("o_orderkey") * 977).alias("s"))


@query
def human_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("(n_chars * 20) % 1024 <> 0").select("doc_id", scalars.human_bytes(F.col("n_chars")).alias("s"))


@query
def duplicate_payloads(spark, sf_dir):
    """An extension: payloads that occur more than once."""
    rows = table(spark, sf_dir, "documents").groupBy(scalars.hex_digest(F.col("text")).alias("h"))
    return rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query
def container_roundtrip(spark, sf_dir):
    """doc_id, ok: every document's bytes through a zstd frame and back."""
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), (F.col("doc_id") * listing.BLOCK_SIZE).alias("byte_offset"), F.encode("text", "UTF-8").alias("data"))
    back = payload.decode_frames(payload.encode_frames(blocks)).select("idx", F.sha2("data", 256).alias("got"))
    want = blocks.select("idx", F.sha2("data", 256).alias("want"))
    return want.join(back, "idx", "left").select(F.col("idx").alias("doc_id"), F.col("got").eqNullSafe(F.col("want")).alias("ok"))


@query
def ordered_image_hash(spark, sf_dir):
    """The hash of an image of all documents in order, with a hole of seven bytes after each."""
    from cairn.plans import ordered

    documents = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    placed = ordered.sum_before(documents, "doc_id", F.length("data") + 7, "byte_offset")
    size = documents.agg(F.coalesce(F.sum(F.length("data") + 7), F.lit(0)).alias("n")).first().n
    return payload.image_hash(placed, size)


_CH = """base as (select o_orderkey idx, concat(cast(o_custkey as varchar),'|',o_orderstatus,'|',o_orderpriority) payload from orders where o_orderkey % 13 <> 5),
tgt as (select o_orderkey idx, case when o_orderkey % 7 = 3 then concat(concat(cast(o_custkey as varchar),'|',o_orderstatus,'|',o_orderpriority),'*') else concat(cast(o_custkey as varchar),'|',o_orderstatus,'|',o_orderpriority) end payload from orders where o_orderkey % 11 <> 0),
ch as (select coalesce(b.idx,t.idx) idx, b.payload oldp, t.payload newp, case when b.idx is null then 'added' when t.idx is null then 'removed' when b.payload<>t.payload then 'modified' else 'unchanged' end kind from base b full join tgt t on b.idx=t.idx)"""
_AL = "al as (select distinct l_orderkey idx from lineitem)"

ORACLE_SQL = {
    "allocation_listing": f"with {_AL} select idx, idx*524288 as byte_offset from al",
    "monotonic_check": "with x as (select user_id, lag(user_id) over (order by event_id) p from events) select count(*) as n, cast(sum(case when p>=user_id then 1 else 0 end) as bigint) as bad from x",
    "extents_gaps_islands": f"with {_AL}, r as (select idx, idx - row_number() over (order by idx) g from al) select min(idx) as first_idx, max(idx) as last_idx, count(*) as n from r group by g",
    "holes": f"with {_AL}, r as (select idx, lead(idx) over (order by idx) nx from al) select idx+1 as hole_start, nx-idx-1 as hole_len from r where nx>idx+1",
    "changed_blocks": f"with {_CH} select idx, kind, case when newp is null then '' else concat('g0-i',cast(idx as varchar)) end as second_token from ch where kind<>'unchanged'",
    "delta_payloads": f"with {_CH} select idx, newp as payload, kind<>'unchanged' as refetch from ch where kind<>'removed'",
    "delta_manifest": f"with {_CH} select idx, idx*524288 as byte_offset, cast(case when kind='unchanged' then length(oldp) else 0 end as bigint) as length, case when kind='unchanged' then to_base64(unhex(sha256(oldp))) else '' end as sha256 from ch where kind<>'removed'",
    "delta_zero_plan": f"with {_CH} select idx*524288 as byte_offset, cast(524288 as bigint) as length from ch where kind='removed'",
    "delta_manifest_counters": f"with {_CH} select count(case when kind in ('added','modified') then 1 end) as changed, count(case when kind='removed' then 1 end) as zeroed, count(case when kind='unchanged' then 1 end) as reused, count(case when kind='added' then 1 end) as new_blocks from ch",
    "delta_counters": f"with {_CH} select count(case when kind in ('added','modified') then 1 end) as fetched, count(case when kind='removed' then 1 end) as zeroed, count(case when kind='unchanged' then 1 end) as reused, count(case when kind='added' then 1 end) as new_blocks from ch",
    "pending_blocks": f"with {_AL} select o_orderkey as idx from orders where not exists (select 1 from al where al.idx=o_orderkey)",
    "stride_sample": "with r as (select doc_id, row_number() over (order by doc_id)-1 o, count(*) over () n from documents where lang='en') select doc_id from r where n<=32 or (o % cast(floor(n/32) as bigint)=0 and o/cast(floor(n/32) as bigint) < 32)",
    "cost_by_source": "select source, count(*) as gets, cast(ceil(count(*)/10000.0) as bigint) as pages, round(cast((count(*)+ceil(count(*)/10000.0)) as double)*cast(0.000003 as double),9) as request_usd, round(cast(sum(n_chars) as double)*cast(0.00000000009 as double),12) as egress_usd from documents group by source",
    "cost_rollup": "select source, count(*) as gets, cast(sum(n_chars) as bigint) as nbytes from documents group by rollup(source)",
    "length_report": "with b as (select doc_id idx, case when doc_id%29=7 then 0 when doc_id%31=9 then 600000 else n_chars end len from documents) select count(*) as n, cast(sum(case when len<=0 or len>524288 then 1 else 0 end) as bigint) as bad_len, count(distinct idx) as distinct_idx from b",
    "chunk_index": "select doc_id, n_chars as stored_len, cast(8 + 16 + coalesce(sum(16+n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding),0) as bigint) as store_off from documents where n_chars>0",
    "overlap_check": "with x as (select distinct l_orderkey*4 s, l_orderkey*4+l_linenumber e from lineitem), y as (select s, e, lag(e) over (order by s,e) pe from x) select count(*) as n, cast(sum(case when pe>s then 1 else 0 end) as bigint) as overlaps from y",
    "random_read": f"with req as (select o_orderkey id, o_orderkey*1000+500 a, o_orderkey*1000+500+o_custkey z from orders), x as (select id, a, z, unnest(range(a // 1000, (z-1) // 1000 + 1)) b from req), {_AL} select id, cast(sum(least(z,(b+1)*1000)-greatest(a,b*1000)) as bigint) as total_bytes, cast(sum(case when idx is null then least(z,(b+1)*1000)-greatest(a,b*1000) else 0 end) as bigint) as zero_bytes from x left join al on x.b=al.idx group by id",
    "verify_blocks": "with m as (select doc_id, sha256(text) h from documents), d as (select doc_id, case when doc_id%17=3 then concat(text,'!') else text end t from documents where doc_id%19<>4), j as (select case when d.doc_id is null then 'missing' when sha256(d.t)=m.h then 'ok' else 'mismatch' end st from m left join d on m.doc_id=d.doc_id) select st as status, count(*) as n from j group by st",
    "block_checksum": "select doc_id, to_base64(unhex(sha256(text))) as sha256_b64 from documents",
    "image_hash": "select sha256(string_agg(text,'' order by doc_id)) as image_sha256 from documents",
    "zero_blocks": "with b as (select case when doc_id%97=13 then '0000' else text end data from documents) select count(*) as n, cast(sum(case when replace(data,'0','')='' then 1 else 0 end) as bigint) as zero_n from b",
    "journal_replay": "select user_id, t as event_type, v as value from (select user_id, arg_max(event_type,event_id) t, arg_max(value,event_id) v from events group by 1) where t<>'error'",
    "state_classify": "select o_custkey, case o_orderstatus when 'P' then 'pending' when 'F' then 'failed' else 'ready' end as state, count(*) as n from orders group by 1,2",
    "token_freshness": "select event_id from events where ts + interval 10 minutes - interval 2 minutes < timestamp '2024-01-15 00:00:00'",
    "error_classes": "select event_type, case when event_type='error' then 'throttle' when event_type in ('signup','purchase') then 'server' else 'denied' end as class, event_type in ('error','signup','purchase') as retryable, count(*) as n from events group by 1,2,3",
    "aimd_replay": "select user_id, list_reduce(list_transform(list(event_type order by event_id), lambda x: case when x='error' then -1::bigint else 0::bigint end), lambda u,x: case when x=-1 then greatest(1::bigint,u//2) else least(32::bigint,u+1) end, 32::bigint) as usable from events group by user_id",
    "backoff_bounds": "select a, least(cast(30 as double),cast(0.5 as double)*pow(2,a))/2 as lo, least(cast(30 as double),cast(0.5 as double)*pow(2,a)) as hi from (select cast(range as integer) a from range(10))",
    "group_totals": "select n_name, count(*) as volumes, cast(sum(c_custkey) as bigint) as total from customer join nation on c_nationkey=n_nationkey group by n_name",
    "estimated_bytes": "select cast(sum(coalesce(nullif(case when doc_id%5=0 then 0 else n_chars end,0),524288)) as bigint) as est_bytes from documents",
    "paged_listing": f"with {_AL} select idx from al where idx>1000 order by idx limit 500",
    "sanitize_names": "select p_partkey, regexp_replace(replace(p_name,'/','-'),'[^A-Za-z0-9_-]','-','g') as safe_name from part",
    "human_count": "select o_orderkey, format('{:,}',o_orderkey*977) as s from orders",
    "human_bytes": "select doc_id, case when n_chars>=1024 then concat(printf('%.1f',n_chars/cast(1024 as double)),' KiB') else concat(cast(n_chars as varchar),' B') end as s from documents where (n_chars*20)%1024<>0",
    "cost_total": "with v as (select count(*) gets, ceil(count(*)/10000.0) lists, sum(n_chars) nbytes from documents group by source) select cast(sum(lists) as bigint) as list_requests, cast(sum(gets) as bigint) as gets, round(cast(sum(lists+gets) as double)*cast(0.000003 as double),9) as request_usd, round(cast(sum(nbytes) as double)/cast(1000000000 as double),9) as egress_gb, round(cast(sum(nbytes) as double)*cast(0.00000000009 as double),9) as egress_usd, round(cast(sum(lists+gets) as double)*cast(0.000003 as double)+cast(sum(nbytes) as double)*cast(0.00000000009 as double),9) as total_usd from v",
    "manifest_violations": "with b as (select o_custkey c, o_orderkey i, o_orderkey*524288 + case when o_orderkey%13=0 then 1 else 0 end o, case when o_orderkey%7=0 then 0 when o_orderkey%11=0 then 600000 else 524288 end l, case when o_custkey%23=0 then 0 else 524288 end bs, case when o_custkey%5=0 then 0 else 1073741824 end + case when o_custkey%3=0 then 1 else 0 end ls from orders), m as (select distinct c from b), r as (select 'version' rule, c from m where c%17=0 union all select 'id', c from m where c%19=0 union all select 'volume size', c from m where c%5=0 union all select 'block size', c from m where c%23=0 union all select 'logical size', c from m where c%3=0 union all select 'block count', c from m where c%4=0 union all select 'offset', c from b where o<>i*bs union all select 'length', c from b where l<=0 or l>bs union all select 'bounds', c from b where o+l>ls) select rule, count(*) as n from r group by rule",
    "manifest_reconcile": f"with {_AL}, a as (select o_orderkey listed, row_number() over (order by o_orderkey)-1 n from orders), b as (select idx known, row_number() over (order by idx)-1 n from al) select coalesce(a.n,b.n) as ordinal, listed, known from a full join b on a.n=b.n where listed is distinct from known",
    "journal_merged": "with l as (select l_orderkey, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey from lineitem group by 1) select o_orderkey as ordinal, case when o_orderkey%3=0 and l_orderkey is not null then l_partkey when o_orderkey%3=0 then 0 else o_custkey end as length, case when o_orderkey%3=0 and l_orderkey is not null then concat('j',cast(l_suppkey as varchar)) when o_orderkey%3=0 then '' else concat('m',cast(o_custkey as varchar)) end as sha256 from orders left join l on l_orderkey=o_orderkey",
    "journal_pending": "with l as (select l_orderkey, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey from lineitem group by 1), j as (select o_orderkey as ordinal, case when o_orderkey%3=0 and l_orderkey is not null then l_partkey when o_orderkey%3=0 then 0 else o_custkey end as length, case when o_orderkey%3=0 and l_orderkey is not null then concat('j',cast(l_suppkey as varchar)) when o_orderkey%3=0 then '' else concat('m',cast(o_custkey as varchar)) end as sha256 from orders left join l on l_orderkey=o_orderkey) select * from j where sha256='' or ordinal%29=5",
    "verify_stored_blocks": "select case when doc_id%23=6 then 'ok' when doc_id%19=4 then case when coalesce(text,'')='' then 'ok' else 'missing' end when doc_id%17=3 then 'mismatch' else 'ok' end as status, count(*) as n from documents group by 1",
    "zero_flags": "select doc_id, case when doc_id%97=13 then true when text is null then null else replace(text,chr(0),'')='' end as zero from documents",
    "next_chunk": f"with {_AL}, q as (select o_orderkey*10+1 as position from orders) select position, (select min(idx*10) from al where idx*10>=position) as next_offset from q",
    "image_volumes": "with lineitem as (select l_orderkey, l_linenumber, min(l_partkey) l_partkey, min(l_returnflag) l_returnflag from lineitem group by 1,2), v as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber)-1 as ordinal, case l_linenumber when 4 then null when 2 then concat('/dev/mapper/',l_returnflag,' x') else concat('/dev/sd',cast(l_linenumber as varchar)) end as device, l_linenumber n, l_returnflag f, cast(l_partkey as varchar) as snapshot_id from lineitem) select cast(l_orderkey as varchar) as image_id, cast(ordinal as integer) as ordinal, device, coalesce(device='/dev/sd1',false) as root, snapshot_id, concat(case n when 4 then concat('volume',cast(ordinal as varchar)) when 2 then concat('mapper-',f,'-x') else concat('sd',cast(n as varchar)) end,'.img') as file from v where n<>3",
    "group_report": "with l as (select l_orderkey, min(l_partkey) l_partkey from lineitem where l_linenumber=1 group by 1) select cast(l_partkey as varchar) as snapshot_id, cast(l_orderkey as varchar) as image_id, cast(0 as integer) as ordinal, '/dev/sd1' as device, true as root, 'sd1.img' as file, cast(p_size as bigint) as allocated_bytes, p_name as image_sha256 from l left join part on p_partkey=l_partkey and p_size>10",
    "volume_totals": "select cast(sum(c_nationkey) as bigint) as volume_gib, cast(sum(c_nationkey)*1073741824 as bigint) as logical_size, cast(sum(c_custkey) as bigint) as allocated_bytes from customer",
    "geometry_report": "select count(distinct case when c_nationkey>=0 then 4096 else 0 end)=1 and min(case when c_nationkey>=0 then 4096 else 0 end)>0 as ok, cast(8 as bigint) as volume_gib, min(case when c_nationkey>=0 then 4096 else 0 end) as block_size from customer",
    "preferred_artifact": "select concat('s',cast(s_suppkey as varchar),'.img') as image, case when s_suppkey%2=0 then concat('s',cast(s_suppkey as varchar),'.img.szc') when s_suppkey%3=0 then concat('s',cast(s_suppkey as varchar),'.img.zst') when s_suppkey%5>0 then concat('s',cast(s_suppkey as varchar),'.img') end as artifact from supplier",
    "readiness": "with s as (select n_name, n_nationkey%4 k, case when n_nationkey%8=1 then ' (lost)' else '' end m from nation) select count(case when k<3 then 1 end)=0 as ready, coalesce(string_agg(case when k=0 then n_name end, ', ' order by n_name),'') as pending, coalesce(string_agg(case k when 1 then concat(n_name,': error',m) when 2 then concat(n_name,': recoverable',m) end, ', ' order by n_name),'') as failed from s",
    "space_warnings": "select p_partkey, p_partkey*11 < p_size*100 + floor(p_size*100/10) as short from part",
    "progress": "select o_orderkey, round((o_orderkey%100)*cast(100 as double)/90,6) as percent, case when o_orderkey%100>0 and o_custkey>0 then round((o_orderkey%100)*1000/cast(o_custkey as double),6) end as bytes_per_second from orders",
    "error_hints": "select case when event_type='signup' then null when user_id%2=0 then 'listing and reading of the snapshot''s blocks must be granted; its encryption key must be usable as well' else 'listing and reading of the snapshot''s blocks must be granted' end as hint, count(*) as n from events group by 1",
    "listing_from_start": f"with {_AL} select idx from al where idx>=700",
    "device_files": "select p_partkey, case when p_partkey%9=0 then concat('volume',cast(p_size as varchar)) else regexp_replace(replace(concat(p_name,'/1'),'/','-'),'[^A-Za-z0-9_-]','-','g') end as file from part",
    "manifest_paths": "select p_partkey, concat(cast(p_partkey as varchar), case when p_partkey%3=2 then '.raw' else '' end, '.manifest.json') as path from part",
    "usd": "with a as (select o_orderkey, o_custkey*2/cast(10000 as double) u from orders where o_custkey%25<>0) select o_orderkey, case when u=0 then '$0' when u<0.01 then printf('$%.4f',u) when u<1 then printf('$%.3f',u) else printf('$%.2f',u) end as s from a",
    "container_roundtrip": "select doc_id, true as ok from documents",
    "ordered_image_hash": "select sha256(string_agg(coalesce(text,'') || repeat(chr(0),7), '' order by doc_id)) as image_sha256, count(*) as n_blocks from documents",
    "duplicate_payloads": "select sha256(text) as h, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*)>1",
}
