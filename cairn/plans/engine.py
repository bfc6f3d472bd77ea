"""The user's verbs on block tables: ingest, sync, plan, verify, export and read.

A table of a snapshot is a folder: data/ (Parquet: idx, byte_offset, data), manifest/ (Parquet: idx, byte_offset, length,
sha256) and geometry/ (one row, with the image's hash), written in this order, so the last marks a whole snapshot.
What replaces a whole snapshot deletes geometry/ first. Blocks are fetched in waves that are appended one after the other,
so an interrupted run goes on with what no wave has brought. Metadata and payloads are apart: plans, differences and
verification by hash never read payloads.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from cairn.functions.scalars import GIB
from cairn.operators import diff, journal, listing, manifest, payload, planner, resilience, verify
from cairn.sources import containers, snapshots


WAVE = 1 << 16  # blocks that are fetched before they are kept


@dataclass
class Result:
    snapshot: str
    new_blocks: int
    resumed: int
    zeroed: int
    allocated_bytes: int
    image_sha256: str


class Engine:
    def __init__(self, spark: SparkSession, root: str, source: str, partitions: int = 32, attempts: int = 5, wave: int = WAVE):
        self.spark, self.root, self.source, self.partitions, self.attempts, self.wave = spark, root.rstrip("/"), source, partitions, attempts, wave

    def path(self, snapshot: str, part: str) -> str:
        return f"{self.root}/{snapshot}/{part}"

    def table(self, snapshot: str, part: str) -> DataFrame:
        return self.spark.read.parquet(self.path(snapshot, part))

    def _there(self, snapshot: str, part: str) -> bool:
        try:
            self.table(snapshot, part)
        except AnalysisException:
            return False
        return True

    def _at(self, snapshot: str, part: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(snapshot, part))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _drop(self, snapshot: str, *parts: str) -> None:
        for part in parts:
            files, path = self._at(snapshot, part)
            files.delete(path, True)

    def _replace(self, snapshot: str, part: str, rows: DataFrame) -> None:
        """Writes rows beside a table that they may be read from, then puts them in its place."""
        rows.write.mode("overwrite").parquet(self.path(snapshot, f"{part}-next"))
        self._put(snapshot, part)

    def _put(self, snapshot: str, part: str) -> None:
        files, path = self._at(snapshot, part)
        files.delete(path, True)
        files.rename(self._at(snapshot, f"{part}-next")[1], path)

    def _recover(self, snapshot: str) -> None:
        """Ends a replacement that was interrupted after its rows were whole."""
        if not self._there(snapshot, "data") and self._there(snapshot, "data-next"):
            self._put(snapshot, "data")

    def _fetch_waves(self, wanted: DataFrame, snapshot: str, part: str) -> tuple[int, int]:
        """Fetches what `part` lacks of wanted blocks and appends it wave by wave: how many were fetched and were there."""
        have = 0
        if self._there(snapshot, part):
            kept = self.table(snapshot, part).select("idx").distinct().join(wanted.select("idx"), "idx", "left_semi")
            have = kept.count()
            wanted = journal.not_done(wanted, self.table(snapshot, part).select("idx"), "idx")
        wanted = wanted.persist()
        try:
            n = wanted.count()
            waves = -(-n // self.wave)
            for k in range(waves):
                now = wanted.where(F.pmod(F.xxhash64("idx"), F.lit(waves)) == k)
                self._fetched(now, snapshot).write.mode("append").parquet(self.path(snapshot, part))
        finally:
            wanted.unpersist()
        return n, have

    def listing(self, snapshot: str, first: str | None = None) -> DataFrame:
        return snapshots.listing(self.spark, self.source, snapshot, first, partitions=str(self.partitions))

    def _fetched(self, pending: DataFrame, snapshot: str) -> DataFrame:
        name, attempts = self.source, self.attempts
        return resilience.fetch(pending.repartition(self.partitions, "idx"), lambda: snapshots.make_source(name), snapshot, attempts)

    def _geometry(self, listed: DataFrame) -> dict:
        row = listing.geometry_report(listed).first()
        if not row.ok:
            raise ValueError("pages disagree on geometry, or nothing is listed")
        return {"volume_gib": row.volume_gib, "block_size": row.block_size, "logical_size": row.volume_gib * GIB}

    def _finish(self, snapshot: str, geometry: dict, new: int, resumed: int, zeroed: int) -> Result:
        data = self.table(snapshot, "data")
        digest = payload.image_hash(data, geometry["logical_size"]).first().image_sha256
        total = self.table(snapshot, "manifest").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
        row = {**geometry, "snapshot_id": snapshot, "image_sha256": digest, "allocated_bytes": total}
        self.spark.createDataFrame([row], "volume_gib long, block_size long, logical_size long, snapshot_id string, image_sha256 string, allocated_bytes long").write.mode("overwrite").parquet(self.path(snapshot, "geometry"))
        return Result(snapshot, new, resumed, zeroed, total, digest)

    def _done(self, snapshot: str) -> Result | None:
        if not self._there(snapshot, "geometry"):
            return None
        g, n = self.table(snapshot, "geometry").first(), self.table(snapshot, "manifest").count()
        return Result(snapshot, 0, n, 0, g.allocated_bytes, g.image_sha256)

    def ingest(self, snapshot: str, force: bool = False, paranoid: bool = False) -> Result:
        """All blocks of a snapshot. A whole one is not fetched again; an interrupted one goes on with what is missing, and,
        if paranoid, first hashes a sample of what it has and fetches again what is wrong."""
        if force:
            self._drop(snapshot, "geometry", "manifest", "data", "data-next", "fetched")  # the marker goes first
        elif done := self._done(snapshot):
            return done
        self._recover(snapshot)
        pages = self.listing(snapshot).persist()
        try:
            geometry = self._geometry(pages)
            blocks = listing.checked_listing(pages)
            wanted = listing.with_offset(blocks, block_size=geometry["block_size"])
            if paranoid and self._there(snapshot, "data"):
                self._drop_mismatched(snapshot)
            new, resumed = self._fetch_waves(wanted, snapshot, "data")
            if not new + resumed:
                self.spark.createDataFrame([], "idx long, byte_offset long, length long, sha256 string, data binary").write.mode("overwrite").parquet(self.path(snapshot, "data"))
        finally:
            pages.unpersist()
        self._write_manifest(snapshot)
        return self._finish(snapshot, geometry, new, resumed, 0)

    def _drop_mismatched(self, snapshot: str, sample: int = journal.SAMPLE) -> None:
        """Takes blocks of a sample whose bytes do not give their checksum out of the table."""
        data = self.table(snapshot, "data")
        rows = data.select("idx", "byte_offset", "length", "sha256").dropDuplicates(["idx"])
        wrong = [r.byte_offset for r in verify.verify_sample(rows, data, sample).where("status <> 'ok'").collect()]  # of the sample
        if wrong:
            self._replace(snapshot, "data", data.where(~F.col("byte_offset").isin(wrong)))

    def _write_manifest(self, snapshot: str) -> None:
        # a task that ran twice may have left equal rows
        rows = self.table(snapshot, "data").select("idx", "byte_offset", "length", "sha256").dropDuplicates(["idx"])
        rows.write.mode("overwrite").parquet(self.path(snapshot, "manifest"))

    def ingest_group(self, names: list[str]) -> list[Result]:
        return [self.ingest(name) for name in names]

    def ingest_image(self, images: DataFrame, image_id: str, root_only: bool = False) -> DataFrame:
        """All volumes of an image (listing.IMAGES) that have a snapshot, one after the other, since each takes the whole
        cluster. Gives listing.group_report: a row for each volume."""
        volumes = listing.image_volumes(images.where(F.col("image_id") == image_id), root_only)
        names = [r.snapshot_id for r in volumes.select("snapshot_id").distinct().orderBy("snapshot_id").collect()]  # volumes of one image
        if not names:
            raise ValueError(f"{image_id} has no volume with a snapshot" + " on its root device" * root_only)
        done = [(r.snapshot, r.allocated_bytes, r.image_sha256) for r in self.ingest_group(names)]
        return listing.group_report(volumes, self.spark.createDataFrame(done, "snapshot_id string, allocated_bytes long, image_sha256 string"))

    def sync(self, base: str, target: str) -> Result:
        """target from base: only blocks that changed are fetched; the image equals that of a full ingest. An interrupted
        sync goes on with the blocks that it has not fetched."""
        if done := self._done(target):
            return done
        if not self._there(base, "geometry"):
            raise ValueError(f"{base} is not whole")
        old = self.table(base, "geometry").first().asDict()
        if not manifest.base_usable(self.table(base, "manifest"), old["image_sha256"]):
            raise ValueError(f"{base} has no image hash, or blocks without a checksum")
        if self.verify(base, sample=journal.SAMPLE).where("status <> 'ok'").first() is not None:
            raise ValueError(f"{base} does not match its manifest")
        changed = self.listing(target, base).persist()
        try:
            geometry = self._geometry(changed) if changed.first() is not None else {k: old[k] for k in ("volume_gib", "block_size", "logical_size")}
            if error := manifest.lineage_error(old, geometry):
                raise ValueError(error)
            entries = changed.select("idx", F.col("token").alias("second_token"), "expiry")
            counters = diff.delta_manifest(self.table(base, "manifest"), entries, geometry["block_size"])[2].first()
            wanted = listing.with_offset(diff.data_bearing(entries).withColumnRenamed("second_token", "token"), block_size=geometry["block_size"])
            self._fetch_waves(wanted, target, "fetched")
            columns = ["idx", "byte_offset", "length", "sha256", "data"]
            rows = self.table(base, "data").join(entries.select("idx"), "idx", "left_anti").select(columns)
            if self._there(target, "fetched"):
                rows = rows.unionByName(self.table(target, "fetched").dropDuplicates(["idx"]).select(columns))
            rows.write.mode("overwrite").parquet(self.path(target, "data"))
        finally:
            changed.unpersist()
        self._write_manifest(target)
        result = self._finish(target, geometry, counters.changed, counters.reused, counters.zeroed)
        self._drop(target, "fetched")
        return result

    def plan(self, snapshot: str, base: str | None = None, rate: float = planner.EGRESS_USD_PER_GB) -> DataFrame:
        """What an ingest or a sync would cost: gets, nbytes at most, unchanged, and the columns of planner.cost."""
        listed = self.listing(snapshot, base)
        if base:
            old = self.table(base, "manifest").select("idx")
            listed = listed.withColumn("_data", F.col("token") != "")
            unchanged = old.join(listed.select("idx"), "idx", "left_anti").agg(F.count("*").alias("unchanged"))
        else:
            listed = listed.withColumn("_data", F.lit(True))
            unchanged = self.spark.range(1).select(F.lit(0).cast("long").alias("unchanged"))
        need = listed.agg(F.count(F.when(F.col("_data"), 1)).alias("gets"), F.coalesce(F.sum(F.when(F.col("_data"), F.col("block_size"))), F.lit(0)).alias("nbytes"))
        return planner.cost(need.crossJoin(unchanged), rate)

    def space_warning(self, plan: DataFrame, free: int) -> bool:
        """Whether what a plan may store leaves too little of `free` bytes."""
        return bool(plan.select(planner.short_of_space(F.lit(free), F.col("nbytes")).alias("short")).first().short)

    def verify(self, snapshot: str, sample: int = 0) -> DataFrame:
        """byte_offset, status of all manifest blocks, or of a sample at even strides."""
        rows, data = self.table(snapshot, "manifest"), self.table(snapshot, "data")
        return verify.verify_sample(rows, data, sample) if sample else verify.verify_blocks(rows, data)

    def verify_image(self, snapshot: str) -> bool:
        g = self.table(snapshot, "geometry").first()
        return payload.image_hash(self.table(snapshot, "data"), g.logical_size).first().image_sha256 == g.image_sha256

    def export_container(self, snapshot: str, path: str, level: int = 3) -> dict:
        g = self.table(snapshot, "geometry").first()
        frames = payload.encode_frames(self.table(snapshot, "data"), level)
        return containers.export_container(frames, path, snapshot, g.volume_gib, g.block_size, g.logical_size, g.image_sha256)

    def stream(self, snapshot: str, path: str, level: int = 3) -> dict:
        """A container straight from the source: blocks are compressed where they are fetched, so raw payloads are never
        stored; the frames are written once, hashed in order and put into one file. Not resumable."""
        pages = self.listing(snapshot).persist()
        try:
            geometry = self._geometry(pages)
            wanted = listing.with_offset(listing.checked_listing(pages), block_size=geometry["block_size"])
            payload.encode_frames(self._fetched(wanted, snapshot), level).write.mode("overwrite").parquet(self.path(snapshot, "frames"))
        finally:
            pages.unpersist()
        frames = self.table(snapshot, "frames").dropDuplicates(["idx"])
        digest = payload.image_hash(payload.decode_frames(frames), geometry["logical_size"]).first().image_sha256
        return containers.export_container(frames, path, snapshot, geometry["volume_gib"], geometry["block_size"], geometry["logical_size"], digest)

    def export_image(self, snapshot: str, path: str) -> None:
        containers.write_image(self.table(snapshot, "data"), path, self.table(snapshot, "geometry").first().logical_size)

    def read_range(self, snapshot: str, offset: int, length: int) -> bytes:
        """Bytes of the image; only blocks that the range touches are read."""
        g = self.table(snapshot, "geometry").first()
        if offset < 0 or length < 0 or offset + length > g.logical_size:
            raise ValueError("the range is out of bounds")
        out = bytearray(length)
        touched = F.col("idx").between(offset // g.block_size, (offset + length - 1) // g.block_size)
        for r in self.table(snapshot, "data").where(touched).select("byte_offset", "data").toLocalIterator():
            low, high = max(offset, r.byte_offset), min(offset + length, r.byte_offset + len(r.data))
            if low < high:
                out[low - offset : high - offset] = r.data[low - r.byte_offset : high - r.byte_offset]
        return bytes(out)
