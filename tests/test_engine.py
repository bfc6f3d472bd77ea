"""The verbs end to end on a source in memory: equal images by every way, faults, resumption, containers and archives."""

from __future__ import annotations

import base64
import hashlib

import pytest

from cairn.functions.scalars import GIB
from cairn.operators import payload, resilience
from cairn.plans.engine import Engine
from cairn.sources import containers, snapshots
from cairn.sources.snapshots import MemorySource, Snapshot, made_snapshot

SIZE = 4096


def edited(base: Snapshot) -> Snapshot:
    """Five blocks modified (one to zeros), three removed, four added."""
    blocks, places = dict(base.blocks), [i for i in sorted(base.blocks) if any(base.blocks[i])]
    for i in places[:4]:
        blocks[i] = bytes(reversed(blocks[i]))
    blocks[places[4]] = bytes(SIZE)
    for i in places[10:13]:
        del blocks[i]
    free = (i for i in range(1 << 18) if i not in base.blocks)
    for _ in range(4):
        blocks[next(free)] = b"new!" * (SIZE // 4)
    return Snapshot(base.volume_gib, blocks, SIZE)


def test_source() -> MemorySource:
    base = made_snapshot(5, 1, 40, SIZE, zero_every=7)
    return MemorySource({"a": base, "b": edited(base), "bad": Snapshot(2, {1: b"x" * SIZE}, 8192)}, page_size=7)


test_source.__test__ = False
NAME = f"{__name__}:test_source"


def image_hash(snapshot: Snapshot) -> str:
    digest, at = hashlib.sha256(), 0
    for i, data in sorted(snapshot.blocks.items()):
        digest.update(bytes(i * SIZE - at))
        digest.update(data)
        at = i * SIZE + len(data)
    rest = snapshot.volume_gib * GIB - at
    while rest:
        n = min(rest, 1 << 26)
        digest.update(bytes(n))
        rest -= n
    return digest.hexdigest()


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("tables")), NAME, partitions=3)


def test_listing(spark):
    source = test_source()
    rows = snapshots.listing(spark, NAME, "a", partitions="4").collect()
    assert sorted((r.idx, r.token) for r in rows) == sorted(source.list_page("a", most=10**6).blocks + [x for x in _all(source, "a")][7:])
    changed = {r.idx: r.token for r in snapshots.listing(spark, NAME, "b", "a").collect()}
    assert len(changed) == 12 and sum(t == "" for t in changed.values()) == 3


def _all(source, snapshot):
    token = None
    while True:
        page = source.list_page(snapshot, token)
        yield from page.blocks
        if not (token := page.next_token):
            return


def test_ingest_sync_verify_export(spark, engine, tmp_path):
    source = test_source()
    a = engine.ingest("a")
    assert (a.new_blocks, a.resumed) == (40, 0) and a.image_sha256 == image_hash(source.snapshots["a"])
    assert engine.ingest("a").new_blocks == 0
    b = engine.sync("a", "b")
    assert b.image_sha256 == image_hash(source.snapshots["b"])  # blocks that became zeros too
    assert (b.new_blocks, b.zeroed, b.resumed) == (9, 3, 32)
    assert {r.status for r in engine.verify("b").collect()} == {"ok"} and engine.verify("b").count() == 41
    plan = engine.plan("b", "a").first()
    assert (plan.gets, plan.unchanged) == (9, 32) and engine.plan("a").first().gets == 40
    with pytest.raises(ValueError, match="block sizes"):
        engine.sync("a", "bad")

    path = str(tmp_path / "b.img.szc")
    trailer = engine.export_container("b", path)
    zeros = sum(not any(d) for d in source.snapshots["b"].blocks.values())
    assert len(trailer["chunks"]) == 41 - zeros and payload.verify_container(path)["image_sha256"] == b.image_sha256
    rows = {r.byte_offset: bytes(r.data) for r in containers.read_container(spark, path, chunks_per_partition="5").collect()}
    assert rows == {i * SIZE: d for i, d in source.snapshots["b"].blocks.items() if any(d)}
    some = sorted(source.snapshots["b"].blocks)[20]
    for start, n in ((some * SIZE - 100, 300), (0, 9000), (some * SIZE + 5, 10), (GIB - 7, 7), (3, 0)):
        want = bytes(engine.read_range("b", start, n))
        assert payload.read_range(path, start, n) == want and len(want) == n
    with pytest.raises(ValueError, match="bounds"):
        payload.read_range(path, GIB - 1, 2)


def test_streamed_container_has_the_same_image(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "t"), NAME, partitions=3)
    path = str(tmp_path / "a.szc")
    engine.stream("a", path)
    assert payload.verify_container(path)["image_sha256"] == image_hash(test_source().snapshots["a"])
    plan = engine.plan("a")
    assert engine.space_warning(plan, 40 * SIZE) and not engine.space_warning(plan, 50 * SIZE)


def test_interrupted_ingest_goes_on(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), NAME, partitions=2)
    whole = engine.ingest("a")
    import shutil

    shutil.rmtree(tmp_path / "a" / "geometry")
    kept = spark.read.parquet(str(tmp_path / "a" / "data")).orderBy("idx").limit(25)
    kept.write.parquet(str(tmp_path / "part"))
    shutil.rmtree(tmp_path / "a" / "data")
    (tmp_path / "part").rename(tmp_path / "a" / "data")
    again = engine.ingest("a")
    assert (again.new_blocks, again.resumed, again.image_sha256) == (15, 25, whole.image_sha256)


def container(tmp_path):
    chunks = [(0, b"a" * SIZE), (2 * SIZE, b"b" * SIZE), (5 * SIZE, b"c" * (SIZE // 2))]
    import pyarrow as pa

    frames = [(at, len(d), hashlib.sha256(d).hexdigest(), pa.Codec("zstd").compress(d, asbytes=True)) for at, d in chunks]
    image = bytearray(16 * SIZE)
    for at, d in chunks:
        image[at : at + len(d)] = d
    path = str(tmp_path / "x.szc")
    payload.write_container(frames, path, "s", 1, SIZE, len(image), hashlib.sha256(image).hexdigest())
    return path, image, frames


def test_container_rejects(tmp_path):
    path, image, frames = container(tmp_path)
    assert payload.verify_container(path)["chunks"] == 3
    assert payload.read_range(path, 0, len(image)) == image
    with open(path, "rb") as f:
        raw = f.read()
    trailer = payload.open_container(path)
    cases = {"version": b"XXXX" + raw[4:], "footer": raw[:-5], "CRC": raw[:-20] + bytes([raw[-20] ^ 1]) + raw[-19:], "small": raw[:10]}
    for what, bad in cases.items():
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError, match=what):
            payload.open_container(str(tmp_path / "bad"))
    at = trailer["chunks"][1]["s"] + trailer["chunks"][1]["c"] - 2
    (tmp_path / "bad").write_bytes(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :])
    with pytest.raises((ValueError, OSError)):
        payload.verify_container(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="order"):
        payload.write_container(reversed(frames), str(tmp_path / "no"), "s", 1, SIZE, len(image), "")
    assert not (tmp_path / "no").exists()


def test_images_and_archives(spark, tmp_path):
    blocks = spark.createDataFrame([(SIZE, bytearray(b"q" * SIZE)), (9 * SIZE, bytearray(SIZE))], "byte_offset long, data binary")
    raw, archive, back = (str(tmp_path / n) for n in ("i.img", "i.img.zst", "back.img"))
    containers.write_image(blocks, raw, 5 << 20)
    image = bytearray(5 << 20)
    image[SIZE : 2 * SIZE] = b"q" * SIZE
    assert (tmp_path / "i.img").read_bytes() == image and containers.disk_use(raw)[0] < 1 << 20
    said = containers.compress_image(raw, archive)
    assert said["image_sha256"] == hashlib.sha256(image).hexdigest()
    containers.restore_image(archive, back, len(image), said["image_sha256"])
    assert (tmp_path / "back.img").read_bytes() == image and containers.disk_use(back)[0] < 5 << 20
    with pytest.raises(ValueError, match="another"):
        containers.restore_image(archive, None, len(image), "0" * 64)
    with pytest.raises(ValueError, match="bounds"):
        containers.write_image(blocks, raw, SIZE)


def failing(*errors):
    left = list(errors)
    return lambda what, n: left.pop(0) if what == "get" and left else None


def test_fetch_faults():
    data = {3: b"d" * 8}
    make = lambda *errors: MemorySource({"s": Snapshot(1, data, 8)}, fail=failing(*errors))
    quiet = {"sleep": lambda s: None}
    slow = resilience.SourceError("ThrottlingException")
    hits = []
    source = make(slow, resilience.SourceError("InternalError"))
    assert resilience.fetch_block(source, "s", 3, "g0-s-i3", on_throttle=lambda: hits.append(1), **quiet) == data[3] and len(hits) == 1
    source = make(slow, slow, slow)
    with pytest.raises(resilience.SourceError):
        resilience.fetch_block(source, "s", 3, "g0-s-i3", attempts=2, on_throttle=lambda: hits.append(1), **quiet)
    assert source.calls["get"] == 2 and len(hits) == 3
    source = make()
    assert resilience.fetch_block(source, "s", 3, "old", **quiet) == data[3] and source.calls == {"list": 1, "get": 2}
    source = make(*[resilience.SourceError("AccessDenied")] * 2)
    with pytest.raises(resilience.SourceError, match="AccessDenied"):
        resilience.fetch_block(source, "s", 3, "g0-s-i3", **quiet)
    assert source.calls["get"] == 2
    with pytest.raises(resilience.SourceError, match="match"):
        resilience.checked_block(b"x", base64.b64encode(bytes(32)).decode())
    assert 0.25 <= resilience.delay(0, False) <= 0.5 and 15 <= resilience.delay(12, True) <= 30


def test_tokens_are_renewed_by_pages_before_they_expire():
    import datetime

    start = datetime.datetime(2024, 1, 1)
    blocks = {i: bytes([i]) * 8 for i in range(20)}
    source = MemorySource({"s": Snapshot(1, blocks, 8)}, page_size=8, expiry=start + datetime.timedelta(minutes=10))
    clock = [start]
    tokens = resilience.Tokens(source, "s", now=lambda: clock[0], sleep=lambda s: None)
    tokens.learn([(i, f"g0-s-i{i}") for i in range(20)], start + datetime.timedelta(minutes=3))
    get = lambda i: resilience.fetch_block(source, "s", i, "", tokens=tokens, sleep=lambda s: None)
    assert get(0) == blocks[0] and source.calls == {"list": 0, "get": 1}
    clock[0] += datetime.timedelta(minutes=1, seconds=1)  # under two minutes are left
    assert [get(i) for i in range(8)] == [blocks[i] for i in range(8)] and source.calls["list"] == 1
    assert [get(i) for i in range(8, 16)] == [blocks[i] for i in range(8, 16)] and source.calls["list"] == 2
    source.generation, calls = 1, source.calls["get"]  # all tokens are denied; each denied one lists a page
    assert get(8) == blocks[8] and get(9) == blocks[9] and (source.calls["list"], source.calls["get"]) == (3, calls + 3)
    with pytest.raises(resilience.SourceError, match="not listed"):
        get(99)
    late = resilience.Tokens(source, "s", now=lambda: clock[0])
    late.learn([(1, "wrong")], None)
    failing_twice = [resilience.SourceError("InternalError"), resilience.SourceError("InternalError")]
    source.fail = lambda what, n: failing_twice.pop() if what == "get" and failing_twice else None
    assert resilience.fetch_block(source, "s", 1, "", tokens=late, sleep=lambda s: None) == blocks[1]


def test_waves_resume_and_force_deletes_the_marker_first(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path), NAME, partitions=2, wave=10)
    own, calls = Engine._fetched, []

    def stops(self, pending, snapshot):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return own(self, pending, snapshot)

    monkeypatch.setattr(Engine, "_fetched", stops)
    with pytest.raises(RuntimeError):
        engine.ingest("a")
    kept = engine.table("a", "data").count()
    again = engine.ingest("a")
    want = image_hash(test_source().snapshots["a"])
    assert 0 < kept < 40 and (again.resumed, again.new_blocks, again.image_sha256) == (kept, 40 - kept, want)
    calls[:] = [1, 1]
    with pytest.raises(RuntimeError):
        engine.ingest("a", force=True)
    assert not engine._there("a", "geometry") and engine._done("a") is None
    assert engine.ingest("a").image_sha256 == want


def test_paranoid_resumption_fetches_wrong_blocks_again(spark, tmp_path):
    import shutil

    import pyspark.sql.functions as F

    engine = Engine(spark, str(tmp_path), NAME, partitions=2)
    whole = engine.ingest("a")
    shutil.rmtree(tmp_path / "a" / "geometry")
    first = engine.table("a", "data").agg(F.min("idx")).first()[0]
    engine._replace("a", "data", engine.table("a", "data").withColumn("data", F.when(F.col("idx") == first, F.lit(b"x" * SIZE)).otherwise(F.col("data"))))
    again = engine.ingest("a", paranoid=True)
    assert (again.new_blocks, again.resumed, again.image_sha256) == (1, 39, whole.image_sha256)
    (tmp_path / "a" / "data").rename(tmp_path / "a" / "data-next")  # as if a replacement stopped half way
    shutil.rmtree(tmp_path / "a" / "geometry")
    assert engine.ingest("a").new_blocks == 0


def test_sync_goes_on_and_wants_a_usable_base(spark, tmp_path, monkeypatch):
    import pyspark.sql.functions as F

    engine = Engine(spark, str(tmp_path), NAME, partitions=2, wave=4)
    engine.ingest("a")
    own, calls = Engine._fetched, []

    def stops(self, pending, snapshot):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return own(self, pending, snapshot)

    monkeypatch.setattr(Engine, "_fetched", stops)
    with pytest.raises(RuntimeError):
        engine.sync("a", "b")
    kept = engine.table("b", "fetched").count()
    b = engine.sync("a", "b")
    assert 0 < kept < 9 and b.image_sha256 == image_hash(test_source().snapshots["b"]) and (b.new_blocks, b.zeroed, b.resumed) == (9, 3, 32)
    assert not engine._there("b", "fetched")
    engine._drop("b", "geometry", "data", "manifest")
    engine._replace("a", "manifest", engine.table("a", "manifest").withColumn("sha256", F.lit("")))
    with pytest.raises(ValueError, match="without a checksum"):
        engine.sync("a", "b")


def test_sample_reads_only_its_blocks(spark, engine):
    from cairn.operators import verify

    engine.ingest("a")
    rows = verify.verify_sample(engine.table("a", "manifest"), engine.table("a", "data"), 8)
    assert rows.count() == 8 and {r.status for r in rows.collect()} == {"ok"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In(byte_offset" in plan


def test_images_and_their_folders_are_verified(spark, tmp_path):
    from cairn.operators import listing
    from cairn.sources import artifacts, manifests

    engine = Engine(spark, str(tmp_path / "t"), NAME, partitions=2)
    images = spark.createDataFrame([("i1", "/dev/xvda", [("/dev/xvda", "a"), ("/dev/sdb", "b"), ("/dev/sdc", None)])], listing.IMAGES)
    report = engine.ingest_image(images, "i1").orderBy("ordinal").collect()
    assert [(r.snapshot_id, r.file, r.image_sha256) for r in report] == [(n, f, image_hash(test_source().snapshots[n])) for n, f in (("a", "xvda.img"), ("b", "sdb.img"))]
    assert engine.ingest_image(images, "i1", root_only=True).count() == 1
    with pytest.raises(ValueError, match="no volume"):
        engine.ingest_image(images, "i2")
    folder = str(tmp_path / "out")
    paths = artifacts.output_paths("i1", folder, [r.file for r in report])
    for r, path in zip(report, paths, strict=True):
        engine.export_image(r.snapshot_id, path["image"])
        g = engine.table(r.snapshot_id, "geometry").first()
        header = {"snapshotId": r.snapshot_id, "volumeSizeGiB": g.volume_gib, "blockSize": g.block_size, "logicalSize": g.logical_size, "imageSha256": g.image_sha256}
        manifests.write(spark, header, engine.table(r.snapshot_id, "manifest"), path["manifest"])
    artifacts.write_group(listing.image_volumes(images), "i1", folder)
    assert [x["blocks"] for x in artifacts.verify(spark, folder)] == [40, 41]
    import os

    archive = paths[0]["image"] + ".zst"
    containers.compress_image(paths[0]["image"], archive)
    os.unlink(paths[0]["image"])
    engine.export_container("b", paths[1]["image"] + ".szc")
    found = artifacts.verify(spark, folder)
    assert [x["path"].rsplit("/", 1)[1] for x in found] == ["xvda.img.zst", "sdb.img.szc"] and found[0]["image_sha256"] == report[0].image_sha256
    with open(paths[1]["image"], "r+b") as f:
        f.seek(min(test_source().snapshots["b"].blocks) * SIZE)
        f.write(b"??")
    with pytest.raises(ValueError, match="do not match"):
        artifacts.verify(spark, paths[1]["image"])
    with pytest.raises(ValueError, match="is no"):
        artifacts.verify(spark, paths[1]["manifest"])
    os.unlink(archive)
    with pytest.raises(ValueError, match="nothing of"):
        artifacts.verify(spark, folder)


def test_paths_and_options(tmp_path):
    from cairn.sources import artifacts

    assert artifacts.output_paths("s", str(tmp_path)) == [{"image": f"{tmp_path}/s.img", "manifest": f"{tmp_path}/s.manifest.json"}]
    assert artifacts.output_paths("s", f"{tmp_path}/x.img")[0]["manifest"] == f"{tmp_path}/x.manifest.json"
    assert artifacts.manifest_of("/a/b.img.zst") == "/a/b.manifest.json" and artifacts.manifest_of("/a/b") == "/a/b.manifest.json"
    artifacts.checked_options(level=19, keep_raw=True)
    for bad in ({"level": 0}, {"level": 20}, {"keep_raw": True, "compress": False}, {"stream": True, "base": "m"}, {"stream": True, "keep_raw": True}, {"stream": True, "compress": False}):
        with pytest.raises(ValueError, match="level|raw|stream"):
            artifacts.checked_options(**bad)


def test_journal_writer(spark, tmp_path):
    from cairn.operators import journal

    path = str(tmp_path / "j")
    w = journal.Writer(path, "s", 5, "base")
    w.record(1, 8, "x")
    w.record(2, 8, "y")
    assert len((tmp_path / "j").read_bytes().splitlines()) == 1  # nothing is durable before the checkpoint
    w.checkpoint()
    w.clear(1)
    w.close()
    with open(path, "ab") as f:
        f.write(b'{"o":3,"le')  # torn
    w = journal.Writer(path, "s", 5, "base")
    w.record(4, 8, "z")
    w.close()
    rows = journal.replayed(journal.read(spark, path, "s", 5, "base")).collect()
    assert sorted((r.o, r.sha) for r in rows) == [(2, "y"), (4, "z")]
    with pytest.raises(journal.JournalMismatch):
        journal.read(spark, path, "s", 5)


class FakeClient:
    """The remote API over a source in memory; page sizes above 5 are rejected."""

    def __init__(self, source, most=5):
        self.source, self.most, self.sizes = source, most, []

    class Error(Exception):
        def __init__(self, code, message):
            self.response = {"Error": {"Code": code, "Message": message}}

    def _said(self, page, name, entries):
        import datetime

        expiry = datetime.datetime(2024, 1, 1, 2, tzinfo=datetime.timezone(datetime.timedelta(hours=2)))
        said = {name: entries, "VolumeSize": page.volume_gib, "BlockSize": page.block_size, "ExpiryTime": expiry}
        return said | ({"NextToken": page.next_token} if page.next_token else {})

    def _checked(self, size):
        self.sizes.append(size)
        if size and size > self.most:
            raise self.Error("ValidationException", "MaxResults is too large")

    def list_snapshot_blocks(self, SnapshotId, NextToken=None, StartingBlockIndex=0, MaxResults=None):  # noqa: N803
        self._checked(MaxResults)
        page = self.source.list_page(SnapshotId, NextToken, StartingBlockIndex, MaxResults)
        return self._said(page, "Blocks", [{"BlockIndex": i, "BlockToken": t} for i, t in page.blocks])

    def list_changed_blocks(self, FirstSnapshotId, SecondSnapshotId, NextToken=None, StartingBlockIndex=0, MaxResults=None):  # noqa: N803
        self._checked(MaxResults)
        page = self.source.list_changed_page(FirstSnapshotId, SecondSnapshotId, NextToken, StartingBlockIndex, MaxResults)
        return self._said(page, "ChangedBlocks", [{"BlockIndex": i, "FirstBlockToken": "x"} | ({"SecondBlockToken": t} if t else {}) for i, t in page.blocks])

    def get_snapshot_block(self, SnapshotId, BlockIndex, BlockToken):  # noqa: N803
        import io

        try:
            data, checksum = self.source.get_block(SnapshotId, BlockIndex, BlockToken)
        except resilience.SourceError as error:
            raise self.Error(error.code, "") from error
        return {"BlockData": io.BytesIO(data), "Checksum": checksum, "ChecksumAlgorithm": "SHA256"}


def test_remote_source():
    import datetime

    from cairn.sources import remote

    memory = test_source()
    client = FakeClient(memory)
    source = remote.ServiceSource(client)
    page = source.list_page("a")
    assert client.sizes == [10_000, None] and len(page.blocks) == 7 and page.expiry == datetime.datetime(2024, 1, 1) and (page.volume_gib, page.block_size) == (1, SIZE)
    assert list(_all(source, "a")) == list(_all(memory, "a")) and set(client.sizes[2:]) == {None}
    changed = source.list_changed_page("a", "b")
    assert changed.blocks == memory.list_changed_page("a", "b").blocks
    index, token = page.blocks[0]
    assert resilience.fetch_block(source, "a", index, token) == memory.snapshots["a"].blocks[index]
    assert resilience.fetch_block(source, "a", index, "old", sleep=lambda s: None) == memory.snapshots["a"].blocks[index]
    with pytest.raises(resilience.SourceError, match="AccessDenied"):
        source.get_block("a", index, "old")
    assert [s for s in remote.ServiceSource(client, 5).list_page("a").blocks] == page.blocks[:5]
    assert resilience.is_retryable(remote.typed(ConnectionError("gone")))
