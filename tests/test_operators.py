"""Operators of the block model against plain versions, and the values that their formats fix."""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import random

import pyspark.sql.functions as F
import pytest

from cairn.functions import scalars
from cairn.operators import diff, extents, journal, listing, manifest, payload, planner, resilience, verify
from cairn.plans import ordered
from cairn.streaming import journals, readiness

b64 = lambda data: base64.b64encode(hashlib.sha256(data).digest()).decode()


def column(spark, values, kind, f):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_formats(spark):
    assert column(spark, [0.0, 0.000303, 0.09, 0.5, 3.996, 13.5], "double", scalars.usd) == ["$0", "$0.0003", "$0.090", "$0.500", "$4.00", "$13.50"]
    assert column(spark, [0, 999, 1000, 81920, 1234], "long", scalars.human_count) == ["0", "999", "1,000", "81,920", "1,234"]
    assert column(spark, [0, 1023, 1024, 3 << 20, 5 << 30], "long", scalars.human_bytes) == ["0 B", "1023 B", "1.0 KiB", "3.0 MiB", "5.00 GiB"]
    assert column(spark, ["/dev/sda1", "/dev/", None, "a b/c"], "string", lambda c: scalars.device_name(c, F.lit(3))) == ["sda1", "volume3", "volume3", "a-b-c"]
    assert column(spark, ["x.img", "x.bin", "d/x.img.zst"], "string", scalars.manifest_path) == ["x.manifest.json", "x.bin.manifest.json", "d/x.manifest.json"]
    assert column(spark, [0.0, 3.6], "double", lambda c: scalars.egress_note(F.lit(40.0), F.lit(0.09), c)) == ["", "; egress 40.0 GB @ $0.090/GB = $3.60"]
    assert column(spark, [bytearray(), bytearray(4), bytearray(b"\0a")], "binary", scalars.is_zero) == [True, True, False]
    assert column(spark, [bytearray(b"abc")], "binary", scalars.block_checksum) == [b64(b"abc")]


def test_errors_and_tokens(spark):
    assert column(spark, ["Throttling", "SlowDown", "AccessDenied", "Other"], "string", scalars.error_class) == ["throttle", "server", "denied", "other"]
    assert column(spark, ["ECONNRESET", "ChecksumMismatch", "AccessDenied", None], "string", lambda c: scalars.is_retryable(c, F.lit(None).cast("string"))) == [True, True, False, False]
    assert column(spark, [None, "Other"], "string", lambda c: scalars.is_retryable(c, F.lit("unexpected EOF"))) == [True, False]
    now = datetime.datetime(2024, 1, 1, 12)
    expiry = [None, now + datetime.timedelta(minutes=2), now + datetime.timedelta(seconds=119)]
    assert column(spark, expiry, "timestamp_ntz", lambda c: scalars.token_fresh(c, F.lit(now).cast("timestamp_ntz"))) == [True, True, False]


@pytest.mark.parametrize("bits", [1, 4, 40])
def test_ordered_windows(spark, bits):
    rng = random.Random(bits)
    places = sorted(rng.sample(range(-50, 400), 60))
    rows = [(p, rng.randrange(100)) for p in places]
    df = spark.createDataFrame(rows, "i long, v long").repartition(5)
    got = df
    got = ordered.previous(got, "i", "v", "before", bits=bits)
    got = ordered.following(got, "i", "v", "after", bits=bits)
    got = ordered.ordinal(got, "i", "n", bits=bits)
    got = ordered.sum_before(got, "i", F.col("v"), "s", bits=bits).orderBy("i").collect()
    values = [v for _, v in rows]
    assert [r.before for r in got] == [None, *values[:-1]] and [r.after for r in got] == [*values[1:], None]
    assert [r.n for r in got] == list(range(60)) and [r.s for r in got] == [sum(values[:k]) for k in range(60)]


def test_extents(spark):
    rng = random.Random(8)
    used = sorted(rng.sample(range(0, 200_000), 500) + list(range(300_000, 300_400)))
    blocks = spark.createDataFrame([(i,) for i in used], "idx long")
    runs, at = [], None
    for i in used:
        if at is not None and i == at + 1:
            runs[-1][1] = at = i
        else:
            runs.append([i, i])
            at = i
    assert sorted((r.first_idx, r.last_idx, r.n) for r in extents.islands(blocks).collect()) == [(a, b, b - a + 1) for a, b in runs]
    want = [(b + 1, c - b - 1) for (_, b), (c, _) in zip(runs, runs[1:], strict=False)]
    assert sorted(tuple(r) for r in extents.holes(blocks).collect()) == want
    ends = [(0, runs[0][0])] * (runs[0][0] > 0) + want + [(runs[-1][1] + 1, 400_000 - runs[-1][1] - 1)]
    assert sorted(tuple(r) for r in extents.holes(blocks, end=400_000).collect()) == ends
    assert [tuple(r) for r in extents.holes(blocks.limit(0), end=7).collect()] == [(0, 7)]
    asked = spark.createDataFrame([(i,) for i in range(0, 310_000, 997)] + [(300_399,), (300_400,)], "at long")
    got = {r.at: r.next_offset for r in extents.next_chunk(asked, blocks, "at", "idx", bits=12).collect()}
    assert got == {a: next((u for u in used if u >= a), None) for a in got} and len(got) == asked.count()


@pytest.mark.parametrize("longest", [5, 3000, 1 << 40])
def test_read_plan_lists_no_blocks(spark, longest):
    """Byte by byte, and ranges of more blocks than could be rows."""
    rng, size = random.Random(longest), 10
    known = sorted({rng.randrange(400) for _ in range(150)} | {63, 64, 127, 1 << 36})
    asks = [(i // 2, a := rng.randrange(4000), a + rng.choice([0, 1, rng.randrange(longest)])) for i in range(60)] + [(90, 639, 641), (91, None, 5), (92, 5, None), (93, 4, 9 * longest)]
    held = lambda x: sum(size for b in known if (b + 1) * size <= x) + (x % size if x // size in known else 0)
    want: dict = {}
    for i, a, z in asks:
        if a is not None and z is not None:
            total, zero = want.get(i, (0, 0))
            want[i] = total + z - a, zero + z - a - held(z) + held(a)
    got = extents.read_plan(spark.createDataFrame(asks, "id long, a long, z long"), spark.createDataFrame([(b,) for b in known], "idx long"), size)
    assert {r.id: (r.total_bytes, r.zero_bytes) for r in got.collect()} == want
    assert not [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "sequence(" in line]


def test_listing_rules(spark):
    schema = "page int, position int, idx long, token string, expiry timestamp, volume_gib long, block_size long"
    rows = [(n // 10, n % 10, n, f"t-{n}", None, 8, 524288) for n in range(25)]
    listed = listing.checked_listing(spark.createDataFrame(rows, schema))
    assert listed.count() == 25 and listed.where("idx = 7").first().token == "t-7"
    with pytest.raises(ValueError, match="rise"):
        listing.checked_listing(spark.createDataFrame([(0, 0, 5, "", None, 8, 1), (0, 1, 3, "", None, 8, 1)], schema))
    with pytest.raises(ValueError, match="geometry"):
        listing.checked_listing(spark.createDataFrame([(0, 0, 5, "", None, 8, 1), (1, 0, 6, "", None, 9, 1)], schema))
    assert column(spark, [0, 1, 10_000, 10_001, 81_920], "long", listing.page_count) == [1, 1, 1, 2, 9]


def test_delta_rules(spark):
    base = [(i, i * 8, 8, f"c{i}") for i in range(10)]
    changed = [(2, "t"), (3, ""), (20, "t"), (21, "")]
    blocks, zero, counters = diff.delta_manifest(spark.createDataFrame(base, "idx long, byte_offset long, length long, sha256 string"), spark.createDataFrame(changed, "idx long, second_token string"), 8)
    got = {r.idx: (r.byte_offset, r.length, r.sha256) for r in blocks.collect()}
    want = {i: (i * 8, 8, f"c{i}") for i in range(10) if i not in (2, 3)} | {2: (16, 0, ""), 20: (160, 0, "")}
    assert got == want
    assert [tuple(r) for r in zero.collect()] == [(24, 8)]
    assert counters.first().asDict() == {"changed": 2, "zeroed": 1, "reused": 8, "new_blocks": 1}


def test_a_block_that_becomes_zeros_replaces_the_old_one(spark):
    data = spark.createDataFrame([(0, bytearray(b"old")), (1, bytearray(b"keep"))], "idx long, data binary")
    fetched = spark.createDataFrame([(0, bytearray(3))], "idx long, data binary")
    rows = diff.apply_delta(data, fetched, data.select("idx").limit(0))
    assert {r.idx: bytes(r.data) for r in rows.collect()} == {0: b"\0\0\0", 1: b"keep"}


VALID = {"version": 1, "kind": "snapshot", "snapshotId": "snap-1", "volumeSizeGiB": 2, "blockSize": 524288, "logicalSize": 2 << 30, "blockCount": 2,
         "blocks": [{"index": 0, "offset": 0, "length": 524288, "sha256": "x"}, {"index": 4095, "offset": 4095 * 524288, "length": 1000, "sha256": "y"}]}


@pytest.mark.parametrize(
    ("change", "rule"),
    [({}, None), ({"snapshotId": ""}, "id"), ({"volumeSizeGiB": 0}, "volume size"), ({"blockSize": 0}, "block size"), ({"logicalSize": 5}, "logical size"), ({"blockCount": 3}, "block count"), ({"version": 9}, "version"),
     ({"blocks": [{"index": 1, "offset": 0, "length": 1, "sha256": ""}] * 2}, "offset"), ({"blocks": [{"index": 0, "offset": 0, "length": 524289, "sha256": ""}] * 2}, "length"),
     ({"blocks": [{"index": 0, "offset": 0, "length": 0, "sha256": ""}] * 2}, "length"), ({"blocks": [{"index": 4096, "offset": 2 << 30, "length": 9, "sha256": ""}] * 2}, "bounds"),
     ({"kind": "ami", "volumes": []}, "volumes"), ({"kind": "ami", "volumes": [{"device": "a"}], "blockSize": 0}, None)],
)
def test_manifest_rules(spark, tmp_path, change, rule):
    path = tmp_path / "m.json"
    path.write_text(json.dumps(VALID | change))
    rows = spark.read.schema(manifest.SCHEMA).option("multiLine", True).json(str(path))
    found = {r.rule for r in manifest.violations(rows).collect()}
    assert (rule in found) if rule else not found


def test_manifest_files(spark, tmp_path):
    from cairn.sources import manifests

    blocks = spark.createDataFrame([(3, 3 * 524288, 10, "b"), (0, 0, 5, "a")], manifest.BLOCKS)
    path = str(tmp_path / "m.json")
    manifests.write(spark, {k: v for k, v in VALID.items() if k != "blocks"}, blocks, path)
    back = manifests.read(spark, path)
    assert back.first().blockCount == 2 and back.first().allocatedBytes == 15
    assert [tuple(r) for r in manifests.blocks_of(back).collect()] == [(0, 0, 5, "a"), (3, 3 * 524288, 10, "b")]
    with pytest.raises(ValueError, match="offset"):
        manifests.write(spark, {k: v for k, v in VALID.items() if k != "blocks"}, blocks.withColumn("byte_offset", F.lit(1).cast("long")), path)
    assert len(list(tmp_path.iterdir())) == 1


def test_reconcile(spark):
    a, b = (spark.createDataFrame([(i,) for i in xs], "idx long") for xs in ([1, 2, 4], [1, 3]))
    assert manifest.reconcile(a, a).isEmpty()
    assert sorted((r.ordinal, r.listed, r.known) for r in manifest.reconcile(a, b).collect()) == [(1, 2, 3), (2, 4, None)]


def journal_file(path, *lines, header=None):
    head = header or {"v": 1, "id": "snap-1", "blocks": 10}
    path.write_text("".join([json.dumps(head) + "\n", *(x if isinstance(x, str) else json.dumps(x) + "\n" for x in lines)]))
    return str(path)


def test_journal(spark, tmp_path):
    entry = lambda o, n, sha: {"o": o, "len": n, "sha": sha}
    path = journal_file(tmp_path / "j", entry(1, 100, "aa"), entry(2, 200, "bb"), "not json\n", entry(99, 1, "x"), entry(1, 0, ""), entry(2, 201, "bc"), '{"o":3,"le')
    done = journal.replayed(journal.read(spark, path, "snap-1", 10))
    assert [tuple(r) for r in done.collect()] == [(2, 201, "bc")]
    for args in (("snap-2", 10), ("snap-1", 11), ("snap-1", 10, "base")):
        with pytest.raises(journal.JournalMismatch):
            journal.read(spark, path, *args)
    blocks = spark.createDataFrame([(i, i, 0, "kept" if i == 5 else "") for i in range(10)], "ordinal long, idx long, length long, sha256 string")
    assert {r.ordinal: (r.length, r.sha256) for r in journal.merged(blocks, done).collect()} == {i: ((201, "bc") if i == 2 else (0, "kept" if i == 5 else "")) for i in range(10)}
    wrong = spark.createDataFrame([(2,)], "ordinal long")
    # a block carried from a base is not fetched again, a sampled one that differs is
    assert sorted(r.ordinal for r in journal.resume_pending(blocks, done, wrong).collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


@pytest.mark.parametrize(("total", "n"), [(100, 32), (32, 32), (5, 32), (64, 32), (65, 3), (10, 0)])
def test_stride_sample(spark, total, n):
    got = sorted(r.id for r in journal.stride_sample(spark.range(total), "id", n).collect())
    assert got == (list(range(total)) if n <= 0 or n >= total else [k * (total // n) for k in range(n)])


def test_verify(spark):
    rows = [(0, 4, b64(b"good")), (8, 4, b64(b"\0\0\0\0")), (16, 4, b64(b"lost")), (24, 4, b64(b"was!")), (32, 4, b64(b"long"))]
    data = [(0, bytearray(b"good")), (24, bytearray(b"now!")), (32, bytearray(b"longer"))]
    got = verify.verify_blocks(spark.createDataFrame(rows, "byte_offset long, length long, sha256 string"), spark.createDataFrame(data, "byte_offset long, data binary"))
    assert {r.byte_offset: r.status for r in got.collect()} == {0: "ok", 8: "ok", 16: "missing", 24: "mismatch", 32: "mismatch"}


def test_image_hash(spark):
    parts = {8: b"abc", 3_000_000: b"x" * 70, 2_000_000: bytes(5)}
    image = bytearray(4_000_001)
    for at, d in parts.items():
        image[at : at + len(d)] = d
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in parts.items()], "byte_offset long, data binary").repartition(3)
    assert payload.image_hash(df, len(image)).first().image_sha256 == hashlib.sha256(image).hexdigest()
    assert payload.image_hash(df.limit(0), 10).first().image_sha256 == hashlib.sha256(bytes(10)).hexdigest()
    with pytest.raises(Exception, match="overlaps"):
        payload.image_hash(df, 3_000_010).collect()
    assert {r.byte_offset: r.zero for r in payload.zero_flags(df).collect()} == {8: False, 3_000_000: False, 2_000_000: True}
    digests = df.select(F.col("byte_offset").alias("idx"), F.sha2("data", 256).alias("sha256"))
    assert payload.merkle_digest(digests).first() == payload.merkle_digest(digests.repartition(1)).first()


def test_costs(spark):
    rows = spark.createDataFrame([(81920, 40 << 30, 0), (1000, 2_000_000_000, 1), (1, 1_000_000_000, 2)], "gets long, nbytes long, k int")
    at = lambda k, rate: planner.cost(rows.where(F.col("k") == k), rate).first()
    a, b, c = at(0, 0.0), at(1, 0.09), at(2, -1.0)
    assert (a.list_requests, a.egress_usd) == (9, 0) and a.total_usd == pytest.approx(0.245787)
    assert b.request_usd == pytest.approx(0.003003) and b.egress_usd == pytest.approx(0.18) and c.egress_usd == 0
    assert planner.cost_total(planner.cost(rows)).first().gets == 82921


def test_readiness(spark):
    table = lambda *rows: spark.createDataFrame(rows, "snapshot_id string, state string, message string")
    ok, wait, bad = ("a", "completed", ""), ("b", "pending", None), ("c", "error", "lost")
    assert planner.readiness(table(ok, wait, bad)).first().asDict() == {"ready": False, "pending": "b", "failed": "c: error (lost)"}
    assert readiness.wait_ready(lambda: table(ok))
    polls = iter([table(wait), table(wait), table(ok)])
    slept = []
    assert readiness.wait_ready(lambda: next(polls), 60, sleep=slept.append) and slept == [10.0, 10.0]
    with pytest.raises(TimeoutError):
        readiness.wait_ready(lambda: table(wait))
    with pytest.raises(ValueError, match="lost"):
        readiness.wait_ready(lambda: table(bad), 60)
    with pytest.warns(UserWarning, match="not known"):
        assert readiness.wait_ready(lambda: 1 / 0)


def test_artifact_preference(spark):
    volumes = spark.createDataFrame([("a.img",), ("b.img",), ("c.img",)], "image string")
    files = spark.createDataFrame([("a.img",), ("a.img.zst",), ("b.img.szc",), ("b.img.zst",)], "path string")
    assert {r.image: r.artifact for r in planner.preferred_artifact(volumes, files).collect()} == {"a.img": "a.img.zst", "b.img": "b.img.szc", "c.img": None}


def test_image_volumes(spark):
    images = spark.createDataFrame([("ami-1", "/dev/xvda", [("/dev/xvda", "snap-1"), ("/dev/sdb", None), ("/dev/mapper/x y", "snap-2"), (None, "snap-3"), ("eph", "")])], listing.IMAGES)
    volumes = listing.image_volumes(images)
    assert [(r.ordinal, r.root, r.snapshot_id, r.file) for r in volumes.orderBy("ordinal").collect()] == [(0, True, "snap-1", "xvda.img"), (2, False, "snap-2", "mapper-x-y.img"), (3, False, "snap-3", "volume3.img")]
    assert [r.snapshot_id for r in listing.image_volumes(images, root_only=True).collect()] == ["snap-1"]
    results = spark.createDataFrame([("snap-2", 5, "h")], "snapshot_id string, allocated_bytes long, image_sha256 string")
    assert {r.snapshot_id: r.allocated_bytes for r in listing.group_report(volumes, results).collect()} == {"snap-1": None, "snap-2": 5, "snap-3": None}


def test_limiter():
    clock = [0.0]
    limiter = resilience.Limiter(8, now=lambda: clock[0])
    limiter.throttled()
    limiter.throttled()
    limiter.released()
    assert limiter.usable == 2
    clock[0] = 15.1
    limiter.released()
    assert limiter.usable == 3


def test_live_journal(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    journal_file(folder / "000", {"o": 1, "len": 5, "sha": "a"}, {"o": 2, "len": 5, "sha": "b"}, '{"o":4,"l')
    journal_file(folder / "001", {"o": 1, "len": 0, "sha": ""}, {"o": 3, "len": 7, "sha": "c"})
    stream = journals.entries(spark, str(folder))
    rows = journals.replay_available(stream, "live_journal", str(tmp_path / "check"))
    assert {r.o: r.sha for r in rows.collect()} == {2: "b", 3: "c"}
