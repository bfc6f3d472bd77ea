from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from cairn.llm import label_shards


def check(rows, texts, shards):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) <= set(range(shards))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    counts = [len(by_shard[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    groups = defaultdict(Counter)
    for r in rows:
        if texts[r.doc_id] is not None:
            groups[texts[r.doc_id]][r.shard] += 1
    return [g for g in groups.values() if g.total() > 1]


def test_groups_stay_together_and_shards_are_even(spark, docs):
    texts = [f"t{i % 60}" if i < 240 else f"s{i}" for i in range(2000)] + [None, "", None]
    groups = check(label_shards.shard_documents(docs(texts), 8).collect(), dict(enumerate(texts)), 8)
    assert sum(len(g) == 1 for g in groups) >= 0.95 * len(groups)


def cut(groups):
    """The share of linked pairs that are in two shards."""
    pairs = sum(g.total() * (g.total() - 1) for g in groups)
    return 1 - sum(n * (n - 1) for g in groups for n in g.values()) / max(1, pairs)


def test_crowded_tables_cut_few_edges(spark, docs):
    for size, linked in ((2, 1.0), (5, 0.7), (30, 0.9)):
        texts = [f"t{i // size}" if i < 4000 * linked else f"s{i}" for i in range(4000)]
        groups = check(label_shards.shard_documents(docs(texts), 8).collect(), dict(enumerate(texts)), 8)
        assert cut(groups) < 0.1, (size, linked, cut(groups))


def test_admitted_moves_fit():
    wanted = {(0, 1): 50, (1, 2): 30, (2, 0): 30, (3, 1): 10, (1, 3): 5}
    room = [0, 3, -5, 0]
    moves = label_shards.admitted(wanted, room)
    for s in range(4):
        into, out = (sum(n for pair, n in moves.items() if pair[side] == s) for side in (1, 0))
        assert into - out <= max(0, room[s])
    assert all(0 <= n <= wanted[pair] for pair, n in moves.items()) and moves[1, 3] == 5 and moves[3, 1] >= 5
    assert label_shards.admitted({}, [1, 2]) == {}


def test_null_and_repeated_ids(spark, docs):
    table = docs(["a", "a", "b"]).unionByName(docs(["a", "c"])).selectExpr("nullif(doc_id, 1) AS doc_id", "text")
    rows = label_shards.shard_documents(table, 2).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, -1, 0, 0, 2]
    assert sorted((r.shard, r.slot) for r in rows) in ([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)], [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)])


def test_a_third_of_all_rows_are_one_text(spark, docs):
    texts = ["hot"] * 400 + [f"s{i}" for i in range(800)]
    (group,) = check(label_shards.shard_documents(docs(texts), 8).collect(), dict(enumerate(texts)), 8)
    assert len(group) <= 4  # 150 fit into a shard


def test_small_tables(spark, docs):
    for texts in (["a"], ["a", "a", None], ["a"] * 50):
        check(label_shards.shard_documents(docs(texts), 8).collect(), dict(enumerate(texts)), 8)
    assert label_shards.shard_documents(docs(["a"]).limit(0), 8).count() == 0


def test_query(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    groups = check(label_shards.query(spark, data).collect(), texts, 40)
    assert cut(groups) < 0.2


def test_plan_has_no_python(spark, docs):
    plan = label_shards.shard_documents(docs(["a", "b", "a"]), 4)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
