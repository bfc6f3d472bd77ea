from __future__ import annotations

import random

import pyspark.sql.functions as F
import pytest

from cairn.llm import common, lsh_forest
from cairn.llm.common import components


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    """Of texts by id: the least id of each connected class."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets, owners = {i: shingle_set(t) for i, t in texts.items()}, {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    pairs = {(i, j) for ids in owners.values() for i in ids for j in ids if i < j}
    linked = [(i, j) for i, j in pairs if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    equal = {}
    linked += [(equal.setdefault(t, i), i) for i, t in texts.items()]
    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {i: find(i) for i in texts}


def made_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [None, "", " ", "one", "one two", "one  two", None, ""]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for k in range(6):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = word()
            texts += [" ".join(copy)] * (1 + (k == 2))
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)]
    return texts


def test_classes_against_brute_force(spark, docs):
    texts = made_texts()
    rows = lsh_forest.join_documents(docs(texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    want = brute_classes(dict(enumerate(texts)))
    assert {r.doc_id: r.class_id for r in rows} == want
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert all(r.copy_of == first[texts[r.doc_id]] for r in rows)
    sizes = {}
    for i, c in want.items():
        sizes.setdefault(c, set()).add(texts[i])
    assert all((r.links > 0) == (len(sizes[r.class_id]) > 1) for r in rows)
    kept = lsh_forest.one_of_each(docs(texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.schema == docs(texts).schema


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in lsh_forest.query(spark, data).collect()} == brute_classes(texts)


def brute_links(texts):
    """Of texts by id: the number of different texts that are alike."""
    sets = {t: shingle_set(t) for t in set(texts.values())}
    alike = lambda a, b: sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    count = {t: sum(1 for u in sets if u != t and alike(t, u)) for t in sets}
    return {i: count[t] for i, t in texts.items()}


def test_links_count_every_similar_text(spark, docs):
    texts = made_texts(5)
    rng = random.Random(6)
    base = [str(rng.random()) for _ in range(100)]
    texts += [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in range(40)]
    want = brute_links(dict(enumerate(texts)))
    assert max(want.values()) == 39
    assert {r.doc_id: r.links for r in lsh_forest.join_documents(docs(texts)).collect()} == want
    assert {r.doc_id: r.links for r in lsh_forest.join_documents(docs(texts), block=7, size=4000).collect()} == want


def test_two_large_classes_of_one_node_do_not_meet(spark, docs):
    """Near copies of two texts that share a third of their words: links within each class are counted without comparing, and
    rows that are dealt to groups grow with the members."""
    rng = random.Random(8)
    same = [str(rng.random()) for _ in range(150)]
    texts = []
    for k in range(2):
        base = same + [str(rng.random()) for _ in range(150)]
        texts += [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in range(0, 300, 3)]
    want = brute_links(dict(enumerate(texts)))
    assert set(want.values()) == {99}
    assert {r.doc_id: r.links for r in lsh_forest.join_documents(docs(texts), block=10).collect()} == want
    table = docs(texts).select(F.lit(1).cast("long").alias("node"), F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id < 100 THEN 0L ELSE 100L END").alias("cluster"), F.lit(1).cast("long").alias("size"))
    bodies = docs(texts).selectExpr("doc_id AS id", "text")
    assert lsh_forest.dealt(table, bodies, 0.8, 5, 10, 1 << 20).count() == 0
    alike = bodies.selectExpr("id", "'the same words in all of them' AS text")
    assert lsh_forest.dealt(table, alike, 0.8, 5, 10, 1 << 20).count() == 200 * 10


def test_shortening_ends_when_the_recall_is_reached(spark, docs, monkeypatch):
    lengths, own = [], lsh_forest.dealt
    monkeypatch.setattr(lsh_forest, "dealt", lambda *rest: lengths.append(1) or own(*rest))
    rng = random.Random(9)
    base = [[str(rng.random()) for _ in range(400)] for _ in range(3)]
    near = [" ".join([*b[:k], "edit", *b[k + 1 :]]) for b in base for k in range(4)]
    lsh_forest.join_documents(docs(near)).count()
    assert len(lengths) == 1
    lengths.clear()
    lsh_forest.join_documents(docs(near + [" ".join([*near[0].split()[:40], "new"]), " ".join([*near[0].split()[:47], "old"])])).count()
    assert len(lengths) == 3


def test_rows_that_share_an_id(spark, docs):
    texts = ["a b c d e f", "x y z", "x y z", "b"]
    table = docs(texts).unionByName(docs(["x y z"])).unionByName(docs(["q"]).selectExpr("3L AS doc_id", "text", "lang", "source", "n_chars", "key"))
    rows = sorted((r.doc_id, r.class_id, r.copy_of) for r in lsh_forest.join_documents(table).collect())
    assert rows == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (2, 1, 1), (3, 3, 3), (3, 3, 3)]
    kept = sorted((r.doc_id, r.text) for r in lsh_forest.one_of_each(table).collect())
    assert kept == [(0, "a b c d e f"), (1, "x y z"), (3, "b")]


def test_odd_rows(spark, docs):
    assert lsh_forest.join_documents(docs(["a"]).limit(0)).count() == 0
    table = docs(["a b", "c d"]).unionByName(docs(["a b"])).unionByName(docs(["z"]).selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars", "key"))
    rows = sorted((r.doc_id, r.class_id) if r.doc_id is not None else (-1, r.class_id) for r in lsh_forest.join_documents(table).collect())
    assert rows == [(-1, None), (0, 0), (0, 0), (1, 1)]


def test_prefix_reaches_the_recall():
    assert lsh_forest.shortest_prefix(0.8, 16, 8, 0.998) == 5 and lsh_forest.shortest_prefix(0.8, 16, 8, 0.9995) == 4
    assert lsh_forest.shortest_prefix(0.8, 16, 8, 0.9999) == 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}


@pytest.mark.parametrize("bits", [64, 1 << 12, common.BITS])
def test_likely_rows_lose_none_and_texts_are_not_shuffled(spark, docs, bits):
    rows = docs([f"text {i}" for i in range(2000)] + [None])
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 9)] * 2, "other long")
    got = [r.doc_id for r in common.likely(rows, ids, "doc_id", bits).collect()]
    assert len(set(got)) == len(got) and set(range(0, 2000, 9)) <= set(got) and (bits == 64 or len(got) < 400)
    plan = lsh_forest.texts_of(rows, ids)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(id" in line or "SortMergeJoin" in line]
