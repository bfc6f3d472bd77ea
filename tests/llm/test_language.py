from __future__ import annotations

import zlib

import numpy as np

from cairn.llm import language_id as li


def test_families_and_pairs():
    rng = np.random.default_rng(0)
    centres = {"a1": 0, "a2": 0.4, "b1": 5, "b2": 5.4, "c": 20}
    x, labels = [], []
    for name, at in centres.items():
        for _ in range(40):
            v = np.zeros(li.FEATURES, np.float32)
            v[int(at)] = 1
            v[100 + list(centres).index(name)] = 0.5 + 0.1 * rng.random()
            x.append(v / np.linalg.norm(v))
            labels.append(name)
    model = li.learn(np.stack(x), labels)
    assert sorted(map(tuple, model.families)) != [] and sum(map(len, model.families)) == 5
    assert any({"a1", "a2"} <= set(f) for f in model.families) and any({"b1", "b2"} <= set(f) for f in model.families)
    assert len(model.pairs) == sum(len(f) * (len(f) - 1) // 2 for f in model.families)


def test_given_families_hold_and_unknown_ones_stand_alone():
    x = np.eye(4, li.FEATURES, dtype=np.float32)
    model = li.learn(x, ["en", "de", "fr", "xx"], [["en", "de"], ["fr", "es"]])
    assert model.families == [["en", "de"], ["fr"], ["xx"]]


def test_held_out_accuracy_and_split(spark):
    data = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = li.query(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_odd_texts(spark, docs):
    texts = ["the cat and the dog " * 9, "der Hund und die Katze " * 9] * 20 + [None, "", "123 $$ 4", "x", "漢字", "the " * 20_000]
    langs = ["en", "de"] * 20 + [None, "en", "de", "en", None, "en"]
    table = docs(texts, langs)
    model = li.fit(table)
    rows = {r.doc_id: r for r in li.predict(table, model).collect()}
    assert all(rows[i].lang_pred == langs[i] for i in range(40)) and rows[45].lang_pred == "en"
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0) for i in (40, 41, 42)) and rows[43].lang_pred in ("en", "de")
    kept = li.accepted(table, model).collect()
    assert {r.doc_id for r in kept} == set(range(46)) - {40, 41, 42} and li.accepted(table, model).schema == table.schema
    assert li.predict(table.limit(0), model).count() == 0


def test_no_labels(spark, docs):
    table = docs(["some text", "more"], [None, None])
    assert [r.lang_pred for r in li.predict(table, li.fit(table)).collect()] == ["und", "und"]


def test_prediction_sees_the_text_alone(spark, docs):
    texts = ["the cat and the dog " * 9, "der Hund und die Katze " * 9] * 20
    table = docs(texts, ["en", "de"] * 20)
    model = li.fit(table)
    other = table.selectExpr("doc_id + 1000 AS doc_id", "text", "'zz' AS lang", "'elsewhere' AS source", "n_chars", "key")
    a, b = (sorted((r.doc_id % 1000, r.lang_pred, r.score) for r in li.predict(t, model).collect()) for t in (table, other))
    assert a == b
