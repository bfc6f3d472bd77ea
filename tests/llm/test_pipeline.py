"""Each stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import corpus_pipeline
from cairn.llm import pii_feistel
from tests.llm.test_forest import brute_classes
from tests.llm.test_tokens import check_packing

DATA = "/root/testdata/sf0.001"


def passages(text, n=50):
    words = text.lower().split()
    out = set()
    for i in range(len(words) - n + 1):
        part = words[i : i + n]
        if len({tuple(part[k : k + 5]) for k in range(n - 4)}) >= 25:
            out.add(tuple(part))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(1).selectExpr("CAST(90000 AS long) AS doc_id", "'1234 ---' AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(odd).unionByName(odd.selectExpr("CAST(90001 AS long) AS doc_id", "CAST(NULL AS string) AS text", "lang", "source", "n_chars"))
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            check_packing(docs.collect(), {i: r.text for i, r in before.items()})
            break
        assert docs.columns == columns
        rows = docs.collect()
        at[name] = {r.doc_id: r for r in rows}
        assert len(rows) == len(at[name]) and set(at[name]) <= set(before)
        now = at[name]
        if name == "language_id":
            assert set(before) - set(now) == {90000, 90001}
            assert sum(now[i].lang == before[i].lang for i in now) >= 0.98 * len(now)
        elif name == "near_duplicates":
            assert set(now) == set(brute_classes({i: r.text for i, r in before.items()}).values())
            assert all(now[i] == before[i] for i in now)
        elif name == "repeated_passages":
            owner = {}
            for i in sorted(now):
                for p in passages(now[i].text):
                    assert owner.setdefault(p, i) == i
            # what went stands in a document before, but for edited words
            had = {}
            for i in sorted(before):
                words = before[i].text.lower().split()
                for k in range(len(words) - 4):
                    had.setdefault(tuple(words[k : k + 5]), i)
            for i in set(now):
                old, new = before[i].text.lower().split(), now[i].text.lower().split()
                kept = {tuple(new[k : k + 5]) for k in range(len(new) - 4)}
                gone = [had[tuple(old[k : k + 5])] for k in range(len(old) - 4) if tuple(old[k : k + 5]) not in kept]
                assert sum(first < i for first in gone) >= 0.7 * len(gone)
        else:
            keyed = pii_feistel.Pseudonymiser(pii_feistel.key_of(spark))
            assert all(now[i].text == pii_feistel.replace(before[i].text, keyed)[0] for i in now) and set(now) == set(before)


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
