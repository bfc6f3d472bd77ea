from __future__ import annotations

import random

import numpy as np

from cairn.llm import paragraph_dedup as pd
from cairn.llm.shingles import word_hashes

rng = random.Random(3)


def words(n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def has(text, passage):
    return " ".join(passage) in " ".join(text.split())


def test_starts_by_brute_force():
    hashes = np.array([rng.randrange(40) for _ in range(300)], np.uint64)
    want = set()
    for i in range(len(hashes) - 23):
        window = hashes[i : i + 24].tolist()
        want |= {i + k for k in range(24) if window[k] == min(window)}
    assert pd.starts(hashes, 24).tolist() == sorted(want)


def test_every_long_passage_shares_a_band():
    from cairn.llm.shingles import MinHash

    minhash = MinHash(6, 7)
    for _ in range(200):
        passage = words(50)
        a, b = (word_hashes(" ".join(words(rng.randrange(80)) + passage + words(rng.randrange(80)))) for _ in range(2))
        assert np.intersect1d(pd.band_keys(a, minhash), pd.band_keys(b, minhash)).size


def test_near_passages_share_a_band():
    from cairn.llm.shingles import MinHash, shingles

    minhash, found, repeated, own = MinHash(pd.BANDS * pd.ROWS, 7), 0, 0, random.Random(9)
    some = lambda n: ["".join(own.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    for _ in range(600):
        passage = some(55)
        edited = list(passage)
        edited[own.randrange(55)] = "changed"
        a, b = (word_hashes(" ".join(some(own.randrange(80)) + p + some(own.randrange(80)))) for p in (passage, edited))
        if pd.shared_runs(b, np.unique(shingles(a)), 50, 0.8):
            repeated += 1
            found += bool(np.intersect1d(pd.band_keys(a, minhash), pd.band_keys(b, minhash)).size)
    assert repeated > 500 and found >= 0.97 * repeated, (found, repeated)


def test_repeats_are_removed_and_clean_documents_stay(spark, docs):
    passages = [words(n) for n in (50, 60, 90, 200)]
    edited = list(passages[3])
    edited[100] = "changed"
    texts, holders = [], {k: [] for k in range(4)}
    for i in range(60):
        inside = [k for k in range(4) if rng.random() < 0.15]
        body = words(rng.randint(5, 100))
        for k in inside:
            body += (edited if k == 3 and i % 2 else passages[k]) + words(rng.randint(5, 60))
        texts.append("".join(w + rng.choice([" ", " ", "\n"]) for w in body))
        for k in range(4):
            if has(texts[-1], passages[k]):
                holders[k].append(i)
    texts += [None, "", "short text", texts[0], " ".join(words(40))]
    got = {r.doc_id: r for r in pd.repeats(docs(texts)).collect()}
    after = {i: got[i].text if i in got else (t or "") for i, t in enumerate(texts)}
    for k in range(3):
        assert len(holders[k]) < 2 or [i for i in range(60) if has(after[i], passages[k])] == holders[k][:1]
        assert set(holders[k]) <= set(got) or len(holders[k]) < 2
    assert after[63] == "" and got[63].removed_words == len(texts[0].split())
    clean = [i for i in range(60) if i not in got and i]
    assert clean and all(after[i] == texts[i] for i in clean)
    for i, r in got.items():
        own = texts[i].split()
        assert len(own) - len(r.text.split()) == r.removed_words
        assert all(s.kept_in < i and len(texts[i][s.start : s.end].split()) >= 50 for s in r.spans)
        assert r.class_id <= i and got[r.class_id].class_id == r.class_id and r.links > 0
    kept = {r.doc_id: r.text for r in pd.without_repeats(docs(texts)).collect()}
    assert kept == {i: (after[i] if texts[i] is not None else None) for i in range(len(texts)) if i != 63}
    assert pd.without_repeats(docs(texts)).schema == docs(texts).schema


def test_a_fragment_in_a_lower_document_hides_no_passage(spark, docs):
    own = random.Random(11)
    some = lambda n: ["".join(own.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passages, texts = [some(60) for _ in range(40)], []
    for p in passages:  # 48 of 60 words in the lowest document, the passage in two more
        texts += [" ".join(some(10) + part + some(10)) for part in (p[6:54], p, p)]
    got = {r.doc_id: r for r in pd.repeats(docs(texts)).collect()}
    for k, p in enumerate(passages):
        assert 3 * k not in got and got[3 * k + 1].removed_words == 0 and not has(got[3 * k + 2].text, p)


def test_null_and_repeated_ids(spark, docs):
    p = words(60)
    texts = [" ".join(words(9) + p), " ".join(words(9) + p), " ".join(words(20))]
    table = docs(texts).unionByName(docs(texts[:2])).unionByName(docs(["zz other text"] * 3).where("doc_id = 1"))
    table = table.unionByName(docs(texts).selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars", "key"))
    (row,) = (r for r in pd.repeats(table).collect() if r.removed_words)
    assert row.doc_id == 1 and row.removed_words == 60
    kept = sorted((-1 if r.doc_id is None else r.doc_id, len(r.text.split())) for r in pd.without_repeats(table).collect())
    assert kept == [(-1, 20), (-1, 69), (-1, 69), (0, 69), (0, 69), (1, 3), (1, 9), (1, 9), (2, 20)]


def test_passages_within_one_document_and_short_ones_stay(spark, docs):
    p, q = words(60), words(45)
    texts = [" ".join(p + words(3) + p), " ".join(q + words(30)), " ".join(words(30) + q)]
    assert pd.repeats(docs(texts)).count() == 0
    assert pd.repeats(docs(texts).limit(0)).count() == 0


def test_repeated_lines_are_passages_only_as_they_stand(spark, docs):
    line = words(7)
    texts = ["ha " * 500, "ha " * 400, " ".join(line * 12), " ".join(words(3) + line * 12), " ".join((line[:4] + ["other"] + line[4:]) * 12), "ha ha ho " * 60]
    got = {r.doc_id: r for r in pd.repeats(docs(texts)).collect()}
    assert set(got) == {0, 1, 2, 3} and got[1].text == "" and len(got[3].text.split()) == 3


def test_edited_passages_behind_fragments(spark, docs):
    """Of passages of 80 words with two edits in one of two holders, behind a document with 48 of their words, most go."""
    own = random.Random(12)
    some = lambda n: ["".join(own.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    texts = []
    for _ in range(60):
        p = some(80)
        q = list(p)
        q[10], q[70] = "changed", "again"
        texts += [" ".join(some(10) + part + some(10)) for part in (p[16:64], p, q)]
    got = {r.doc_id: r for r in pd.repeats(docs(texts)).collect()}
    assert sum(got[k].removed_words >= 50 for k in range(2, 180, 3) if k in got) >= 0.95 * 60


def test_query(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = pd.query(spark, data).collect()
    first = {}
    for i in sorted(texts):
        if len((texts[i] or "").split()) >= 50:
            first.setdefault(texts[i], i)
    copies = {i for i, t in texts.items() if t in first and first[t] != i}
    assert copies <= {r.doc_id for r in rows if r.text == ""}


def test_query_leaves_no_passage_twice(spark):
    """By brute force: after removal no 50 words in a row stand in two documents, and what went stood in a lower one."""
    data = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in pd.query(spark, data).collect()}
    windows = lambda t: {tuple(w[i : i + 50]) for w in [t.split()] for i in range(len(w) - 49)}
    before, after = {}, {}
    for i in sorted(texts):
        for w in windows(texts[i]):
            before.setdefault(w, []).append(i)
        kept = rows[i].text.lower() if i in rows else texts[i]
        for part in kept.split("\n") if i in rows and rows[i].spans else [kept]:
            for w in windows(part):
                after.setdefault(w, []).append(i)
    twice = sum(len(ids) > 1 for ids in before.values())
    left = sum(len(ids) > 1 for ids in after.values())
    assert twice > 1000 and left <= 0.002 * twice, (left, twice)
    shingle = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    for r in rows.values():
        for s in r.spans:
            own, other = shingle(texts[r.doc_id][s.start : s.end]), shingle(texts[s.kept_in])
            assert len(own & other) >= 0.8 * len(own)


def test_hashes_of_words_and_blocks(monkeypatch):
    from cairn.llm import shingles

    text = "Ünï the  the\n\x0btHe x " + "word " * 50 + "y" * 300
    whole = word_hashes(text)
    words = text.lower().split()
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    assert all(whole[i] == word_hashes(w)[0] for i, w in enumerate(words))
    monkeypatch.setattr(shingles, "BLOCK", 16)
    assert (word_hashes(text) == whole).all() and len(word_hashes(" \n")) == 0


def test_texts_are_compressed_and_come_back(spark):
    from cairn.llm import paragraph_dedup

    texts = ["", "é　x" * 9, None, "\x00", "word other " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = paragraph_dedup.packed(rows).orderBy("id").toArrow().combine_chunks()
    assert paragraph_dedup.unpacked(got["text"].combine_chunks()) == texts
    assert got["text_hash"].to_pylist() == [r.h for r in rows.orderBy("id").selectExpr("xxhash64(text) h").collect()]
    assert len(got["text"][4].as_py()) < 1000
