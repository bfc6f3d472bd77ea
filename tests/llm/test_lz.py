from __future__ import annotations

import hashlib

from cairn.llm import lz_fingerprint as lz

TEXTS = ["abcabcabcabcabc", None, "", "the cat sat on the mat " * 20, "the cat sat on the mat " * 20, "ü🙂" * 500, "a", "zz" * 40]


def phrases(text):
    """LZ78, the plain way."""
    seen, at, out = set(), 0, []
    while at < len(text):
        n = 1
        while text[at : at + n] in seen and at + n < len(text):
            n += 1
        seen.add(text[at : at + n])
        out.append(text[at : at + n])
        at += n
    return out


def test_parse_and_resumed_parse():
    for text in [t or "" for t in TEXTS]:
        ends = lz.phrase_ends(text)
        assert [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] == phrases(text)
        for k in range(0, max(0, len(ends) - 1), 3):
            assert lz.phrase_ends(text, ends[:k]) == ends


def test_hash_is_of_the_phrase_alone():
    a = set(lz.signature("abcd", 99).tolist())
    b = set(lz.signature("dcba", 99).tolist())
    assert a == b and len(a) == 4


def test_likeness_is_exact_for_small_sets():
    a, b = "abc", "bcd"
    assert lz.likeness(lz.signature(a), lz.signature(b)) == 0.5
    assert lz.likeness(lz.signature(""), lz.signature("")) == 1 and lz.likeness(lz.signature(""), lz.signature("a")) == 0


def check(rows, texts):
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in rows}
    assert sorted(got) == sorted(texts)
    for i, doc_id in enumerate(ids):
        text, after = texts[doc_id] or "", texts[ids[(i + 1) % len(ids)]] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == lz.written(lz.signature(text)) and r.edited_fingerprint == lz.written(lz.signature(edited))
        assert r.near_edited == lz.likeness(lz.signature(text), lz.signature(edited))
        assert r.near_next == lz.likeness(lz.signature(text), lz.signature(after))


def test_documents_against_brute_force(spark, docs):
    check(lz.edited_fingerprints(docs(TEXTS)).collect(), dict(enumerate(TEXTS)))
    check(lz.edited_fingerprints(docs(["alone"])).collect(), {0: "alone"})
    assert lz.edited_fingerprints(docs(["a"]).limit(0)).count() == 0
    assert {r.doc_id: r.fingerprint for r in lz.fingerprints(docs(TEXTS)).collect()} == {i: lz.written(lz.signature(t or "")) for i, t in enumerate(TEXTS)}


def test_query(spark):
    data = "/root/testdata/sf0.001"
    check(lz.query(spark, data).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()})
