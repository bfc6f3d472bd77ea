"""Byte-level BPE and packing against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from cairn.llm import best_fit, byte_bpe

TEXTS = ["", None, "a", "Hello world's 123 <|endoftext|> ##", "  two  spaces\n\n\nlines \t", "ünïcödé ЖЖ 漢字 🙂🙂", "x" * 5000, "the " * 3000, "Ġ \x00\x7f\xad 'll''s", "a", "<unk> ⁇ ▁"]


@pytest.fixture(scope="module")
def tiktoken_own():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_rank_files_library(spark, docs, tiktoken_own):
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs(TEXTS), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == tiktoken_own.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()


def test_byte_bpe_query_on_a_table(spark, tiktoken_own):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in byte_bpe.query(spark, "/root/testdata/sf0.001").collect():
        ids = np.array(tiktoken_own.encode_ordinary(rows[r.doc_id] or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark, docs):
    assert byte_bpe.digest_documents(docs(["a"]).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert best_fit.pack_default(docs(["a"]).limit(0)).count() == 0


def check_packing(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for i, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert len(pieces) == -(-len(ids) // capacity)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == capacity for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    return len(by_seq)


def test_packing(spark, docs):
    check_packing(best_fit.pack_default(docs(TEXTS)).collect(), dict(enumerate(TEXTS)))


def test_packing_is_dense(spark):
    data = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = best_fit.query(spark, data).collect()
    assert check_packing(rows, texts) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_sequences_follow_tokens_not_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(150)
    rows = best_fit.pack_default(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_packing(rows, texts) <= 1.01 * sum(r.length for r in rows) / 2048 + 1
    several = best_fit.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, again=1 << 17).collect()
    assert check_packing(several, texts) <= 1.03 * sum(r.length for r in rows) / 2048 + 1


def test_only_equal_tokenizers_are_handed_over(tmp_path):
    path = P.path("byte_bpe_50k.json")
    assert best_fit.same_ids(path, P.PATTERN) and not best_fit.same_ids(path, r"\S+|\s+")
    assert not best_fit.same_ids(P.path("word_bpe_49k.json"), P.PATTERN)


def test_repeated_and_null_ids(spark, docs):
    table = docs(["a b", "c"]).unionByName(docs(["d"])).selectExpr("nullif(doc_id, 1) AS doc_id", "text", "'x' AS sequence_id")
    rows = best_fit.pack_default(table).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.length) for r in rows) == [(-1, 2), (0, 2), (0, 3)]


def test_open_bins_by_brute_force():
    rng = np.random.default_rng(1)
    bins, open_now = best_fit.OpenBins(64, 5), {}
    for length in rng.integers(1, 65, 2000).tolist():
        least = min(open_now.values(), default=0)
        fits = [f for f in open_now.values() if f >= length]
        seq, offset, closed_now = bins.place(length)
        if fits:
            assert open_now[seq] == min(fits) and offset == 64 - min(fits)
        else:
            assert seq not in open_now and offset == 0
            if len(open_now) == 5:
                still = {b for ids in bins.open.values() for b in ids} | {seq}
                (closed,) = set(open_now) - still
                assert open_now.pop(closed) == least and closed in closed_now
            open_now[seq] = 64
        open_now[seq] -= length
        if not open_now[seq]:
            assert seq in closed_now
            del open_now[seq]
        assert sorted(open_now.values()) == sorted(f for f, bs in bins.open.items() for _ in bs)
