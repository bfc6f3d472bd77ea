from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from cairn.llm import interleaved as il

PAGE = """<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><p>One &amp; two</p>
<figure><img src="media:ab" alt="alt a"><figcaption>Cap <b>A</b></figcaption></figure><p>Mid<br>dle</p><img src="http://x/y.png" alt="other">
<figure><figcaption>First</figcaption><img src="media:cd"></figure>tail</body></html>"""


def test_sequences_keep_order_and_captions():
    other = hashlib.sha256(b"http://x/y.png").hexdigest()
    assert il.parse_sequence(PAGE) == [
        ["text", "T", None, None], ["text", "One & two", None, None], ["media", None, "ab", "Cap A"], ["text", "Mid", None, None], ["text", "dle", None, None],
        ["media", None, other, "other"], ["media", None, "cd", "First"], ["text", "tail", None, None],
    ]
    assert il.parse_sequence(None) == [] and il.parse_sequence("<p>unclosed <img src='media:x'") == [["text", "unclosed <img src='media:x'", None, None]]


@pytest.mark.parametrize("text", [None, "", "a", "x" * 192, "y" * 193, "ü🙂" * 4000])
def test_media_are_lossless(text):
    payload, n = il.payload_of(text)
    assert n == len((text or "").encode()) and len(payload) % 192 == 0 and len(payload) - n < 192 + (n == 0)
    pixels, said = il.decode_media(il.encode_media(payload, n))
    assert said == n and pixels.shape == (len(payload) // 192, 64, 3) and pixels.tobytes() == payload
    assert il.feature_of(pixels) == il.feature_of(np.array(pixels))
    for bad in (b"P5\n# 1 bytes\n64 1\n255\n" + payload[:192], il.encode_media(payload, n)[:-1]):
        with pytest.raises(ValueError, match="pixmap"):
            il.decode_media(bad)
    with pytest.raises(ValueError, match="multiple"):
        il.encode_media(b"abc", 3)


def check(rows, texts, sources):
    """Every value by brute force: digests, features, and each document's text in order around its two references."""
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    values = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = il.encode_media(payload, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == il.feature_of(il.decode_media(media)[0])
        own = tuple(r[1:8])
        assert values.setdefault(texts[r.doc_id], own) == own
        assert [p.position for p in r.sequence] == list(range(len(r.sequence)))
        first, second = (p for p in r.sequence if p.kind == "media")
        source = sources[r.doc_id] or ""
        assert first.position == 0 and (first.digest, first.n_bytes) == (hashlib.sha256(source.encode()).hexdigest(), len(source.encode()))
        assert first.caption == " ".join(f"source {source}".split()) and second.caption == f"document {r.doc_id}"
        assert (second.digest, second.media_sha256) == (hashlib.sha256(raw).hexdigest(), r.media_sha256)
        parts = [p for p in r.sequence if p.kind == "text"]
        whole, at = " ".join(raw.decode().split()), 0
        for p in parts:
            assert zlib.crc32(whole[at : at + p.text_chars].encode()) == p.text_crc32
            at += p.text_chars + 1
        assert at == len(whole) + (len(parts) > 0) and all(p.digest is None and p.media_bytes is None for p in parts)
        if len(raw.split()) > 40:
            assert [p.kind for p in r.sequence] == ["media", "text", "media", "text"]


def test_query_on_odd_texts(spark, docs, tmp_path):
    texts = [None, "", " ", "a", "a ", "a" * 192, "a" * 192 + " ", "b" * 30_000, "same", "same", "same", "<p>x</p> &amp; <img src='media:1'> & </article> y", "\n\t two  words \u00a0 more\r\n"]
    docs(texts).withColumn("digest", F.lit("clash")).withColumn("position", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    check(il.query(spark, str(tmp_path)).collect(), dict(enumerate(texts)), dict.fromkeys(range(len(texts)), "s"))


def test_sequences_with_texts(spark, docs):
    texts = [None, "one", "a <b> & c " * 30, "\n\t two  words \u00a0 more\r\n"]
    rows = {r.doc_id: r.sequence for r in il.document_sequences(docs(texts)).collect()}
    assert all(" ".join(p.text for p in rows[i] if p.kind == "text") == " ".join((t or "").split()) for i, t in enumerate(texts))
    assert [p.kind for p in rows[2]] == ["media", "text", "media", "text"] and rows[2][2].caption == "document 2"


def test_query_on_null_sources_repeated_ids_and_no_rows(spark, docs, tmp_path):
    rows = docs(["a", "b"]).withColumn("source", F.lit(None).cast("string")).unionByName(docs(["c"])).selectExpr("nullif(doc_id, 1) AS doc_id", "text", "source")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.sequence[0].n_bytes, r.sequence[-1].caption or r.sequence[-2].caption) for r in il.query(spark, str(tmp_path)).collect())
    assert [g[:3] for g in got] == [(-1, 1, 0), (0, 1, 0), (0, 1, 1)]
    rows.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert il.query(spark, str(tmp_path / "none")).count() == 0


def test_query(spark):
    data = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{data}/documents.parquet").collect()
    check(il.query(spark, data).collect(), {r.doc_id: r.text for r in table}, {r.doc_id: r.source for r in table})


def test_resolution_keeps_unknown_references(spark, docs):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, PAGE)], "page_id long, html string")
    parts = il.sequences(pages, "page_id", "html")
    media = spark.createDataFrame([("ab", 7, "m"), ("ab", 7, "m"), ("zz", 1, "n")], "digest string, size int, kind_of string")
    rows = il.resolve(parts, media).collect()
    assert len(rows) == 16
    assert sorted((r.id, r.position, r["size"]) for r in rows if r.kind == "media") == [(i, p, s) for i in (1, 3) for p, s in ((2, 7), (5, None), (6, None))]
    assert il.sequences(pages.limit(0), "page_id", "html").count() == 0


def test_pages_table(spark):
    rows = il.sequences(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), "page_id", "html").collect()
    assert len({r.id for r in rows}) == 50 and all((r.kind == "text") == (r.text is not None) for r in rows)
    assert not any("track(" in (r.text or "") for r in rows)
