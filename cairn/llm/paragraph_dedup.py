"""Substring dedup by MinHash banding of paragraphs (operator 1).

Line breaks do not bound what is copied, so paragraphs are content-defined: one starts at each word whose five-word
shingle has the least hash among WINDOW neighbours, and runs for PARAGRAPH words. Equal passages have equal paragraphs
wherever they stand, and every passage of WINDOW + PARAGRAPH words or more holds a whole paragraph. A paragraph's
minimum hashes make BANDS bands of ROWS values; paragraphs of different documents that share a band collide.

Each band links its documents to the least of them: one row for each document, however many share it. The least may hold
the paragraph and not the passage. So where a paragraph is in no repeat that this finds, the band's documents are linked once
more, by the bands of all passages of LEAST words around it: equal passages have equal bands, whatever lower documents
hold of them. Of every linked pair, the runs of words whose shingles the lower document has are taken, across small edits as
long as their Jaccard similarity stays at the threshold; runs of at least LEAST words are repeats. They are removed from the document with
the higher doc_id, so of every repeated passage the one in the lowest document stays. Removals are clustered: class_id is the
least doc_id of the connected component of documents that share passages.

Result of `repeats`: a row for each document that shares a passage: class_id, links (documents that hold its repeats or
have theirs here), removed_words, spans (start and end in characters, the document that keeps the passage), text (without
them). Documents without repeats have no row.

Cases: null and empty texts, and those of fewer than LEAST words, have no repeats; a copy loses all its words; a run of few
different shingles (a line again and again) is a repeat only if the other document has the same words in a row;
repeats within one document stay; very long texts are read whole; rows that share a doc_id count as one document, of the least
text, and rows with another text stay as they are, as do rows with a null doc_id; ties go to the lower doc_id; an empty table gives an empty table; other columns are not read by `repeats` and kept by
`without_repeats`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import components, discard, documents, likely, one_text_each, slices, stored
from cairn.llm.lsh_forest import texts_of, with_texts
from cairn.llm.shingles import THRESHOLD, WORDS, MinHash, shingles, word_hashes

LEAST, WINDOW, PARAGRAPH = 50, 24, 26
BANDS, ROWS = 3, 2
WORD = re.compile(r"[^\t-\r ]+")


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or other pick) of each window along the last axis, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = pick(out[..., :-have], out[..., have:]), have * 2
    rest = width - have
    return pick(out[..., :-rest], out[..., rest:]) if rest else out


def starts(hashes: np.ndarray, window: int) -> np.ndarray:
    """Where paragraphs start: the places that hold the least hash of some window of shingles."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    least = sliding(hashes, window)
    edge = np.zeros(window - 1, least.dtype)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), window, np.maximum) == hashes)


def paragraph_keys(words: np.ndarray, minhash: MinHash, window: int = WINDOW, paragraph: int = PARAGRAPH, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Where a document's paragraphs start, and their band keys (a row for each band)."""
    none = np.zeros(0, np.int64), np.zeros((minhash.k // rows, 0), np.int64)
    if len(words) < max(window + WORDS - 1, paragraph):
        return none
    hashes = shingles(words)
    at = starts(hashes, window)
    each = paragraph - WORDS + 1
    at = at[at + each <= len(hashes)]
    if not len(at):
        return none
    return at, window_keys(hashes, each, minhash, rows)[:, at]


def window_keys(hashes: np.ndarray, each: int, minhash: MinHash, rows: int) -> np.ndarray:
    """The band keys (a row for each band) of the windows of `each` shingles, by where they start."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = sliding(short * minhash.a[:, None] + minhash.b[:, None], each).astype(np.uint64)
    bands = least.reshape(minhash.k // rows, rows, -1)
    keys = np.repeat(np.arange(1, len(bands) + 1, dtype=np.uint64)[:, None], bands.shape[2], 1)
    for row in range(rows):
        keys = (keys ^ bands[:, row]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def band_keys(words: np.ndarray, minhash: MinHash, window: int = WINDOW, paragraph: int = PARAGRAPH, rows: int = ROWS) -> np.ndarray:
    """The distinct band keys of a document's paragraphs."""
    return np.unique(paragraph_keys(words, minhash, window, paragraph, rows)[1])


def bands(docs: DataFrame, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, id: a row for each distinct band key of each document."""

    def run(batches):
        minhash = MinHash(count * rows, 7)
        for batch in slices(batches):
            keys, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and doc_id is not None:
                    keys.append(band_keys(word_hashes(text), minhash, rows=rows))
                    ids.append(np.full(len(keys[-1]), doc_id, np.int64))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys or none)), "id": pa.array(np.concatenate(ids or none))})

    return docs.select("doc_id", "text").mapInArrow(run, "key long, id long")


def packed(bodies: DataFrame) -> DataFrame:
    """id, text (compressed: texts are shuffled several times, and this halves them), text_hash."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            texts = [None if t is None else pack(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.binary()), "text_hash": batch.column("text_hash")})

    return bodies.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "id long, text binary, text_hash long")


def unpacked(texts: pa.Array) -> list[str | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if t is None else unpack(t).decode() for t in texts.to_pylist()]


def in_a_row(words: np.ndarray, other: np.ndarray) -> bool:
    """Whether other has the words in a row."""
    raw, part, at = other.tobytes(), words.tobytes(), -1
    while (at := raw.find(part, at + 1)) % 8 and at >= 0:
        pass
    return at >= 0


def shared_runs(words: np.ndarray, other: np.ndarray, least: int, threshold: float, other_words: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Runs of words (start, end) whose shingles are in `other` (sorted shingles), at least `least` words long.

    Neighbouring runs join over a gap of up to two edited words while the whole stays at the threshold: with m of n
    shingles shared and as many in the other text, Jaccard is m / (2 n - m). A run must have enough different
    shingles to be a passage, as few make a run of one repeated word look like any other such run, or stand as it is in other_words.
    """
    if len(words) < least or not len(other):
        return []
    own = shingles(words)
    hit = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    joined: list[list[int]] = []  # start, end, shared
    for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if joined:
            last = joined[-1]
            n, m = end - last[0], last[2] + end - start
            if start - last[1] <= 2 * WORDS and m >= threshold * (2 * n - m):
                last[1], last[2] = end, m
                continue
        joined.append([start, end, end - start])
    long = [(a, b + WORDS - 1, len(np.unique(own[a:b])) >= least // 2) for a, b, _ in joined if b - a + WORDS - 1 >= least]
    return [(a, b) for a, b, various in long if various or (other_words is not None and in_a_row(words[a:b], other_words))]


def found_spans(pairs: DataFrame, bodies: DataFrame, least: int, threshold: float) -> DataFrame:
    """id, other, start, end, n: the characters of id's repeats that the lower document other has, and their words."""
    both = with_texts(pairs, bodies)

    def run(batches):
        last, last_set, last_words = None, None, None
        for batch in slices(batches):
            out: dict = {n: [] for n in ("id", "other", "start", "end", "n")}
            texts = unpacked(batch.column("text"))
            for i, j, text, packed_other in zip(batch.column("id").to_pylist(), batch.column("other").to_pylist(), texts, batch.column("text_other"), strict=True):
                if j != last:  # a document that holds what many repeat comes many times in a row
                    last, last_words = j, word_hashes(unpacked(pa.array([packed_other.as_py()]))[0])
                    last_set = np.unique(shingles(last_words))
                if runs := shared_runs(word_hashes(text), last_set, least, threshold, last_words):
                    places = [m.span() for m in WORD.finditer(text)]
                    for a, b in runs:
                        for n, v in zip(out, (i, j, places[a][0], places[b - 1][1], b - a), strict=True):
                            out[n].append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return both.select("id", "other", "text", "text_other").mapInArrow(run, "id long, other long, start long, end long, n long")


def passages(about: DataFrame, least: int, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, id, asks: a row for each distinct band key of the passages of `least` words around the paragraphs of a document
    that have one of its keys; asks: no span covers the paragraph. about: id, text, keys, spans (characters)."""
    each, margin = least - WORDS + 1, least - PARAGRAPH

    def run(batches):
        paragraph_hash, passage_hash = MinHash(count * rows, 7), MinHash(count * rows, 11)
        for batch in slices(batches):
            out: list = []
            for i, text, keys, spans in zip(batch.column("id").to_pylist(), unpacked(batch.column("text")), batch.column("keys").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = word_hashes(text)
                at, found = paragraph_keys(words, paragraph_hash, rows=rows)
                at = at[np.isin(found, np.array(keys, np.int64)).any(0)]
                if len(words) < least or not len(at):
                    continue
                places = [m.span() for m in WORD.finditer(text)]
                starts_at, ends_at = (np.array([places[p][side] for p in where.tolist()]) for side, where in ((0, at), (1, at + PARAGRAPH - 1)))
                asks = np.ones(len(at), bool)
                for span in spans or []:
                    asks &= ~((span["start"] <= starts_at) & (ends_at <= span["end"]))
                every = window_keys(shingles(words), each, passage_hash, rows)
                near = at[:, None] - margin + np.arange(margin + 1)
                inside = (near >= 0) & (near < every.shape[1])
                near, asking = near[inside], np.repeat(asks, margin + 1)[inside.reshape(-1)]
                wanted, asked = np.unique(every[:, near]), np.unique(every[:, near[asking]])
                out.append((wanted, np.full(len(wanted), i, np.int64), np.isin(wanted, asked)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, t) for t in (np.int64, np.int64, bool)]
            yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in zip(("key", "id", "asks"), columns, strict=True)})

    return about.select("id", "text", "keys", "spans").mapInArrow(run, "key long, id long, asks boolean")


def more_pairs(members: DataFrame, bodies: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """(id, other): for the passages around each paragraph that no span covers, the least document that shares a band of
    them. The least document of the paragraph's key, which all were compared with, is not in members."""
    several = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    keys = members.join(several, "key", "left_semi").groupBy("id").agg(F.collect_list("key").alias("keys"))
    covered = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    keys = stored(keys, "keys")
    rows = stored(passages(keys.join(covered, "id", "left").join(likely(bodies, keys.select("id")), "id"), least), "passages")
    lowest = rows.groupBy("key").agg(F.min("id").alias("other"), F.max(F.when(F.col("asks"), F.col("id"))).alias("high")).where("other < high")
    found = stored(rows.where("asks").join(lowest.select("key", "other"), "key").where("other < id").select("id", "other").distinct(), "more")
    discard(rows, keys)
    return found


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """text without the spans, and how many words went."""
    kept, at, words = [], 0, 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        start = max(start, at)
        kept.append(text[at:start])
        words += len(text[start:end].split())
        at = end
    kept.append(text[at:])
    if len(kept) == 1:
        return text, 0
    parts = [kept[0].rstrip(), *(k.strip() for k in kept[1:-1]), kept[-1].lstrip()]
    return "\n".join(p for p in parts if p), words


def repeats(docs: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, links, removed_words, spans, text, text_hash (of the text before)."""
    if least < WINDOW + PARAGRAPH:
        raise ValueError(f"passages below {WINDOW + PARAGRAPH} words need not hold a paragraph")
    docs = one_text_each(docs)
    shared = bands(docs).groupBy("key").agg(F.min("id").alias("other"), F.max("id").alias("most")).where("other < most").select("key", "other")
    # the shared keys are the smaller side: hashing them spares sorting all paragraphs, and Spark splits hot keys
    members = stored(bands(docs).join(shared.hint("SHUFFLE_HASH"), "key").where("id > other").select("key", "id", "other"), "members")
    pairs = stored(members.select("id", "other").distinct(), "pairs")
    bodies = stored(packed(texts_of(docs, pairs.select("id").union(pairs.select("other")))), "texts")
    first = stored(found_spans(pairs, bodies, least, threshold), "spans")
    more = more_pairs(members, bodies, first, least)
    new = stored(more.join(pairs, ["id", "other"], "left_anti"), "new")
    spans = stored(first.union(found_spans(new, bodies, least, threshold)), "spans")
    discard(members, pairs, first, more, new)
    linked = spans.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    degree = linked.select("a").union(linked.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links"))
    # a document's spans are no more than its length allows for each document that holds one of its paragraphs
    by_doc = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("other").alias("kept_in")))).alias("spans"))
    classes = components(linked).select(F.col("node").alias("id"), F.col("root").alias("class_id"))
    rows = classes.join(degree, "id").join(by_doc, "id", "left").join(likely(bodies, classes.select("id")), "id")

    def run(batches):
        for batch in slices(batches):
            ends = batch.column("spans").to_pylist()
            done = [cut(t, [(s["start"], s["end"]) for s in x or []]) for t, x in zip(unpacked(batch.column("text")), ends, strict=True)]
            new = {n: batch.column(n) for n in batch.schema.names}
            new["text"] = pa.array([t for t, _ in done], pa.string())
            new["removed_words"] = pa.array([n for _, n in done], pa.int64())
            yield pa.RecordBatch.from_pydict(new)

    rows = rows.select("id", "class_id", "links", "spans", "text", "text_hash", F.lit(0).cast("long").alias("removed_words"))
    cleaned = rows.mapInArrow(run, rows.withColumn("text", F.col("text").cast("string")).schema)
    return cleaned.select(F.col("id").alias("doc_id"), "class_id", "links", "removed_words", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,kept_in:bigint>>")).alias("spans"), "text", "text_hash")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs without repeated passages; documents that lose all their words go."""
    own = "_" * (1 + max(map(len, docs.columns)))  # begins no name of docs
    found = repeats(docs, **options).where("removed_words > 0").select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}hash"), F.col("text").alias(f"{own}new"))
    joined = docs.join(found, (F.col("doc_id") == F.col(f"{own}id")) & (F.xxhash64("text") == F.col(f"{own}hash")), "left")
    joined = joined.where(f"{own}id IS NULL OR {own}new <> ''").withColumn("text", F.coalesce(f"{own}new", "text"))
    return joined.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).drop("text_hash")
