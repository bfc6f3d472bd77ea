"""Lempel-Ziv phrase fingerprints (operator 2).

A text is parsed into dictionary phrases (LZ78: each phrase is the longest known one and one more character), the set of
phrases is hashed, and the fingerprint is its minimum-hash signature: the SIZE least distinct 32-bit hashes, ascending.
Two fingerprints are compared over the SIZE least hashes of their union: the share that both have estimates the Jaccard
likeness of the phrase sets, and is exact where the union has no more than SIZE phrases. Texts that compress
well together share their phrases.

The neighbour of a document is the next one in descending order of doc_id; the last one's is the first. The table is
sorted by range partitions, so neighbours meet within a partition; only the first and last row of each partition are
matched across partitions.

Cases: a null text is the empty text, whose fingerprint is the empty string; two empty fingerprints are alike (1), an
empty one is unlike any other (0); rows that share a doc_id follow each other in the order of a hash of their texts; a null doc_id
comes last; a single document is its own neighbour; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.taskcontext import TaskContext

from cairn.llm.common import arrow_schema, documents, slices, stored
from cairn.llm.shingles import span_hashes

SIZE = 64


def phrase_ends(text: str, begun: list[int] = ()) -> list[int]:
    """Where each phrase of the LZ78 parse ends; a rest that is a known phrase is a phrase once more.

    begun: the ends of the first phrases, where they are known, so that they are not parsed again.
    """
    out = list(begun)
    seen = {text[a:b] for a, b in zip([0, *out], out, strict=False)}
    at = start = out[-1] if out else 0
    add, put, phrase = seen.add, out.append, ""
    for at, c in enumerate(text[start:], start + 1):
        phrase += c
        if phrase not in seen:
            add(phrase)
            put(at)
            phrase = ""
    if phrase:
        put(at)
    return out


def hashed(text: str, ends: list[int], size: int = SIZE) -> np.ndarray:
    """The least distinct phrase hashes. A phrase's hash is that of its characters, wherever it stands."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.array(ends)
    hashes = span_hashes(codes, np.concatenate([[0], stops[:-1]]), stops)
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:size]


def signature(text: str, size: int = SIZE) -> np.ndarray:
    return hashed(text, phrase_ends(text), size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) and not len(b):
        return 1.0
    least = np.union1d(a, b)[:size]
    return float(np.isin(least, a, assume_unique=True).dot(np.isin(least, b, assume_unique=True).astype(np.int64))) / len(least)


def written(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = SCHEMA + ", kind int, part int, text string, next_text string"


def compare(doc_id, text: str, ends: list[int], own: np.ndarray, following: str, next_signature: np.ndarray) -> tuple:
    edited, kept = edited_text(text, following), len(text) - len(text) // 3
    changed = own if edited == text else hashed(edited, phrase_ends(edited, ends[: bisect.bisect_right(ends, kept) - 1] if len(ends) > 1 else []))
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, next_signature)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text; no order is needed, so nothing is shuffled."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array([written(signature(t or "")) for t in batch.column("text").to_pylist()], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against its neighbour: NAMES."""
    kinds = arrow_schema(EDGE)
    names = [*NAMES, "kind", "part", "text", "next_text"]

    def within(batches):
        """Rows of the partition that have their neighbour in it (kind 0); its first (1) and its last row (2), with their texts."""
        part = TaskContext.get().partitionId()
        held = None  # the row that waits for its neighbour
        for batch in slices(batches):
            out: dict = {n: [] for n in names}

            def put(row: tuple, kind: int, text: str | None, out=out):
                for n, v in zip(names, (*row, kind, part, text, None), strict=True):
                    out[n].append(v)

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                ends = phrase_ends(text)
                own = hashed(text, ends)
                if held is None:
                    put((doc_id, *[None] * (len(NAMES) - 1)), 1, text)
                else:
                    put(compare(*held, text, own), 0, None)
                held = (doc_id, text, ends, own)
            yield pa.RecordBatch.from_pydict(out, schema=kinds)
        if held is not None:
            out = {n: [v] for n, v in zip(names, (held[0], *[None] * (len(NAMES) - 1), 2, part, held[1], None), strict=True)}
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    source = docs.select("doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]  # a hash: the bounds of ranges go to the driver
    ranged = source.repartitionByRange(n, *order).sortWithinPartitions(*order)
    table = stored(ranged.mapInArrow(within, EDGE), "fingerprints")

    # partitions are in the order of the table: a last row's neighbour is the first row of the next partition with rows
    edges = table.where("kind > 0").select("part", "kind")
    ring = Window.orderBy("part")  # a row for each partition
    firsts = edges.where("kind = 1").select("part", F.coalesce(F.lead("part").over(ring), F.min("part").over(Window.partitionBy())).alias("next_part"))
    last = table.where("kind = 2").select("part", "doc_id", "text")
    first = table.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    across = last.join(firsts, "part").join(first, "next_part").select("doc_id", "text", "next_text")
    flat = arrow_schema(SCHEMA)

    def over(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                ends = phrase_ends(text or "")
                rows.append(compare(doc_id, text or "", ends, hashed(text or "", ends), following or "", signature(following or "")))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(NAMES)}, schema=flat)

    return table.where("kind = 0").select(*NAMES).union(across.mapInArrow(over, SCHEMA))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
