"""Best-fit packing of tokenised documents into sequences (operator 7).

Bounded-space online best-fit: each task keeps at most `open_bins` open sequences, found through a bitset keyed by free
space. A piece goes to the open sequence with the least free space that still holds it; if none does, a new sequence
opens, and if too many are open the fullest closes first. Tasks pack what they read as they read it, the pieces of
`READ` documents at a time, longest first. What a task leaves open at its end is packed once more, by the same rule: the pieces
are dealt over tasks of about AGAIN tokens each, longest first, with room for all their sequences to be open. So the number of
sequences follows the tokens and not the tasks, and only pieces of open sequences are shuffled. Only documents longer than a sequence are
cut: the first piece has the remainder, the rest are full.

Ids are those of the tokenizer file's library; where its merges give the same ids through a faster encoder of ranks, that
one makes them (`same_ids` looks at the file's options, its pattern, and at every token of the vocabulary).

Cases: a null text is the empty text (its one token is the end id); very long texts are cut into full sequences; repeated rows,
rows that share a doc_id and rows with a null one are packed each; ties go to the sequence that opened last; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.taskcontext import TaskContext

from cairn.llm.byte_bpe import byte_chars
from cairn.llm.common import arrow_schema, documents, slices, stored

SEQUENCE, OPEN_BINS, READ, AGAIN = 2048, 256, 512, 1 << 22
#: Fixed value: how the byte-level pre-tokenizer of tokenizer files splits.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class OpenBins:
    """The open sequences by free space: bit f of `bits` is set if some open sequence has f free tokens."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.n_open, self.next_id = 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """The sequence and the offset of a piece of this length, and the sequences that close."""
        fits, closed = self.bits >> length, []
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.n_open >= self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest closes
            bin_id, free = self.next_id, self.capacity
            self.next_id += 1
        if left := free - length:
            self.open.setdefault(left, []).append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        else:
            closed.append(bin_id)
        return bin_id, self.capacity - free, closed

    def _take(self, free: int) -> int:
        bins = self.open[free]
        bin_id = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Full pieces but for the first, which has the remainder."""
    first = total % capacity or capacity
    return [min(first, total)] + [capacity] * ((total - first) // capacity)


def merge_ranks(tokenizer: str) -> dict[bytes, int] | None:
    """The ranks of a byte-level BPE tokenizer whose ids are in the order of its merges, without options that change what
    merges give; None for any other."""
    said = json.loads(tokenizer)
    model, split = said["model"], said["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or said["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    to_byte = {ord(c): b for b, c in enumerate(byte_chars())}
    raw = lambda piece: piece.translate(to_byte).encode("latin-1")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if any(x is None for x in ids) or ids != sorted(set(ids)):
        return None
    singles = {raw(c): model["vocab"][c] for c in byte_chars() if c in model["vocab"]}
    if len(singles) < 256 or max(singles.values()) > min(ids, default=1 << 40):
        return None
    return singles | {raw(a + b): x for (a, b), x in zip(merges, ids, strict=True)}


def same_ids(path: str, pattern: str) -> bool:
    """Whether an encoder of ranks gives this tokenizer's ids: its ids follow its merges, it splits by the pattern, and every
    token of the vocabulary that is text comes back as itself from both."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ranks = merge_ranks(tokenizer.to_str())
    if ranks is None or pattern != BYTE_LEVEL:
        return False
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    fast = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = []
    for token in ranks:
        try:
            texts.append(token.decode())
        except UnicodeDecodeError:
            continue
    texts = [t for t in texts if not any(a in t for a in added)]
    theirs = (e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False))
    return all(a == b for a, b in zip(theirs, fast.encode_ordinary_batch(texts, num_threads=1), strict=True))


def tokenizer_ids(path: str, pattern: str, fast: bool):
    """texts -> ids as bytes, those that the tokenizer file's library gives (without special tokens of its template).

    fast: the merges are handed to an encoder of ranks, several times as fast (see same_ids). Texts with an added token
    go through the library.
    """
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    if not fast:
        return lambda texts: [whole(text) for text in texts]
    import tiktoken

    ranks = merge_ranks(tokenizer.to_str())
    quick = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    return lambda texts: [whole(t) if any(a in t for a in added) else quick(t, disallowed_special=()).astype("<u4").tobytes() for t in texts]


class Packer:
    """Rows in the order in which their sequences close, with what is open at the end."""

    def __init__(self, sequence: int, open_bins: int, base: int):
        self.bins, self.base, self.rows = OpenBins(sequence, open_bins), base, {}

    def add(self, length: int, row: tuple) -> Iterator[tuple]:
        bin_id, offset, closed = self.bins.place(length)
        self.rows.setdefault(bin_id, []).append((*row, self.base + bin_id, offset))
        for one in closed:
            yield from self.rows.pop(one)

    def rest(self) -> Iterator[tuple]:
        for rows in self.rows.values():
            yield from rows
        self.rows = {}


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, path: str, pattern: str, sequence: int = SEQUENCE, end_id: int = 0, open_bins: int = OPEN_BINS, with_ids: bool = False, again: int = AGAIN) -> DataFrame:
    """A row for each piece; with_ids adds the piece's ids (binary, little-endian unsigned 32-bit)."""
    held = PIECE + ", ids binary" * with_ids
    schema = held + ", sequence_id long, offset long"
    names = [f.split()[0] for f in schema.split(", ")]
    seen = lambda batches: (pa.RecordBatch.from_pydict({"same": [same_ids(path, pattern)]}) for _ in batches)
    fast = docs.sparkSession.range(1, numPartitions=1).mapInArrow(seen, "same boolean").first().same  # the tables stay off the driver
    end = end_id.to_bytes(4, "little")

    def batch_of(rows, opened: bool | None):
        kinds = arrow_schema(schema)
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        made = pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)), schema=kinds)
        return made if opened is None else made.append_column("opened", pa.array([opened] * made.num_rows, pa.bool_()))

    def first(batches):
        encode, packer = tokenizer_ids(path, pattern, fast), Packer(sequence, open_bins, TaskContext.get().partitionId() << 32)
        for batch in slices(batches, READ):
            pieces = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode([text or "" for text in batch.column("text").to_pylist()]), strict=True):
                ids, start = ids + end, 0
                for piece, length in enumerate(piece_lengths(len(ids) // 4, sequence)):
                    pieces.append((length, doc_id, piece, start, ids))
                    start += length
            pieces.sort(key=lambda x: -x[0])  # stable: longest first within what was read together
            rows = []
            for length, doc_id, piece, start, ids in pieces:
                part = ids[4 * start : 4 * (start + length)]
                rows += packer.add(length, (doc_id, piece, start, length, zlib.crc32(part), *[part][: int(with_ids)]))
            yield batch_of(rows, False)
        yield batch_of(packer.rest(), True)

    def second(batches):
        # as many sequences may be open as the task's tokens can fill twice over
        packer = Packer(sequence, 4 * again // sequence, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for batch in slices(batches, READ):
            columns = [batch.column(n).to_pylist() for n in names[:-2]]
            yield batch_of([x for row in zip(*columns, strict=True) for x in packer.add(row[3], row)], None)
        yield batch_of(packer.rest(), None)

    packed = stored(docs.select("doc_id", "text").mapInArrow(first, schema + ", opened boolean"), "pieces")
    left = packed.where("opened").drop("opened")
    tasks = 1 + (left.agg(F.sum("length").alias("n")).first().n or 0) // again
    dealt = left.repartition(tasks, F.xxhash64("doc_id", "piece", "sequence_id", "offset")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    return packed.where("NOT opened").drop("opened").union(dealt.select(names).mapInArrow(second, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_default(documents(spark, sf_dir))


def pack_default(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
