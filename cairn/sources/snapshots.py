"""Block sources: what a remote snapshot store must offer, one held in memory for tests, and Spark data sources over both.

A source is named by "module:callable", so that executors can make their own; nothing of a connection is pickled.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import importlib
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions.scalars import GIB
from cairn.operators.resilience import SourceError, retried

LISTING = "page INT, position INT, idx BIGINT, token STRING, expiry TIMESTAMP, volume_gib BIGINT, block_size BIGINT"


class Page(NamedTuple):
    blocks: list[tuple[int, str]]
    volume_gib: int
    block_size: int
    expiry: datetime.datetime | None
    next_token: str | None


class BlockSource(Protocol):
    def list_page(self, snapshot_id: str, next_token: str | None = None, start: int = 0, most: int | None = None) -> Page: ...

    def list_changed_page(self, first: str, second: str, next_token: str | None = None, start: int = 0, most: int | None = None) -> Page:
        """As list_page; an empty token marks a block that is no longer allocated."""

    def get_block(self, snapshot_id: str, index: int, token: str) -> tuple[bytes, str]: ...


@dataclass
class Snapshot:
    volume_gib: int
    blocks: dict[int, bytes]
    block_size: int = 512 * 1024


@dataclass
class MemorySource:
    """Snapshots in memory. fail(call, n): the typed error to raise at the n-th call of get_block or list, or None."""

    snapshots: dict[str, Snapshot]
    page_size: int = 10_000
    expiry: datetime.datetime | None = None
    fail: object = None
    calls: dict[str, int] = field(default_factory=lambda: {"list": 0, "get": 0})
    generation: int = 0

    def _called(self, what: str) -> None:
        self.calls[what] += 1
        if self.fail and (error := self.fail(what, self.calls[what])):
            raise error

    def _token(self, snapshot_id: str, index: int) -> str:
        return f"g{self.generation}-{snapshot_id}-i{index}"

    def _page(self, indexes: list[int], token_of, geometry: Snapshot, next_token: str | None, start: int, most: int | None) -> Page:
        low = int(next_token) if next_token else start
        rest = [i for i in indexes if i >= low]
        size = min(most or self.page_size, self.page_size)
        return Page([(i, token_of(i)) for i in rest[:size]], geometry.volume_gib, geometry.block_size, self.expiry, str(rest[size]) if len(rest) > size else None)

    def list_page(self, snapshot_id, next_token=None, start=0, most=None):
        self._called("list")
        snapshot = self.snapshots[snapshot_id]
        return self._page(sorted(snapshot.blocks), lambda i: self._token(snapshot_id, i), snapshot, next_token, start, most)

    def list_changed_page(self, first, second, next_token=None, start=0, most=None):
        self._called("list")
        a, b = self.snapshots[first], self.snapshots[second]
        changed = sorted(i for i in a.blocks.keys() | b.blocks.keys() if a.blocks.get(i) != b.blocks.get(i))
        return self._page(changed, lambda i: self._token(second, i) if i in b.blocks else "", b, next_token, start, most)

    def get_block(self, snapshot_id, index, token):
        self._called("get")
        if token != self._token(snapshot_id, index):
            raise SourceError("AccessDeniedException", "the token is not valid")
        data = self.snapshots[snapshot_id].blocks[index]
        return data, base64.b64encode(hashlib.sha256(data).digest()).decode()


def made_snapshot(seed: int, volume_gib: int, n_blocks: int, block_size: int = 512 * 1024, zero_every: int = 0) -> Snapshot:
    """A snapshot of random blocks at random places, the same for the same seed."""
    rng = np.random.default_rng(seed)
    places = sorted(rng.choice(volume_gib * GIB // block_size, n_blocks, replace=False).tolist())
    return Snapshot(volume_gib, {i: bytes(block_size) if zero_every and i % zero_every == 0 else rng.bytes(block_size) for i in places}, block_size)


def make_source(name: str) -> BlockSource:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


@dataclass
class Span(InputPartition):
    number: int
    start: int
    end: int


class ListingReader(DataSourceReader):
    """A partition lists the pages of a range of indexes; geometry comes from one page asked for by the driver."""

    def __init__(self, options: dict):
        self.source, self.snapshot, self.first = options["source"], options["snapshot"], options.get("first")
        self.most = int(options["page_size"]) if "page_size" in options else None
        self.parts = int(options.get("partitions", 8))

    def _page(self, source: BlockSource, token: str | None, start: int, most: int | None) -> Page:
        if self.first:
            return retried(lambda: source.list_changed_page(self.first, self.snapshot, token, start, most))
        return retried(lambda: source.list_page(self.snapshot, token, start, most))

    def partitions(self):
        page = self._page(make_source(self.source), None, 0, 1)
        blocks = max(1, page.volume_gib * GIB // page.block_size)
        step = -(-blocks // self.parts)
        return [Span(n, start, start + step) for n, start in enumerate(range(0, blocks, step))]

    def read(self, partition: Span):
        source, token, number = make_source(self.source), None, 0
        while True:
            page = self._page(source, token, partition.start, self.most)
            for position, (index, block_token) in enumerate(page.blocks):
                if index >= partition.end:
                    return
                yield (partition.number * (1 << 20) + number, position, index, block_token, page.expiry, page.volume_gib, page.block_size)
            token, number = page.next_token, number + 1
            if not token:
                return


class ListingSource(DataSource):
    """format("block_listing"): options source, snapshot, first (lists what changed since it), page_size, partitions."""

    @classmethod
    def name(cls):
        return "block_listing"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return ListingReader(self.options)


def listing(spark: SparkSession, source: str, snapshot: str, first: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(ListingSource)
    reader = spark.read.format("block_listing").option("source", source).option("snapshot", snapshot)
    if first:
        reader = reader.option("first", first)
    return reader.options(**options).load()
