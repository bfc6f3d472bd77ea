"""A block source behind a client of a remote snapshot service: any object with the methods list_snapshot_blocks,
list_changed_blocks and get_snapshot_block of the public block API (boto3's `ebs` client is one)."""

from __future__ import annotations

import datetime

from cairn.functions.scalars import NETWORK
from cairn.operators.resilience import SourceError
from cairn.sources.snapshots import Page

LIST_SECONDS, BLOCK_SECONDS = 60, 300


def service_client(region: str | None = None, profile: str | None = None):
    """A client with time limits, where the library is installed. Retries beyond its own are `retried`'s."""
    try:
        import boto3
        from botocore.config import Config
    except ImportError as missing:
        raise RuntimeError("a remote source needs boto3") from missing
    session = boto3.Session(profile_name=profile, region_name=region)
    return session.client("ebs", config=Config(connect_timeout=LIST_SECONDS, read_timeout=BLOCK_SECONDS, retries={"mode": "adaptive", "max_attempts": 4}))


def typed(error: Exception) -> SourceError:
    """A client's error as one with a code; errors without a response are the network's."""
    said = getattr(error, "response", None)
    if isinstance(said, dict):
        return SourceError(said.get("Error", {}).get("Code", "Unknown"), said.get("Error", {}).get("Message", ""))
    return SourceError(NETWORK, f"{type(error).__name__}: {error}")


class ServiceSource:
    """A service that rejects the page size is asked again without one, and never with one after that."""

    def __init__(self, client, page_size: int = 10_000):
        self.client, self.page_size, self.sized = client, page_size, True

    def _listed(self, call, names: dict, next_token: str | None, start: int, most: int | None) -> dict:
        asked = {**names, **({"NextToken": next_token} if next_token else {"StartingBlockIndex": start} if start else {})}
        sized = {"MaxResults": min(most or self.page_size, self.page_size)} if self.sized and not next_token else {}
        try:
            return call(**asked, **sized)
        except Exception as error:
            found = typed(error)
            if not sized or found.code != "ValidationException" or "MaxResults" not in str(found):
                raise found from error
        self.sized = False
        try:
            return call(**asked)
        except Exception as error:
            raise typed(error) from error

    @staticmethod
    def _page(said: dict, blocks: list[tuple[int, str]]) -> Page:
        expiry = said.get("ExpiryTime")
        if expiry is not None and expiry.tzinfo is not None:
            expiry = expiry.astimezone(datetime.UTC).replace(tzinfo=None)
        return Page(blocks, said.get("VolumeSize") or 0, said.get("BlockSize") or 0, expiry, said.get("NextToken") or None)

    def list_page(self, snapshot_id: str, next_token: str | None = None, start: int = 0, most: int | None = None) -> Page:
        said = self._listed(self.client.list_snapshot_blocks, {"SnapshotId": snapshot_id}, next_token, start, most)
        return self._page(said, [(b["BlockIndex"], b["BlockToken"]) for b in said.get("Blocks", []) if "BlockIndex" in b and "BlockToken" in b])

    def list_changed_page(self, first: str, second: str, next_token: str | None = None, start: int = 0, most: int | None = None) -> Page:
        said = self._listed(self.client.list_changed_blocks, {"FirstSnapshotId": first, "SecondSnapshotId": second}, next_token, start, most)
        return self._page(said, [(b["BlockIndex"], b.get("SecondBlockToken") or "") for b in said.get("ChangedBlocks", []) if "BlockIndex" in b])

    def get_block(self, snapshot_id: str, index: int, token: str) -> tuple[bytes, str]:
        try:
            said = self.client.get_snapshot_block(SnapshotId=snapshot_id, BlockIndex=index, BlockToken=token)
            data = said["BlockData"].read()
        except Exception as error:
            raise typed(error) from error
        if said.get("ChecksumAlgorithm", "SHA256") != "SHA256":
            raise SourceError("Checksum", f"the checksum is a {said['ChecksumAlgorithm']}")
        return data, said.get("Checksum") or ""
