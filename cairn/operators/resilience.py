"""Concurrency that adapts, and fetches that retry, refresh tokens and check what they get."""

from __future__ import annotations

import base64
import datetime
import hashlib
import random
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from cairn.functions.scalars import CHECKSUM, DENIED_CODES, RETRYABLE, THROTTLE_CODES

MAX_CONCURRENCY, CALM_SECONDS = 32, 15.0
SLOTS = 4  # of one task
MARGIN = datetime.timedelta(minutes=2)


def adaptive_fold(events: Column, most: int = MAX_CONCURRENCY) -> Column:
    """Usable slots after a sequence of events: true halves (to one at least), false adds one (to `most`)."""
    step = lambda usable, throttled: F.when(throttled, F.greatest(F.lit(1).cast("long"), F.floor(usable / 2))).otherwise(F.least(F.lit(most).cast("long"), usable + 1))
    return F.aggregate(events, F.lit(most).cast("long"), step)


def replay_limiter(events: DataFrame, key: str, order: str, throttled: Column, most: int = MAX_CONCURRENCY) -> DataFrame:
    """key, usable: the fold of each key's events in order. A key's events are one array of booleans."""
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), throttled.alias("t")))).alias("e"))
    return rows.select(key, adaptive_fold(F.transform("e", lambda s: s["t"]), most).alias("usable"))


class Limiter:
    """Slots for one task: halved when throttled, one more for each release after a calm period."""

    def __init__(self, most: int = MAX_CONCURRENCY, calm: float = CALM_SECONDS, now: Callable[[], float] = time.monotonic):
        self.most, self.usable, self.calm, self.now = most, most, calm, now
        self.last, self.lock = float("-inf"), threading.Lock()

    def throttled(self) -> None:
        with self.lock:
            self.usable = max(1, self.usable // 2)
            self.last = self.now()

    def released(self) -> None:
        with self.lock:
            if self.usable < self.most and self.now() - self.last > self.calm:
                self.usable += 1


class SourceError(Exception):
    """An error of a block source, with its code."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


def is_throttle(error: BaseException) -> bool:
    return getattr(error, "code", None) in THROTTLE_CODES


def is_denied(error: BaseException) -> bool:
    return getattr(error, "code", None) in DENIED_CODES


def is_retryable(error: BaseException) -> bool:
    code = getattr(error, "code", None)
    if isinstance(code, str):
        return code in RETRYABLE
    return isinstance(error, ConnectionError | TimeoutError) or "unexpected EOF" in str(error)


def delay(attempt: int, throttled: bool, draw: Callable[[], float] = random.random) -> float:
    """Seconds before a further attempt: half of a doubling bound, and up to the other half by chance."""
    bound = min(30.0, (1.0 if throttled else 0.5) * 2**attempt)
    return bound / 2 + draw() * bound / 2


def retried(call: Callable[[], object], attempts: int = 5, sleep: Callable[[float], None] = time.sleep, on_throttle: Callable[[], None] = lambda: None):
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:
            if is_throttle(error):
                on_throttle()
            if attempt + 1 == attempts or not is_retryable(error):
                raise
            sleep(delay(attempt, is_throttle(error)))
    raise ValueError("no attempts")


def checked_block(data: bytes, sha256: str | None) -> bytes:
    if not data or not sha256:
        raise SourceError(CHECKSUM, "no data or no checksum")
    if base64.b64encode(hashlib.sha256(data).digest()).decode() != sha256:
        raise SourceError(CHECKSUM, "the bytes do not match")
    return data


class Tokens:
    """The block tokens that a task holds. One is fresh while MARGIN is left before it expires; a page that is listed to renew
    one renews all that it names."""

    def __init__(self, source, snapshot_id: str, attempts: int = 5, sleep: Callable[[float], None] = time.sleep, now: Callable[[], datetime.datetime] | None = None):
        self.source, self.snapshot_id, self.attempts, self.sleep = source, snapshot_id, attempts, sleep
        self.now = now or (lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        self.held: dict[int, tuple[str, datetime.datetime | None]] = {}

    def learn(self, blocks, expiry: datetime.datetime | None) -> None:
        self.held.update((index, (token, expiry)) for index, token in blocks)

    def forget(self, index: int) -> None:
        self.held.pop(index, None)

    def of(self, index: int) -> str:
        token, expiry = self.held.get(index, ("", None))
        if token and (expiry is None or self.now() <= expiry - MARGIN):
            return token
        page = retried(lambda: self.source.list_page(self.snapshot_id, start=index), self.attempts, self.sleep)
        self.learn(page.blocks, page.expiry)
        if index not in dict(page.blocks):
            raise SourceError("NotFound", f"block {index} is not listed any more")
        return self.held[index][0]


def fetch_block(source, snapshot_id: str, index: int, token: str, attempts: int = 5, sleep: Callable[[float], None] = time.sleep, on_throttle: Callable[[], None] = lambda: None, tokens: Tokens | None = None) -> bytes:
    """A block's checked bytes. A stale token is renewed before it is used, a denied one once, and one that has failed twice as
    well, for the token may be what fails."""
    if tokens is None:
        tokens = Tokens(source, snapshot_id, attempts, sleep)
        tokens.learn([(index, token)], None)
    failed, denied = 0, False

    def once() -> bytes:
        nonlocal failed, denied
        while True:
            try:
                return checked_block(*source.get_block(snapshot_id, index, tokens.of(index)))
            except SourceError as error:
                failed += 1
                again = is_denied(error) and not denied
                if again or failed > 1:
                    tokens.forget(index)
                if not again:
                    raise
                denied = True

    return retried(once, attempts, sleep, on_throttle)


def fetch(pending: DataFrame, source_maker: Callable[[], object], snapshot_id: str, attempts: int = 5, slots: int = SLOTS) -> DataFrame:
    """idx, byte_offset, length, sha256, data of pending blocks (idx, byte_offset, token and, if known, expiry), fetched in
    the tasks, as many at once as the task's limiter allows. Blocks of a snapshot do not change, so a task that runs again gives the
    same rows."""
    import pyarrow as pa

    kinds = pa.schema([("idx", pa.int64()), ("byte_offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("data", pa.binary())])

    def run(batches):
        source, limiter = source_maker(), Limiter(slots)
        tokens = Tokens(source, snapshot_id, attempts)

        def one(index: int) -> bytes:
            data = fetch_block(source, snapshot_id, index, "", attempts, on_throttle=limiter.throttled, tokens=tokens)
            limiter.released()
            return data

        with ThreadPoolExecutor(slots) as pool:
            for batch in batches:
                rows = batch.to_pylist()
                for r in rows:
                    tokens.learn([(r["idx"], r["token"])], r["expiry"])
                at = 0
                while at < len(rows):
                    now = rows[at : at + limiter.usable]
                    at += len(now)
                    got = list(pool.map(one, [r["idx"] for r in now]))
                    for r in now:
                        tokens.forget(r["idx"])
                    yield pa.RecordBatch.from_pydict({
                        "idx": [r["idx"] for r in now], "byte_offset": [r["byte_offset"] for r in now], "length": [len(x) for x in got],
                        "sha256": [base64.b64encode(hashlib.sha256(x).digest()).decode() for x in got], "data": got,
                    }, schema=kinds)

    expiry = F.to_timestamp_ntz(F.col("expiry").cast("string")) if "expiry" in pending.columns else F.lit(None).cast("timestamp_ntz")
    return pending.select("idx", "byte_offset", "token", expiry.alias("expiry")).mapInArrow(run, "idx long, byte_offset long, length long, sha256 string, data binary")
