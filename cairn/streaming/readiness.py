"""Waiting until snapshots are ready."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame

from cairn.operators.planner import readiness


def wait_ready(poll: Callable[[], DataFrame], seconds: float = 0, every: float = 10.0, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> bool:
    """True when all snapshots of poll() (snapshot_id, state, message) are ready. Failed ones are an error at once, pending
    ones after the deadline; if the states cannot be had, that is a warning and work may begin."""
    deadline = now() + seconds
    while True:
        try:
            row = readiness(poll()).first()
        except Exception as error:
            warnings.warn(f"snapshot states are not known: {error}", stacklevel=2)
            return True
        if row.failed:
            raise ValueError(f"snapshots failed: {row.failed}")
        if row.ready:
            return True
        if now() >= deadline:
            raise TimeoutError(f"snapshots are pending: {row.pending}")
        sleep(every)
