"""Results kept for a while: small statistics that many readers ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row

SECONDS = 300
#: Rows of a kept result at most; larger ones are computed each time.
MOST = 10_000


class Kept:
    """Rows of frames by key, for ``seconds`` from when they were computed; the caller tells the time."""

    def __init__(self, seconds: int = SECONDS):
        self.seconds = seconds
        self.held: dict[str, tuple[float, list[Row]]] = {}

    def rows(self, key: str, now: float, make: Callable[[], DataFrame]) -> list[Row]:
        at, found = self.held.get(key, (float("-inf"), []))
        if now - at < self.seconds:
            return found
        found = make().limit(MOST + 1).collect()
        if len(found) > MOST:
            raise ValueError(f"{key} has over {MOST} rows")
        self.held[key] = (now, found)
        return found

    def drop(self, key: str | None = None) -> None:
        self.held = {} if key is None else {k: v for k, v in self.held.items() if k != key}
