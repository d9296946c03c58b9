"""Per-domain request pacing from a stream of responses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delays in milliseconds, factors, and the 403 window.
BASE, LEAST, MOST = 500, 100, 60_000
GROW, GROW_SERVER, SHRINK = 2.0, 1.5, 0.8
SUCCESSES = 5
WINDOW_SECONDS, WINDOW_URLS = 60, 3


def outcome(status: Column) -> Column:
    """limited, forbidden, server_error, success, or null."""
    return (
        F.when(status.isin(429, 503), "limited").when(status == 403, "forbidden").when(status >= 500, "server_error").when(status.between(200, 399), "success")
    )


def blocked_windows(log: DataFrame, least: int = WINDOW_URLS) -> DataFrame:
    """(source_id, minute, urls): distinct forbidden URLs per window of WINDOW_SECONDS."""
    found = log.filter("response_status = 403").groupBy("source_id", F.window("ts", f"{WINDOW_SECONDS} seconds").alias("w")).agg(F.countDistinct("url").alias("urls"))
    return found.filter(F.col("urls") >= least).select("source_id", F.unix_timestamp("w.start").alias("minute"), "urls")


def streamed_windows(log: DataFrame, late: str = "60 seconds") -> DataFrame:
    """The same over a stream, with approximate distinct counts and late rows dropped after ``late``."""
    marked = log.withWatermark("ts", late).filter("response_status = 403")
    return marked.groupBy("source_id", F.window("ts", f"{WINDOW_SECONDS} seconds").alias("w")).agg(F.approx_count_distinct("url").alias("urls"))


def ready_in(delay_ms: Column, elapsed_ms: Column) -> Column:
    return F.greatest(F.lit(0), delay_ms - elapsed_ms)


@dataclass
class Pace:
    """Delay of one domain; ``blocked`` holds recent forbidden URLs with their times."""

    delay: float = BASE
    successes: int = 0
    in_backoff: bool = False
    blocked: tuple[tuple[float, str], ...] = ()

    def see(self, at: float, status: int, url: str, retry_after: bool = False) -> None:
        self.blocked = tuple(b for b in self.blocked if at - b[0] <= WINDOW_SECONDS)
        if status in (429, 503):
            self._grow(GROW)
        elif status == 403:
            self.blocked += ((at, url),)
            if retry_after or len({u for _, u in self.blocked}) >= WINDOW_URLS:
                self._grow(GROW)
        elif status >= 500:
            self._grow(GROW_SERVER)
        elif 200 <= status < 400:
            self.successes += 1
            if self.in_backoff and self.successes >= SUCCESSES:
                self.delay, self.successes = max(LEAST, self.delay * SHRINK), 0
                self.in_backoff = self.delay > BASE

    def _grow(self, factor: float) -> None:
        self.delay, self.successes, self.in_backoff = min(MOST, self.delay * factor), 0, True


_STATE = "delay double, successes int, in_backoff boolean, times array<double>, urls array<string>"
_OUT = "source_id string, at timestamp, delay_ms double, in_backoff boolean"


def pace(log: DataFrame) -> DataFrame:
    """Delay per domain after each micro-batch of (source_id, ts, response_status, url)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = Pace()
        if state.exists:
            delay, successes, backoff, times, seen = state.get
            p = Pace(delay, successes, backoff, tuple(zip(times, seen)))
        rows = pd.concat(list(batches)).sort_values(["ts", "url"])
        for r in rows.itertuples():
            p.see(r.ts.timestamp(), int(r.response_status), r.url)
        state.update((p.delay, p.successes, p.in_backoff, [b[0] for b in p.blocked], [b[1] for b in p.blocked]))
        yield pd.DataFrame({"source_id": [key[0]], "at": [rows["ts"].max()], "delay_ms": [p.delay], "in_backoff": [p.in_backoff]})

    return log.select("source_id", "ts", "response_status", "url").groupBy("source_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def kept(blocked: DataFrame, now: Column, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Forbidden answers (ts) no older than the window."""
    return blocked.filter(F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds)))


def browser(healthy: list[str], turn: Column) -> Column:
    """The healthy browser whose turn it is, null if none is."""
    return F.get(F.array(*[F.lit(b) for b in sorted(healthy)]), F.pmod(turn, F.lit(max(1, len(healthy)))).cast("int"))


class RateLimits:
    """Pace of each domain in memory, the contract of a pacing store: read, update, and forget old blocks."""

    def __init__(self):
        self.paces: dict[str, Pace] = {}

    def get(self, domain: str) -> Pace:
        return self.paces.setdefault(domain, Pace())

    def see(self, domain: str, at: float, status: int, url: str, retry_after: bool = False) -> Pace:
        self.get(domain).see(at, status, url, retry_after)
        return self.paces[domain]

    def forget(self, now: float) -> None:
        for p in self.paces.values():
            p.blocked = tuple(b for b in p.blocked if now - b[0] <= WINDOW_SECONDS)
