"""Discovery over injected fetchers: paged, cursor and nested APIs, sitemaps, conditional requests.

``fetch(url, params)`` returns parsed JSON (or text for sitemaps); nothing here
touches a network by itself, so tests and replays pass recorded answers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

MOST_SITEMAPS = 100
Fetch = Callable[[str, dict], object]


def path_value(item, path: str):
    """Value at a dot path; numbers index lists, missing is None."""
    for part in path.split(".") if path else ():
        if isinstance(item, list) and part.isdigit():
            item = item[int(part)] if int(part) < len(item) else None
        elif isinstance(item, dict):
            item = item.get(part)
        else:
            return None
    return item


def paged(fetch: Fetch, url: str, items: str, page_param: str = "page", size_param: str | None = None, size: int = 100, start: int = 1) -> Iterator:
    """Items page by page, until one is empty or short."""
    page = start
    while True:
        found = path_value(fetch(url, {page_param: page} | ({size_param: size} if size_param else {})), items) or []
        yield from found
        if len(found) < size:
            return
        page += 1


def by_cursor(fetch: Fetch, url: str, items: str, cursor: str, param: str = "cursor") -> Iterator:
    """Items along the answers' cursors; a repeated cursor ends it."""
    at, seen = None, set()
    while True:
        answer = fetch(url, {param: at} if at is not None else {})
        yield from path_value(answer, items) or []
        at = path_value(answer, cursor)
        if at is None or at == "" or at in seen:
            return
        seen.add(at)


def nested(fetch: Fetch, url: str, items: str, key: str, child: str, child_items: str = "") -> Iterator:
    """Items of the child endpoint (``{id}``) of every parent item."""
    for parent in path_value(fetch(url, {}), items) or []:
        if (at := path_value(parent, key)) is not None:
            found = path_value(fetch(child.replace("{id}", str(at)), {}), child_items)
            yield from found if isinstance(found, list) else [found] if found is not None else []


def descend(item, names: list[str]) -> Iterator:
    """Leaves below named arrays, one inside the other."""
    if not names:
        yield item
        return
    for each in path_value(item, names[0]) or []:
        yield from descend(each, names[1:])


def walk_sitemaps(fetch: Fetch, start: list[str], most: int = MOST_SITEMAPS) -> Iterator[str]:
    """Page URLs of sitemaps and their indexes, last found first, each once, ``most`` files at most."""
    stack, seen = list(start), set()
    while stack and len(seen) < most:
        url = stack.pop()
        if url in seen:
            continue
        seen.add(url)
        text = str(fetch(url, {}))
        locs = [x.strip() for x in re.findall(r"<loc>([^<]*)</loc>", text)]
        if "<sitemapindex" in text:
            stack += locs
        else:
            yield from locs


@dataclass(frozen=True)
class Seen:
    """What an earlier answer said about its freshness."""

    etag: str | None = None
    last_modified: str | None = None


def conditional_headers(seen: Seen | None) -> dict[str, str]:
    pairs = (("If-None-Match", seen.etag), ("If-Modified-Since", seen.last_modified)) if seen else ()
    return {k: v for k, v in pairs if v}


def fetched_state(status: int, body: bytes | None) -> str:
    """State of a crawl URL after an answer."""
    return "skipped" if status == 304 else "fetched" if status in (200, 206) and body else "failed"


def pick_browser(healthy: list[str], domain: str, strategy: str = "per_domain", turn: int = 0) -> str | None:
    """A healthy browser: by turn, or always the same for a domain."""
    if not healthy:
        return None
    place = turn if strategy == "round_robin" else sum(domain.encode()) * 2654435761
    return sorted(healthy)[place % len(healthy)]


def fetch_all(urls: DataFrame, fetch: Callable[[str], tuple[int, str | None, bytes]]) -> DataFrame:
    """(url, status, mime_type, size, body, error) of ``fetch(url)`` for every URL, in as many tasks as there are partitions; errors are rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url in b["url"]:
                try:
                    status, kind, body = fetch(url)
                    out.append((url, status, kind, len(body), body, None))
                except Exception as e:  # a failed request is a row with its error
                    out.append((url, 0, None, 0, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["url", "status", "mime_type", "size", "body", "error"])

    return urls.select("url").mapInPandas(run, "url string, status int, mime_type string, size long, body binary, error string")


def scrape(frontier: DataFrame, fetch: Callable[[str], tuple[int, str | None, bytes]], now: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Answers for the next ``most`` discovered URLs, and the frontier after them."""
    from ..operators import crawl, work

    claimed = work.claim_urls(frontier, most)
    answers = crawl.checkpointed(fetch_all(claimed, fetch).dropDuplicates(["url"]))
    return answers, work.fetched(frontier, answers, now)
