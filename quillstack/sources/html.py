"""HTML: next-page links, search results and term fields, by the standard parser in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Elements(HTMLParser):
    """Elements in document order: tag, attributes, classes of all ancestors, text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        held = {"tag": tag, "attrs": dict(attrs), "above": [e for e in self.open], "text": []}
        self.found.append(held)
        if tag not in VOID:
            self.open.append(held)

    def handle_startendtag(self, tag, attrs):
        self.found.append({"tag": tag, "attrs": dict(attrs), "above": list(self.open), "text": []})

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for e in self.open:
            e["text"].append(data)


def elements(html: str | None) -> list[dict]:
    p = _Elements()
    p.feed(html or "")
    p.close()
    return p.found


def _classes(e: dict) -> list[str]:
    return (e["attrs"].get("class") or "").split()


def next_link(html: str | None, base: str) -> str | None:
    """Target of the first link marked ``rel="next"``, else of the first link inside a pager's next element."""
    links = [e for e in elements(html) if e["tag"] == "a" and e["attrs"].get("href")]
    for test in (lambda e: e["attrs"].get("rel") == "next", lambda e: any("pager-next" in _classes(x) for x in e["above"])):
        if hit := next((e for e in links if test(e)), None):
            return urljoin(base, hit["attrs"]["href"])
    return None


def answer_url(href: str) -> str | None:
    """Target of a result link: out of a redirect's ``uddg`` parameter, or an absolute one."""
    if "/l/?" in href and "uddg=" in href:
        return unquote(href.split("uddg=", 1)[1].split("&", 1)[0]) or None
    return href if href.startswith("http") else None


def search_results(html: str | None) -> list[dict]:
    """url and title of the result links of a search page."""
    out = []
    for e in elements(html):
        if e["tag"] == "a" and "result__a" in _classes(e) and (url := answer_url(e["attrs"].get("href") or "")):
            out.append({"url": url, "title": "".join(e["text"]).strip() or None})
    return out


def field_text(html: str | None, tags: tuple[str, ...] = ("title", "h1", "h2", "h3", "a", "label", "th")) -> str:
    """Text of headings, links and labels, and keywords and description of the head."""
    parts = []
    for e in elements(html):
        if e["tag"] in tags and not any(x["tag"] in tags for x in e["above"]):
            parts.append("".join(e["text"]))
        if e["tag"] == "meta" and e["attrs"].get("name") in ("keywords", "description"):
            parts.append(e["attrs"].get("content") or "")
    return " ".join(parts)


def next_page(html: Column, base: Column) -> Column:
    @F.pandas_udf("string")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([next_link(x, y) for x, y in zip(h, b)], dtype=object)

    return run(html, base)


def results(html: Column) -> Column:
    @F.pandas_udf("array<struct<url:string,title:string>>")
    def run(h: pd.Series) -> pd.Series:
        return h.map(search_results)

    return run(html)


def terms_of(html: Column) -> Column:
    """Text of the parts of a page that name its subjects."""

    @F.pandas_udf("string")
    def run(h: pd.Series) -> pd.Series:
        return h.map(field_text)

    return run(html)
