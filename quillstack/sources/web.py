"""Web sources: WARC files, CDX answers, sitemaps, robots.txt, URL lists, JSON APIs."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = 1 << 25
_STATUS = re.compile(rb"^HTTP/\d(?:\.\d)? (\d{3})")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; gzip members are read through."""
    raw = io.BytesIO(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
    while line := raw.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := raw.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, raw.read(int(headers.get("content-length", 0)))


def http_payload(block: bytes) -> tuple[int | None, str | None, bytes]:
    """Status, type without parameters, and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    status = _STATUS.match(head)
    kind = re.search(rb"(?im)^content-type:\s*([^;\r\n]+)", head)
    return int(status[1]) if status else None, kind[1].strip().decode("latin-1").lower() if kind else None, body


#: What stands between two records, up to the version's last digit.
BETWEEN = "\r\n\r\nWARC/1."
_WARC = "path string, type string, url string, status int, mime_type string, body binary, at string"


def _row(path: str, headers: dict[str, str], block: bytes) -> tuple:
    status, kind, body = http_payload(block) if headers.get("warc-type") == "response" else (None, None, b"")
    return path, headers.get("warc-type"), (headers.get("warc-target-uri") or "").strip("<>") or None, status, kind, body, headers.get("warc-date")


def read_warc(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(path, type, url, status, mime_type, body, at) of all records.

    Records are read as lines, so plain files in splits and compressed ones a
    record at a time.  A record that holds another WARC file's border is cut
    there: it comes out with type ``truncated``, and ``whole`` reads such files,
    one a task.
    """
    if whole:
        return warc_rows(spark.read.format("binaryFile").load(path).select("path", "content"))
    lines = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("raw"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["raw"]):
                raw = bytes(raw)
                data = raw if raw.startswith(b"WARC/") else b"WARC/1." + raw
                for headers, block in warc_records(data):
                    if len(block) < int(headers.get("content-length", 0)):
                        headers = headers | {"warc-type": "truncated"}
                    rows.append(_row(p, headers, block))
                    break
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _WARC.split(", ")])

    return lines.mapInPandas(parse, _WARC)


def warc_rows(files: DataFrame) -> DataFrame:
    """``read_warc`` of (path, content) rows; records leave in frames of about FRAME bytes."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "type", "url", "status", "mime_type", "body", "at"]
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                rows, held = [], 0
                for h, block in warc_records(content):
                    rows.append(_row(p, h, block))
                    held += len(block)
                    if held > FRAME:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(parse, _WARC)


def warc_reason(pattern: str | None = None) -> Column:
    """Why a record is skipped, null if it is imported."""
    out = F.when(F.col("type") != "response", "not_response").when(F.col("url").isNull() | ~F.col("url").rlike("^https?://"), "no_url")
    if pattern:
        out = out.when(~F.col("url").rlike(pattern), "filtered")
    return out.when(~F.coalesce(F.col("status").isin(200, 206), F.lit(False)), "status").when(F.length("body") == 0, "empty")


def load_warc(records: DataFrame, sources: DataFrame, known_urls: DataFrame, pattern: str | None = None) -> DataFrame:
    """New documents: imported records, the first of a URL, with the source of the longest fitting base URL."""
    kept = records.filter(warc_reason(pattern).isNull()).join(known_urls.select("url"), "url", "left_anti")
    first = kept.groupBy("url").agg(F.min_by(F.struct("path", "mime_type", "body", "at"), F.struct("at", "path")).alias("r")).select("url", "r.*")
    return with_source(first, sources)


def with_source(frame: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id`` of the longest base_url that begins the URL; null if none does.  Sources are joined by host."""
    host = lambda c: F.regexp_extract(c, r"://([^/?#]+)", 1)
    known = sources.select(F.col("source_id").alias("__source"), "base_url", host("base_url").alias("__host"))
    hits = frame.select("url").distinct().withColumn("__host", host("url")).join(known, "__host").filter(F.startswith("url", F.col("base_url")))
    best = hits.groupBy("url").agg(F.max_by("__source", F.struct(F.length("base_url"), "__source")).alias("source_id"))
    return frame.join(best, "url", "left")


def read_cdx(answers: DataFrame) -> DataFrame:
    """A map per row of CDX answers in column ``value``: the first row names the columns, ``-`` is null."""
    rows = answers.select(F.from_json("value", "array<array<string>>").alias("a")).filter(F.size("a") > 1)
    each = rows.select(F.get("a", F.lit(0)).alias("header"), F.explode(F.slice("a", F.lit(2), F.size("a") - 1)).alias("row"))
    return each.select(F.map_from_arrays("header", F.transform("row", lambda x: F.nullif(x, F.lit("-")))).alias("fields"))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def sitemap_urls(xml: Column) -> Column:
    """First location of each line, XML entities resolved."""
    found = F.transform(F.split(xml, "\n"), lambda x: F.btrim(F.regexp_extract(x, "<loc>([^<]*)</loc>", 1)))
    kept = F.filter(found, lambda x: x != "")
    for entity, char in _ENTITIES:
        kept = F.transform(kept, _replacer(entity, char))
    return kept


def _replacer(entity: str, char: str):
    return lambda x: F.replace(x, F.lit(entity), F.lit(char))


def robots_sitemaps(text: Column) -> Column:
    """Targets of ``Sitemap:`` lines, in any case."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(x))
    return F.transform(F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit("sitemap:"))), lambda x: F.btrim(F.substring(x, 9, 1 << 20)))


def url_list(lines: DataFrame, known_urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New URLs of a list in column ``value`` (blank and ``#`` lines skipped), and its invalid lines."""
    kept = lines.select(F.btrim("value").alias("url")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))
    valid = F.col("url").rlike(r"^https?://[^/?#\s]+")
    return kept.filter(valid).distinct().join(known_urls.select("url"), "url", "left_anti"), kept.filter(~valid)


def json_path(path: str) -> str:
    """Dot path as a JSON path; numbers index arrays."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def json_value(item: Column, path: str) -> Column:
    return F.get_json_object(item, json_path(path))


def item_url(item: Column, field: str | None, template: str | None = None, fallback: str | None = None) -> Column:
    """URL of an API item: its field, else the template with ``{path}`` filled, else the fallback field."""
    choices = [json_value(item, field)] if field else []
    if template:
        parts = re.split(r"\{([^}]+)\}", template)
        choices.append(F.concat(*[json_value(item, p) if i % 2 else F.lit(p) for i, p in enumerate(parts)]))
    if fallback:
        choices.append(json_value(item, fallback))
    return F.coalesce(*choices)


def descend(frame: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``frame`` once for each JSON item below the named arrays of ``column``, one inside the other; the item takes its place."""
    for name in names:
        frame = frame.withColumn(column, F.explode(F.from_json(json_value(F.col(column), name), "array<string>")))
    return frame
