"""Dates: publication dates from headers, file names and URLs; CDX stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Date patterns in the order they are tried, with the group numbers of year, month and day.
PATTERNS = (
    (r"(\d{4})[-_/](\d{2})[-_/](\d{2})", (1, 2, 3)),
    (r"(\d{2})[-_/](\d{2})[-_/](\d{4})", (3, 1, 2)),
    (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    (r"(\d{4})[-_/]?(\d{2})(?:\D|$)", (1, 2, None)),
)
FIRST_YEAR = 1900


def in_name(name: Column, last_year: int) -> Column:
    """First valid date between FIRST_YEAR and ``last_year`` that a pattern finds, null if none does."""
    found = []
    for pattern, (y, m, d) in PATTERNS:
        group = lambda g, p=pattern: F.regexp_extract(name, p, g)
        text = F.concat_ws("-", group(y), group(m), group(d) if d else F.lit("01"))
        date = F.when(group(y) != "", F.try_to_date(text, "yyyy-MM-dd"))
        found.append(F.when(F.year(date).between(FIRST_YEAR, last_year), date))
    return F.coalesce(*found)


def server(server_date: Column, acquired: Column) -> Column:
    """The server's date if it is not the epoch and over 24 whole hours from the acquisition."""
    seconds = server_date.cast("long") - acquired.cast("long")
    hours = F.floor(F.abs(seconds) / 3600)
    return F.when((server_date.cast("long") != 0) & (hours > 24), server_date)


def detect(server_date: Column, acquired: Column, filename: Column, url: Column, last_year: int) -> Column:
    """struct(date, confidence, source) of a document, null if nothing tells."""
    sent = server(server_date, acquired)
    named = F.coalesce(in_name(filename, last_year), in_name(urls.path(url), last_year))
    made = lambda date, confidence, source: F.struct(date.alias("date"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
    return F.when(sent.isNotNull(), made(F.to_date(sent), "high", "server")).when(named.isNotNull(), made(named, "medium", "filename"))


def from_cdx(stamp: Column) -> Column:
    """Timestamp of the first 14 digits, null if they are none."""
    return F.try_to_timestamp(F.substring(stamp, 1, 14), F.lit("yyyyMMddHHmmss"))


def to_cdx(at: Column) -> Column:
    return F.date_format(at, "yyyyMMddHHmmss")


def archive_url(base: str, at: Column, url: Column, raw: bool = False) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), to_cdx(at), F.lit("id_/" if raw else "/"), url)


def parsed(text: Column, required: bool = True) -> Column:
    """Time of an RFC 3339 text; of anything else the epoch, or null if it is not required."""
    t = F.upper(F.btrim(text))
    bare = F.regexp_replace(t, r"\.\d+", "")
    at = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return F.coalesce(at, F.timestamp_seconds(F.lit(0))) if required else at
