"""Discovery: special URLs, search queries, candidate paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URL parts.
YOUTUBE = ("youtube.com/watch", "youtu.be/", "youtube.com/playlist", "youtube.com/channel")
_DRIVE_FOLDER = r"drive\.google\.com/(?:drive/)?(?:u/\d+/)?folders/([A-Za-z0-9_-]+)"
_DRIVE_FILE = r"drive\.google\.com/(?:file/d/|open\?id=|uc\?(?:.*&)?id=)([A-Za-z0-9_-]+)"


def is_youtube(url: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in YOUTUBE]), lambda p: F.contains(url, p))


def drive_id(url: Column) -> Column:
    """struct(kind, id) of a shared folder or file, null for other URLs."""
    folder, file = F.regexp_extract(url, _DRIVE_FOLDER, 1), F.regexp_extract(url, _DRIVE_FILE, 1)
    made = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("id"))
    return F.when(folder != "", made("folder", folder)).when(file != "", made("file", file))


def search_query(site: str | None = None, filetype: str | None = None, inurl: str | None = None, phrases: list[str] = (), terms: list[str] = (), excluded: list[str] = ()) -> str:
    """Operators first, then quoted phrases, terms and exclusions."""
    parts = [f"{k}:{v}" for k, v in (("site", site), ("filetype", filetype), ("inurl", inurl)) if v]
    return " ".join([*parts, *(f'"{p}"' for p in phrases), *terms, *(f"-{x}" for x in excluded)])


def paths(domains: DataFrame, candidates: list[str]) -> DataFrame:
    """(domain, url): every candidate path below every domain."""
    each = F.explode(F.array(*[F.lit("/" + p.lstrip("/")) for p in candidates]))
    return domains.select("domain", each.alias("path")).select("domain", F.concat(F.lit("https://"), "domain", "path").alias("url"))


def union_terms(*lists: Column, most: int = 100) -> Column:
    """Distinct terms of several lists in order, ``most`` at most."""
    return F.slice(F.array_distinct(F.transform(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda t: F.lower(t))), 1, most)


def truncate(text: Column, most_bytes: int) -> Column:
    """As many whole characters as fit in ``most_bytes`` bytes of UTF-8."""
    head = F.substring(text, 1, most_bytes)
    size = lambda n: F.octet_length(F.substring(text, F.lit(1), n))
    steps = [1 << k for k in range(most_bytes.bit_length(), -1, -1)]
    fits = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: F.when(size(n + s) <= most_bytes, n + s).otherwise(n))
    return F.when(F.octet_length(text) <= most_bytes, text).when(F.octet_length(head) <= most_bytes, head).otherwise(F.substring(text, F.lit(1), fits))


def listed(text: Column, most: int | None = None) -> Column:
    """Parts of a comma list, trimmed, without empty ones, ``most`` at most; none of null."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")
    return parts if most is None else F.slice(parts, 1, most)


def ordered(frame: DataFrame, column: str, most: int = 0) -> DataFrame:
    """Distinct values in order, all of them for 0."""
    out = frame.select(column).distinct().orderBy(column)
    return out.limit(most) if most else out


def index_query(base: str, pattern: Column, fields: list[str] = (), match: str | None = None, collapse: str | None = None, filters: list[str] = (), since: str | None = None, until: str | None = None, limit: int | None = None) -> Column:
    """URL of a capture index query; wildcards of the pattern stay, a limit of 0 is left out."""
    quoted = F.replace(F.replace(F.replace(F.url_encode(pattern), F.lit("+"), F.lit("%20")), F.lit("%2A"), F.lit("*")), F.lit("%7E"), F.lit("~"))
    rest = [("fl", ",".join(fields) or None), ("matchType", match), ("collapse", collapse), *(("filter", f) for f in filters), ("from", since), ("to", until), ("limit", str(limit) if limit else None)]
    return F.concat(F.lit(f"{base}?url="), quoted, F.lit("&output=json" + "".join(f"&{k}={v}" for k, v in rest if v)))


def site_queries(domains: DataFrame, terms: list[str]) -> DataFrame:
    """(domain, query) of each domain and term."""
    return domains.select("domain", F.explode(F.array(*[F.lit(t) for t in terms])).alias("term")).select("domain", F.concat(F.lit("site:"), "domain", F.lit(" "), "term").alias("query"))


def scored(frame: DataFrame, method: str, confidence: float) -> DataFrame:
    """Found URLs (url) with the method that found them, each once."""
    return frame.select("url").distinct().select("url", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
