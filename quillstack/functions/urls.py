"""URL parts, titles, listing pages, link patterns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mime

# URL parts that mark a listing page, and domains left out of found URLs.
LISTING = (
    "/index", "/browse", "/list", "/search", "/documents/", "/reports/", "/publications/", "/library/", "/reading-room", "/foia/", "/archive",
    "page=", "?q=",
)
EXCLUDED = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "google.com", "bing.com", "yahoo.com",
    "amazon.com", "ebay.com", "wikipedia.org", "reddit.com",
)


def host(url: Column) -> Column:
    """Authority of an absolute URL, empty for anything else."""
    return F.regexp_extract(url, r"://([^/?#]+)", 1)


def path(url: Column) -> Column:
    """From the first slash after the authority, query included."""
    return F.regexp_extract(url, r"://[^/]*(/.*)$", 1)


def root_domain(name: Column) -> Column:
    """Last two labels of a host."""
    return F.array_join(F.slice(F.split(name, r"\."), F.greatest(F.lit(1), F.size(F.split(name, r"\.")) - 1), 2), ".")


def is_subdomain(name: Column, domains: list[str]) -> Column:
    """Host is one of ``domains`` or below one."""
    return reduce(or_, [(name == d) | name.endswith("." + d) for d in domains], F.lit(False))


def title(url: Column) -> Column:
    """Last path segment without a known extension, separators as blanks."""
    last = F.element_at(F.split(url, "/"), -1)
    known = F.instr(last, ".") > 0
    bare = F.when(known & (mime.from_filename(last) != mime.UNKNOWN), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)
    return F.translate(bare, "_-", "  ")


def is_listing(url: Column) -> Column:
    low = F.lower(url)
    return reduce(or_, [low.contains(part) for part in LISTING]) & ~mime.has_document_extension(url)


def listing_confidence(url: Column, title: Column, confidence: Column) -> Column:
    """Confidence raised for a listing URL, a page-like URL and a listing-like title; 1 at most."""
    low = F.lower(title)
    named = reduce(or_, [low.contains(w) for w in ("index", "list", "browse", "search results", "documents")])
    add = lambda x, when, by: F.least(F.lit(1.0), x + F.when(F.coalesce(when, F.lit(False)), by).otherwise(0.0))
    return add(add(add(confidence, is_listing(url), 0.1), ~mime.has_document_extension(url), 0.05), named, 0.15)


def found(text: Column) -> Column:
    """Distinct http(s) URLs of a text; trailing dots and commas, and closing brackets without an opening one, are cut."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(https?://[^\s<>\[\]{}|\\\\^`\x00-\x1f\x7f]+)"), F.lit(1))

    def step(url):
        bare = F.regexp_replace(url, r"[.,]+$", "")
        excess = F.regexp_count(bare, F.lit(r"\)")) - F.regexp_count(bare, F.lit(r"\("))
        tail = F.length(F.regexp_extract(bare, r"(\)*)$", 1))
        return F.substring(bare, F.lit(1), F.length(bare) - F.greatest(F.lit(0), F.least(excess, tail)))

    def cleaned(url):  # dots and brackets may alternate: each pass cuts one layer
        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), url, lambda u, _: step(u))

    return F.filter(F.array_distinct(F.transform(raw, cleaned)), lambda u: ~is_subdomain(F.lower(host(u)), list(EXCLUDED)))


def template(url: Column) -> Column:
    """Digit runs as ``{N}``."""
    return F.regexp_replace(url, "[0-9]+", "{N}")


def rewrite(url: Column, mapping: list[tuple[str, str]]) -> Column:
    """First mapping whose prefix fits replaces it."""
    out = url
    for prefix, to in reversed(mapping):
        out = F.when(url.startswith(prefix), F.concat(F.lit(to), F.substring(url, len(prefix) + 1, 1 << 30))).otherwise(out)
    return out


def links(html: Column) -> Column:
    """Targets of href attributes that lead to a page."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda x: ~x.rlike(r"^(#|javascript:|mailto:|tel:)") & (x != ""))


def resolve(base: Column, link: Column) -> Column:
    """Absolute, protocol-relative, root-relative or relative to the base's folder."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    origin = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_extract(mime.strip_url(base), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(?:/.*)?/)[^/]*$", 1)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), link))
    )


def parents(url: Column) -> Column:
    """Every ancestor directory, nearest first."""
    bare = F.rtrim(mime.strip_url(url), F.lit("/"))
    parts = F.split(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/?", ""), "/")
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    steps = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.concat(origin, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))


def redact(url: Column) -> Column:
    """Password of a connection URL as ``***``."""
    return F.regexp_replace(url, r"(://[^:/@]+):[^@/]*@", "$1:***@")


def domain(target: Column) -> Column:
    """Host of a URL; a bare target as it is."""
    return F.coalesce(F.nullif(host(target), F.lit("")), target)


def base(target: Column) -> Column:
    """Target with ``https://`` if it has no scheme, without a slash at the end."""
    return F.rtrim(F.when(target.rlike("^https?://"), target).otherwise(F.concat(F.lit("https://"), target)), F.lit("/"))


def allowed(url: Column, start: Column) -> Column:
    """The URL's site is that of ``start``."""
    return root_domain(host(url)) == root_domain(host(start))


def rewritten(url: Column, mapping: list[tuple[str, str]]) -> Column:
    """struct(url, rewritten) after the first mapping whose prefix fits."""
    fits = reduce(or_, [url.startswith(p) for p, _ in mapping], F.lit(False))
    return F.struct(rewrite(url, mapping).alias("url"), fits.alias("rewritten"))


def as_listing(confidence: Column) -> Column:
    """Confidence of a URL that is known as a listing page."""
    return F.least(F.lit(1.0), confidence + 0.2)


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def typed(found_urls: Column) -> Column:
    """(url, kind) of the URLs whose path tells a document."""
    each = F.transform(found_urls, lambda u: F.struct(u.alias("url"), mime.document_kind(mime.strip_url(u)).alias("kind")))
    return F.filter(each, lambda x: x["kind"].isNotNull())
