"""MIME types: guesses from names, categories, groups and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to type.
BY_EXTENSION = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
    "html": "text/html",
    "htm": "text/html",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "bmp": "image/bmp",
    "msg": "application/vnd.ms-outlook",
    "eml": "message/rfc822",
    "zip": "application/zip",
}
# Membership lists.
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
FILE_EXTENSIONS = DOCUMENT_EXTENSIONS + ("jpg", "jpeg", "png", "gif", "tif", "tiff", "bmp", "zip")
EXTRACTABLE = ("application/pdf", "image/png", "image/jpeg", "image/tiff", "image/gif", "image/bmp", "text/plain", "text/html")
MARKUP = ("text/html", "application/xhtml+xml", "text/xml", "application/xml")
ARCHIVES = (
    "application/zip", "application/x-zip", "application/x-zip-compressed", "application/x-tar", "application/gzip",
    "application/x-rar-compressed", "application/x-7z-compressed",
)
CATEGORIES = ("documents", "markup", "images", "data", "archives", "other")
UNKNOWN = "application/octet-stream"


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; the whole name if it has none."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def from_filename(name: Column) -> Column:
    return lookup(extension(name), BY_EXTENSION, UNKNOWN)


def strip_url(url: Column) -> Column:
    """The URL without query and fragment."""
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def from_url(url: Column) -> Column:
    return from_filename(strip_url(url))


def has_document_extension(url: Column) -> Column:
    return extension(strip_url(url)).isin(*DOCUMENT_EXTENSIONS)


def has_file_extension(url: Column) -> Column:
    return extension(strip_url(url)).isin(*FILE_EXTENSIONS)


def category(mime: Column) -> Column:
    """One of CATEGORIES; the order of the tests is part of the meaning."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    document = (m == "application/pdf") | m.contains("word") | m.contains("rfc822") | m.startswith("message/") | (m.startswith("text/") & (m != "text/csv"))
    data = m.contains("spreadsheet") | m.contains("excel") | m.isin("text/csv", "application/json")
    return (
        F.when(m.isin(*MARKUP), "markup").when(document, "documents").when(m.startswith("image/"), "images")
        .when(data, "data").when(m.isin(*ARCHIVES), "archives").otherwise("other")
    )


def category_from_id(name: Column) -> Column:
    """Category of a name or alias, null if unknown."""
    n = F.lower(name)
    return F.when(n.isin(*CATEGORIES), n).when(n.isin("pdf", "text", "email"), "documents").when(n.isin("html", "xml"), "markup")


def in_group(mime: Column, group: str) -> Column:
    """Predicate of a browse group: a category, or pdf, text, email, html, xml."""
    m, g = mime, group.lower()
    text = m.startswith("text/") & ~m.isin("text/html", "text/xml", "text/csv")
    email = m.contains("rfc822") | m.startswith("message/")
    if g == "pdf":
        return m == "application/pdf"
    if g == "text":
        return text
    if g == "email":
        return email
    if g == "documents":
        return (m == "application/pdf") | m.contains("word") | email | text
    if g in ("markup", "html", "xml"):
        return m.isin(*MARKUP)
    if g in ("images", "data", "archives"):
        return category(m) == g
    if g == "other":
        return ~(category(m).isin("markup", "documents", "images", "data", "archives") | m.startswith("text/"))
    raise ValueError(f"unknown group {group!r}")


def icon(mime: Column) -> Column:
    return (
        F.when(mime == "application/pdf", "[pdf]").when(mime.startswith("image/"), "[img]").when(mime.contains("word"), "[doc]")
        .when(mime.contains("excel") | mime.contains("spreadsheet"), "[xls]").when(mime == "text/html", "[htm]").when(mime == "text/plain", "[txt]")
        .when(mime == "message/rfc822", "[eml]").when(mime.isin("application/zip", "application/x-zip", "application/x-zip-compressed"), "[zip]")
        .otherwise("[---]")
    )


def matches(pattern: Column, mime: Column) -> Column:
    """``*``, ``*/*``, ``type/*`` or the exact type."""
    return F.when(pattern.isin("*", "*/*"), True).when(F.endswith(pattern, F.lit("/*")), F.startswith(mime, F.substring_index(pattern, "*", 1))).otherwise(pattern == mime)


def format_size(size: Column) -> Column:
    """Decimal units with one decimal; plain bytes below 1000."""
    unit = lambda n, name: F.format_string(f"%.1f {name}", size / F.lit(float(n)))
    return (
        F.when(size >= 10**9, unit(10**9, "GB")).when(size >= 10**6, unit(10**6, "MB")).when(size >= 10**3, unit(10**3, "KB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


# Types that count as documents, and suffixes of document types.
DOCUMENT_TYPES = (
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation", "text/html", "application/xhtml+xml",
)
BY_SUFFIX = {
    "pdf": "pdf", "doc": "word", "docx": "word", "xls": "excel", "xlsx": "excel", "ppt": "powerpoint", "pptx": "powerpoint", "txt": "text",
    "html": "html", "htm": "html", "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "tiff": "image", "tif": "image",
}


def is_document(mime: Column) -> Column:
    return mime.isin(*DOCUMENT_TYPES)


def is_extractable(mime: Column) -> Column:
    return mime.isin(*EXTRACTABLE)


def document_kind(path: Column) -> Column:
    """Kind of document that the suffix of a path tells, null if none."""
    return F.when(F.contains(path, F.lit(".")), lookup(extension(path), BY_SUFFIX, None))
