"""File names, storage paths, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mime

# Extension of a type where a URL has none, and where a file name has none.
URL_EXTENSION = {
    "application/pdf": "pdf", "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/html": "html", "text/plain": "txt", "image/jpeg": "jpg", "image/png": "png",
}
TYPE_EXTENSION = URL_EXTENSION | {
    "application/vnd.ms-excel": "xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-powerpoint": "ppt", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "image/gif": "gif", "image/tiff": "tiff", "message/rfc822": "eml",
}
_NAME = r"^(.+)\.([A-Za-z0-9]{1,5})$"


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def sanitize(name: Column) -> Column:
    """Reserved and control characters as ``_``, ends trimmed, 100 characters at most, ``document`` if nothing is left."""
    clean = F.regexp_replace(name, '[/\\\\:*?"<>|\\x00-\\x1f\\x7f]', "_")
    trimmed = F.substring(F.btrim(F.btrim(clean), F.lit("_")), 1, 100)
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("document"))


def url_parts(url: Column, title: Column, kind: Column) -> tuple[Column, Column]:
    """Base name and extension of a URL's last segment, else title and the type's extension."""
    last = F.element_at(F.split(url, "/"), -1)
    real = last.rlike(_NAME)
    base = F.when(real, F.regexp_extract(last, _NAME, 1)).otherwise(F.coalesce(F.nullif(title, F.lit("")), F.lit("document")))
    return base, F.when(real, F.lower(F.regexp_extract(last, _NAME, 2))).otherwise(mime.lookup(kind, URL_EXTENSION, "bin"))


def storage_path(digest: Column, kind: Column, filename: Column, dedup: Column, url: Column, title: Column) -> Column:
    """``<digest prefix>/<name>-<8 digits of the digest>.<extension>``; the prefix grows with the dedup index."""
    base, ext = url_parts(url, title, kind)
    real, bare = filename.rlike(_NAME), F.instr(filename, ".") == 0
    name = F.when(real, F.regexp_extract(filename, _NAME, 1)).when(bare, filename).otherwise(base)
    end = F.when(real, F.lower(F.regexp_extract(filename, _NAME, 2))).when(bare, mime.lookup(kind, TYPE_EXTENSION, "bin")).otherwise(ext)
    prefix = F.substring(digest, F.lit(1), F.lit(2) + F.coalesce(dedup, F.lit(0)))
    return F.concat(prefix, F.lit("/"), sanitize(name), F.lit("-"), F.substring(digest, 1, 8), F.lit("."), end)


def percent(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def file_url(path: Column, filename: Column) -> Column:
    return F.concat(F.lit("/files/"), path, F.when(filename.isNotNull(), F.concat(F.lit("?filename="), percent(filename))).otherwise(""))


def resolved(folder: str, stored: Column, computed: Column) -> Column:
    """Full path of a stored file: of an absolute path the last two parts, a relative one as it is, else the computed one, below ``folder``."""
    parts = F.filter(F.split(stored, "/"), lambda x: x != "")
    last = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/")
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.when(F.startswith(stored, F.lit("/")), last).otherwise(F.coalesce(stored, computed)))


# Extension of a type in a content path.
CONTENT_EXTENSION = {
    "application/pdf": "pdf", "text/html": "html", "text/plain": "txt", "application/json": "json", "application/xml": "xml", "text/xml": "xml",
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/zip": "zip", "application/gzip": "gz",
}


def content_extension(kind: Column) -> Column:
    return mime.lookup(kind, CONTENT_EXTENSION, "bin")


def content_path(folder: str, digest: Column, extension: Column, name: Column | None = None) -> Column:
    """``folder/ab/name-abcdef12.ext``, without a name ``folder/ab/<digest>.ext``; a digest under 8 characters is an error."""
    good = F.when(F.length(digest) >= 8, digest).otherwise(F.raise_error(F.lit("content hash too short")).cast("string"))
    file = good if name is None else F.concat(sanitize(name), F.lit("-"), F.substring(good, 1, 8))
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.substring(good, 1, 2), F.lit("/"), file, F.lit("."), extension)


def identifier(name: Column) -> Column:
    """Whether a name is safe inside a JSON path: ASCII letters, digits and ``_`` only, one at least."""
    return name.rlike("^[A-Za-z0-9_]+$")
