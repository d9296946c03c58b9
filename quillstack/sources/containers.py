"""Containers: members of ZIP files, parts of e-mails, types by content."""

from __future__ import annotations

import email
import email.headerregistry
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mime import BY_EXTENSION, EXTRACTABLE, UNKNOWN

# First bytes of file types.
MAGIC = (
    (b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"),
    (b"II*\x00", "image/tiff"), (b"MM\x00*", "image/tiff"), (b"BM", "image/bmp"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"),
)


def type_of_name(name: str) -> str:
    return BY_EXTENSION.get(name.rsplit(".", 1)[-1].lower(), UNKNOWN)


def members(content: bytes, extract: bool = False) -> Iterator[dict]:
    """Files of a ZIP: no folders, hidden or resource-fork entries; bytes only of extractable types."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i in z.infolist():
            name = i.filename.rsplit("/", 1)[-1]
            if i.is_dir() or "__MACOSX" in i.filename or name.startswith("."):
                continue
            kind = type_of_name(name)
            yield {"archive_path": i.filename, "filename": name, "mime_type": kind, "file_size": i.file_size, "content": z.read(i) if extract and kind in EXTRACTABLE else None}


class _Registry(email.headerregistry.HeaderRegistry):
    """The standard header types, each made once; the standard registry makes a new type for every header that is looked at."""

    def __init__(self):
        super().__init__()
        self.made: dict[type, type] = {}

    def __getitem__(self, name: str) -> type:
        kind = self.registry.get(name.lower(), self.default_class)
        if kind not in self.made:
            self.made[kind] = super().__getitem__(name)
        return self.made[kind]


_REGISTRY = _Registry()
#: Longer header values are parsed at every look, which bounds what ``_header`` keeps.
_SHORT = 512


@lru_cache(maxsize=4096)
def _header(name: str, value: str):
    return _PLAIN.header_fetch_parse(name, value)


class _Policy(email.policy.EmailPolicy):
    """The default policy.  Header objects do not change, so one serves all looks at equal headers, of any message."""

    def header_fetch_parse(self, name: str, value: str):
        return _header(name, value) if type(value) is str and len(value) <= _SHORT else super().header_fetch_parse(name, value)


_PLAIN = email.policy.default.clone(header_factory=_REGISTRY)
_POLICY = _Policy(header_factory=_REGISTRY)


def parsed(content: bytes) -> email.message.EmailMessage:
    return email.message_from_bytes(content, policy=_POLICY)


def body_of(m: email.message.EmailMessage) -> str:
    """Plain text of an e-mail; HTML is stripped where no plain text is."""
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = re.sub(r"\s+", " ", re.sub(r"(?s)<(script|style).*?</\1>|<[^>]+>", " ", text)).strip()
    return text


def message(content: bytes) -> dict:
    """Headers, text and named attachments of an e-mail; HTML is stripped where no plain text is."""
    m = parsed(content)
    text = body_of(m)
    files = [name for a in m.iter_attachments() if (name := a.get_filename())]
    header = {k: str(v) if (v := m[k]) else None for k in ("subject", "from", "to", "date")}
    lines = [f"{k.capitalize()}: {v}" for k, v in header.items() if v] + ["", text] + ([f"Attachments: {', '.join(files)}"] if files else [])
    return {**header, "body": text, "attachments": files, "text": "\n".join(lines)}


def attached(m: email.message.EmailMessage) -> Iterator[dict]:
    """Named attachments of an e-mail."""
    for a in m.iter_attachments():
        if name := a.get_filename():
            data = a.get_payload(decode=True) or b""
            kind = a.get_content_type()
            yield {"filename": name, "mime_type": type_of_name(name) if kind == UNKNOWN else kind, "file_size": len(data), "content": data}


def inside_mail(content: bytes) -> Iterator[dict]:
    """Named attachments and the body of an e-mail, parsed once; either is left out where it is broken."""
    m = parsed(content)
    for part in (attached, lambda m: [{"filename": "body.txt", "mime_type": "text/plain", "file_size": len(body_of(m).encode())}]):
        try:
            yield from [{k: v for k, v in r.items() if k != "content"} for r in part(m)]
        except Exception:  # the other part stays
            continue


def sniff(content: bytes) -> str | None:
    head = content[:8192]
    return next((kind for magic, kind in MAGIC if head.startswith(magic)), None)


def corrected(declared: str, content: bytes) -> str:
    """The sniffed type for unknown content, or where the main type differs; else the declared one."""
    found = sniff(content)
    if found and (declared == UNKNOWN or declared.split("/")[0] != found.split("/")[0]):
        return found
    return declared


#: Rows and bytes of contents after which results go out.
_ROWS = 10_000
_BYTES = 1 << 24


def _per_file(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def frame(held: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r.get(n) for r in held], dtype="Int64" if n == "file_size" else object) for n in names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for key, content in zip(b["document_id"], b["content"]):
                try:
                    out = [{"document_id": key, "error": None, **r} for r in rows(bytes(content))]
                except Exception as e:  # a broken file is a row with its error
                    out = [{"document_id": key, "error": f"{type(e).__name__}: {e}"[:200]}]
                held += out
                size += len(content or b"") + sum(len(r.get("content") or b"") for r in out)
                if len(held) >= _ROWS or size >= _BYTES:
                    if held:
                        yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    return files.select("document_id", "content").mapInPandas(run, schema)


def zip_files(files: DataFrame, extract: bool = False) -> DataFrame:
    """Members of (document_id, content) ZIP files."""
    return _per_file(files, "document_id string, error string, archive_path string, filename string, mime_type string, file_size long, content binary", lambda c: members(c, extract))


def emails(files: DataFrame) -> DataFrame:
    """Headers and text of (document_id, content) e-mails."""
    return _per_file(files, "document_id string, error string, subject string, from string, to string, date string, body string, attachments array<string>, text string", lambda c: [message(c)])


def types(files: DataFrame) -> DataFrame:
    """(document_id, mime_type) corrected by content, of (document_id, mime_type, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"document_id": b["document_id"], "mime_type": [corrected(m, bytes(c)) for m, c in zip(b["mime_type"], b["content"])]})

    return files.select("document_id", "mime_type", "content").mapInPandas(run, "document_id string, mime_type string")


def attachments(files: DataFrame) -> DataFrame:
    """Named attachments of (document_id, content) e-mails: filename, type by name where the part's is unknown, size and bytes."""
    return _per_file(files, "document_id string, error string, filename string, mime_type string, file_size long, content binary", lambda c: attached(parsed(c)))


def virtual_files(files: DataFrame) -> DataFrame:
    """Files inside (document_id, mime_type, content) containers as virtual documents: members of archives, attachments and bodies of e-mails."""
    archives, mails = files.filter("mime_type = 'application/zip'"), files.filter("mime_type = 'message/rfc822'")
    columns = ["document_id", "filename", "mime_type", "file_size"]
    inside = _per_file(mails, "document_id string, error string, filename string, mime_type string, file_size long", inside_mail)
    return zip_files(archives).filter("error IS NULL").select(*columns).unionByName(inside.filter("error IS NULL").select(*columns))
