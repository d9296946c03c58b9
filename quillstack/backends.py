"""Plug-in points: extractors, annotators and fetchers as plain callables over batches.

External steps (OCR, transcription, language models, HTTP) are not part of the
engine.  A backend is a function from a pandas batch to a pandas batch; the
engine runs it per partition, records its outcome per row and never lets one
bad row fail the job.  ``REGISTRY`` names backends for configuration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import entities, mime, urls


@dataclass(frozen=True)
class Backend:
    """``run(row dict) -> str | None`` for documents of the MIME patterns; ``version`` makes results comparable."""

    name: str
    kind: str
    run: Callable[[dict], str | None]
    patterns: tuple[str, ...] = ("*",)
    version: int = 1


REGISTRY: dict[str, Backend] = {}


def register(backend: Backend) -> Backend:
    REGISTRY[backend.name] = backend
    return backend


def supports(backend: Backend, mime_type: Column) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in backend.patterns]), lambda p: mime.matches(p, mime_type)), F.lit(False))


def apply(frame: DataFrame, backend: Backend, columns: list[str]) -> DataFrame:
    """(document_id, backend, version, status, result, error) of the rows that ``backend`` supports."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    result = backend.run(row)
                    out.append((row["document_id"], backend.name, backend.version, "no_result" if result is None else "complete", result, None))
                except Exception as e:  # recorded, not raised: the queue retries it
                    out.append((row["document_id"], backend.name, backend.version, "failed", None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["document_id", "backend", "version", "status", "result", "error"])

    fit = frame.filter(supports(backend, F.col("mime_type"))) if "mime_type" in frame.columns else frame
    return fit.select("document_id", *[c for c in columns if c != "document_id"]).mapInPandas(run, "document_id string, backend string, version int, status string, result string, error string")


def fallback(results: DataFrame, order: list[str]) -> DataFrame:
    """First successful result per document, by the order of backends."""
    rank = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("backend"))
    good = results.filter((F.col("status") == "complete") & (rank > 0)).withColumn("rank", rank)
    return good.groupBy("document_id").agg(F.min_by(F.struct("backend", "result"), F.col("rank")).alias("r")).select("document_id", "r.*")


def best_page(pdf: Column, ocr: Column) -> Column:
    """OCR text if it has over a fifth more characters that are not blank, else the PDF's."""
    size = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    return F.when(size(ocr) > size(pdf) + F.floor(size(pdf) / 5), ocr).otherwise(pdf)


def _common(a: str, b: str, at_end: bool = False) -> int:
    """Characters that both begin, or end, with; by bisection."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        same = a.endswith(b[len(b) - mid :]) if at_end else a.startswith(b[:mid])
        lo, hi = (mid, hi) if same else (lo, mid - 1)
    return lo


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, a column of the table at a time in the bits of a number (Myers, Hyyrö)."""
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a, b, True)
    a, b = a[: len(a) - n], b[: len(b) - n]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, bytearray] = {}
    wanted = set(b)
    for i, c in enumerate(a):
        if c in wanted:
            places.setdefault(c, bytearray(len(a) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    at = {c: int.from_bytes(bits, "little") for c, bits in places.items()}
    mask, last, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = mask, 0  # where a column's value is one more, or one less, than the one above it
    for c in b:
        eq = at.get(c, 0)
        diagonal = eq | down
        level = ((((eq & up) + up) ^ up) | eq) & mask
        more, less = down | ((level | up) ^ mask), up & level
        score += (more >> last) - (less >> last)
        more, less = (more << 1 | 1) & mask, (less << 1) & mask
        up, down = less | ((diagonal | more) ^ mask), more & diagonal
    return score


#: Pairs of at most so many characters times characters take the built-in distance, whose time grows with that product.
_SMALL = 4096


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; only long texts of which neither begins or ends the other go through Python."""

    @F.pandas_udf("int")
    def hard_ones(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else edit_distance(p, q) for p, q in zip(x, y)], dtype="Int32")

    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    inside = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)
    small = longer.cast("long") * shorter <= _SMALL
    hard = ~inside & ~small
    return F.when(inside, longer - shorter).when(small, F.levenshtein(a, b)).otherwise(hard_ones(F.when(hard, a), F.when(hard, b)))


def compare(results: DataFrame) -> DataFrame:
    """Backends' texts of a page side by side: characters, words and edit distance to the first by name; of several texts of that name, to the least."""
    size = F.length("text")
    first = F.min(F.when(F.col("backend").isNotNull(), F.struct("backend", "text"))).over(Window.partitionBy("page_id"))
    based = results.filter("page_id IS NOT NULL").withColumn("base", first["text"])
    return based.select("page_id", "backend", size.alias("chars"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"), distance(F.col("text"), F.col("base")).alias("distance"))


def annotate_entities(docs: DataFrame) -> DataFrame:
    """(document_id, entities) by the built-in dictionaries and patterns."""
    return docs.select(F.col("id").alias("document_id"), entities.entities(F.col("extracted_text")).alias("entities"))


def annotate_urls(docs: DataFrame) -> DataFrame:
    """(document_id, urls, n) of document links in the texts."""
    found = F.filter(urls.found(F.col("extracted_text")), lambda u: mime.has_document_extension(u))
    return docs.select(F.col("id").alias("document_id"), found.alias("urls")).withColumn("n", F.size("urls"))


def extractive_summary(row: dict) -> str | None:
    """Stand-in for a language model: the first sentence."""
    text = (row.get("extracted_text") or "").strip()
    return text.split(". ")[0][:200] or None


register(Backend("first_sentence", "summary", extractive_summary))


def chosen(frame: DataFrame, backends: list[Backend], kind: str) -> DataFrame:
    """``frame`` (mime_type) with ``backend``: the first of ``kind`` that supports the type, null if none does."""
    out = F.lit(None).cast("string")
    for b in reversed([b for b in backends if b.kind == kind]):
        out = F.when(supports(b, F.col("mime_type")), b.name).otherwise(out)
    return frame.withColumn("backend", out)


def pdf_pages(texts: DataFrame) -> DataFrame:
    """(document_id, page_number, text) of extracted PDF texts (document_id, text): form feeds end pages, blank ones are pages too."""
    parts = texts.select("document_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("pos", "text"))
    return parts.select("document_id", (F.col("pos") + 1).alias("page_number"), "text")


def recorded(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """``apply``'s outcomes over the stored ones by document and backend; skipped documents have none."""
    from .operators.work import upsert

    return upsert(results, outcomes, ["document_id", "backend"])


def term_list(backend: Backend, sites: DataFrame) -> DataFrame:
    """(document_id, terms) of a term backend, whose answer is a comma list, with the seeds in column ``seeds`` first."""
    from .functions import discovery

    answers = apply(sites, backend, ["domain", "seeds"]).select("document_id", F.split("result", ",").alias("found"))
    joined = sites.select("document_id", "seeds").join(answers, "document_id", "left")
    return joined.select("document_id", discovery.union_terms(F.col("seeds"), F.transform("found", lambda t: F.btrim(t))).alias("terms"))
