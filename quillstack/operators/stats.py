"""Counts and statistics over documents, pages, requests and crawl state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime


def latest(versions: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (all without any) of the newest version of each document, by one aggregation and no window."""
    fields = columns or [c for c in versions.columns if c != "document_id"]
    return versions.groupBy("document_id").agg(F.max_by(F.struct(*fields), F.col("id")).alias("v")).select("document_id", "v.*")


def by(frame: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias(name))


def nested(frame: DataFrame, outer: str, inner: str) -> DataFrame:
    """A map of counts by ``inner`` for each ``outer``."""
    return by(frame, outer, inner).groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "n")))).alias("counts"))


def types(versions: DataFrame) -> DataFrame:
    kind = F.coalesce("mime_type", F.lit("unknown")).alias("mime_type")
    return latest(versions, "mime_type").groupBy(kind).agg(F.count("*").alias("n"))


def categories(versions: DataFrame) -> DataFrame:
    """Documents by category of their newest version; empty categories are hidden."""
    return types(versions).groupBy(mime.category(F.col("mime_type")).alias("category")).agg(F.sum("n").alias("n"))


def export(docs: DataFrame) -> DataFrame:
    """Total and counts by type, source and status in one pass: (dimension, value, n)."""
    sets = docs.groupingSets([[F.col("mime_type")], [F.col("source_id")], [F.col("status")], []], "mime_type", "source_id", "status")
    out = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "source").when(F.col("g") == 6, "status").otherwise("total")
    return out.select(name.alias("dimension"), F.coalesce("mime_type", "source_id", "status", F.lit("")).alias("value"), "n")


def annotations(docs: DataFrame) -> DataFrame:
    """Total, annotated and waiting documents per source."""
    done, waiting = F.col("status") == "indexed", F.col("status") == "ocr_complete"
    return docs.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(done).alias("annotated"), F.count_if(waiting).alias("needing"))


def timeline(docs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Documents per day, manual date before estimated, with the day's epoch second."""
    day = F.coalesce("manual_date", "estimated_date")
    dated = docs.select(day.alias("day")).filter("day IS NOT NULL")
    if start:
        dated = dated.filter(F.col("day") >= F.lit(start).cast("date"))
    if end:
        dated = dated.filter(F.col("day") <= F.lit(end).cast("date"))
    return dated.groupBy("day").agg(F.count("*").alias("n")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.unix_date("day").cast("long").alias("days"), "n").withColumn("epoch", F.col("days") * 86400).drop("days")


def crawl_state(urls: DataFrame) -> DataFrame:
    is_in = lambda *s: F.count_if(F.col("status").isin(*s))
    out = urls.groupBy("source_id").agg(F.count("*").alias("discovered"), is_in("fetched").alias("fetched"), is_in("discovered", "fetching").alias("pending"), is_in("failed", "exhausted").alias("failed"))
    return out.withColumn("needs_resume", F.col("pending") > 0).withColumn("complete", (F.col("pending") == 0) & (F.col("discovered") > 0))


def requests(log: DataFrame) -> DataFrame:
    """Outcome counts, mean duration cut to whole milliseconds, and bytes, per source."""
    code = F.col("response_status")
    return log.groupBy("source_id").agg(
        F.count_if(code == 200).alias("ok"), F.count_if(code == 304).alias("not_modified"), F.count_if(F.col("error").isNotNull() | (code >= 400)).alias("errors"),
        F.coalesce(F.avg("duration_ms").cast("long"), F.lit(0)).alias("mean_ms"), F.coalesce(F.sum("response_size"), F.lit(0)).alias("bytes"), F.count("*").alias("total"),
    )


def sources(documents: DataFrame, urls: DataFrame) -> DataFrame:
    """Known sources with document and URL counts, 0 where there are none."""
    docs, crawled = by(documents, "source_id", name="documents"), by(urls, "source_id", name="urls")
    none = F.lit(0).cast("long")
    return docs.join(crawled, "source_id", "full_outer").select("source_id", F.coalesce("documents", none).alias("documents"), F.coalesce("urls", none).alias("urls"))


def page_progress(pages: DataFrame) -> DataFrame:
    """Pages, pages that need OCR, and whether none does, per document."""
    needing = F.count_if(F.col("ocr_status").isin("pending", "text_extracted"))
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"), needing.alias("needing"), (needing == 0).alias("complete"))


def page_text(pages: DataFrame, best: Column, separator: str = "\n\n") -> DataFrame:
    """Non-null page texts of each document in page order; null if all are empty."""
    kept = pages.select("document_id", "page_number", best.alias("text")).filter("text IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), separator)
    return kept.groupBy("document_id").agg(F.nullif(joined, F.lit("")).alias("text"))


def timeline_envelope(buckets: DataFrame) -> DataFrame:
    """One row: the total and the buckets (day, n, epoch) by day."""
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("day", "n", "epoch"))).alias("buckets"))


def system(docs: DataFrame, versions: DataFrame, urls: DataFrame, source: str | None = None) -> DataFrame:
    """(section, key, n): documents by status, crawl URLs by status, types of newest versions; the types stay those of all sources."""
    own = lambda f: f if source is None else f.filter(F.col("source_id") == source)
    part = lambda section, f, key: f.select(F.lit(section).alias("section"), F.col(key).alias("key"), "n")
    parts = part("documents", by(own(docs), "status"), "status").unionByName(part("crawl", by(own(urls), "status"), "status"))
    return parts.unionByName(part("types", types(versions), "mime_type"))


def scrapers(sources: DataFrame, docs: DataFrame, urls: DataFrame) -> DataFrame:
    """Configured ``sources`` (source_id) with document counts and crawl state, 0 where there is none."""
    none = F.lit(0).cast("long")
    state = crawl_state(urls).select("source_id", "fetched", "pending", "failed")
    joined = sources.join(by(docs, "source_id", name="documents"), "source_id", "left").join(state, "source_id", "left")
    return joined.select("source_id", *[F.coalesce(c, none).alias(c) for c in ("documents", "fetched", "pending", "failed")])


def remap(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """(old, new, n): categories that a document has and that its newest version's type has, where they differ."""
    now = latest(versions, "mime_type").select(F.col("document_id").alias("id"), mime.category(F.col("mime_type")).alias("new"))
    both = docs.select("id", F.col("category_id").alias("old")).join(now, "id")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).groupBy("old", "new").agg(F.count("*").alias("n"))
