"""Analysis and OCR results: probes, combined texts, reuse, upserts; result rows of entity searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import upsert


def has_result(results: DataFrame, ids: DataFrame, kind: str, pages: bool = False) -> DataFrame:
    """``ids`` (document_id, or page_id with ``pages``) with ``found``: a complete result of ``kind``; that of a document is no page's."""
    key = "page_id" if pages else "document_id"
    done = results.filter((F.col("analysis_type") == kind) & (F.col("status") == "complete"))
    done = done.filter(F.col("page_id").isNotNull() if pages else F.col("page_id").isNull())
    return ids.join(done.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def combined_text(results: DataFrame, kind: str) -> DataFrame:
    """(document_id, text): complete page results in page order, two line feeds between them; the document's own result where pages have none."""
    done = results.filter((F.col("analysis_type") == kind) & (F.col("status") == "complete") & F.col("result_text").isNotNull())
    of_pages = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "result_text")))), lambda p: p["result_text"]), "\n\n")
    whole = F.min(F.when(F.col("page_id").isNull(), F.col("result_text")))
    both = done.groupBy("document_id").agg(of_pages.alias("pages"), whole.alias("whole"))
    return both.select("document_id", F.when(F.col("pages") != "", F.col("pages")).otherwise(F.col("whole")).alias("text")).filter("text IS NOT NULL")


def reused(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (image_hash, backend) with the text that the backend gave for an identical image: the least page's; null if there is none."""
    known = results.filter("text IS NOT NULL").groupBy("image_hash", "backend").agg(F.min_by("text", "page_id").alias("text"))
    return wanted.join(known, ["image_hash", "backend"], "left")


def store(results: DataFrame, rows: DataFrame) -> DataFrame:
    """OCR rows (page_id, backend, model, text) over the stored ones, with character and word counts; an absent model is the empty one."""
    spelled = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    counted = rows.withColumn("model", F.coalesce("model", F.lit(""))).withColumn("chars", F.char_length("text")).withColumn("words", F.when(F.col("text").isNotNull(), F.size(spelled)))
    return upsert(results, counted, ["page_id", "backend", "model"])


def entity_results(ids: DataFrame, docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Result rows of an entity search, for ``ids`` (document_id): title and source of the document, its id and nothing if it is gone, and all its entities."""
    known = docs.select(F.col("id").alias("document_id"), "title", "source_id")
    fields = F.struct("entity_type", "entity_text", "latitude", "longitude")
    held = entities.groupBy("document_id").agg(F.array_sort(F.collect_list(fields)).alias("matched"))
    rows = ids.join(known, "document_id", "left").join(held, "document_id", "left")
    none = F.array().cast(held.schema["matched"].dataType)
    return rows.select("document_id", F.coalesce("title", "document_id").alias("title"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("matched", none).alias("matched"))


def page_window(pages: DataFrame, document: str, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Pages of a document in page order: offset 100,000 at most, 5 pages, 1 to 20 if asked for."""
    size = min(max(5 if limit is None else limit, 1), 20)
    return pages.filter(F.col("document_id") == document).orderBy("page_number").offset(min(offset or 0, 100_000)).limit(size)
