"""Model views: the engine's tables, derived from the driver's tables.

Columns that the driver's tables lack are derived from a digest of the id, so
they are the same in every run and in SQL.  ``ANCHOR`` stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime
from ..session import read

#: 2024-06-01 00:00:00 UTC, in place of the current time.
ANCHOR = 1717200000
START = 1704067200
STATUSES = ("pending", "downloaded", "ocr_complete", "indexed", "failed")
MIMES = ("application/pdf", "text/html", "text/plain", "application/vnd.ms-excel", "application/zip", "message/rfc822")
EXTENSIONS = ("pdf", "html", "txt", "xls", "zip", "eml")
URL_STATUSES = ("discovered", "fetching", "fetched", "failed", "exhausted", "skipped")
PAGE_STATUSES = ("pending", "text_extracted", "ocr_complete", "failed", "skipped")


def bucket(key: Column, salt: str, k: int) -> Column:
    """A number below ``k`` from the first digit of a digest."""
    return (F.ascii(F.substring(F.sha2(F.concat(key, F.lit(salt)), 256), 1, 1)) % k).cast("int")


def pick(values: tuple[str, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), place + 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, title, source_url, extracted_text, status, synopsis, tags, manual_date, estimated_date, mime_type, category_id, created, updated."""
    key = F.col("doc_id").cast("string")
    b = lambda salt, k: bucket(key, salt, k)
    kind = pick(MIMES, b("m", 6))
    title = F.get(F.split("text", "\n", 2), F.lit(0))
    day = F.pmod(F.col("doc_id"), F.lit(365)).cast("int")
    created = F.lit(START) + F.col("doc_id") * 60
    return read(spark, sf_dir, "documents").select(
        key.alias("id"), F.col("doc_id"), F.col("source").alias("source_id"), title.alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/files/"), key, F.lit("."), pick(EXTENSIONS, b("m", 6))).alias("source_url"),
        F.col("text").alias("extracted_text"), F.col("lang"), pick(STATUSES, b("s", 5)).alias("status"),
        F.when(b("y", 2) == 1, F.substring(title, 1, 60)).alias("synopsis"),
        F.when(b("t", 4) == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("lang"), F.concat(F.lit("topic"), b("t", 4).cast("string")))).alias("tags"),
        F.when(b("d", 4) == 0, F.date_add(F.lit("2023-01-01").cast("date"), day)).alias("manual_date"),
        F.when(b("e", 3) != 0, F.date_add(F.lit("2022-01-01").cast("date"), day)).alias("estimated_date"),
        kind.alias("mime_type"), mime.category(kind).alias("category_id"),
        created.alias("created"), (created + b("u", 16) * 3600).alias("updated"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three versions of each document, newest last: id, document_id, content_hash, file_size, mime_type, acquired, original_filename, legacy_path."""
    docs = documents(spark, sf_dir).withColumn("last", bucket(F.col("id"), "v", 3))
    each = docs.withColumn("n", F.explode(F.sequence(F.lit(0), "last")))
    text = F.when(F.col("n") == F.col("last"), F.col("extracted_text")).otherwise(F.concat("extracted_text", F.lit("#"), F.col("n").cast("string")))
    return each.select(
        (F.col("doc_id") * 10 + F.col("n")).alias("id"), F.col("id").alias("document_id"), F.sha2(text, 256).alias("content_hash"),
        F.octet_length(text).cast("long").alias("file_size"), "mime_type", (F.col("created") + F.col("n") * 7200).alias("acquired"),
        F.concat(F.lit("report_"), F.regexp_replace(F.col("estimated_date").cast("string"), "-", ""), F.lit("."), mime.extension(F.col("source_url"))).alias("original_filename"),
        F.when(bucket(F.col("id"), "f", 4) == 0, F.concat(F.lit("/old/"), F.col("id"))).alias("legacy_path"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per line: document_id, page_number, pdf_text, ocr_text, final_text, ocr_status."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.select(
        F.col("doc_id").cast("string").alias("document_id"), (F.col("pos") + 1).cast("long").alias("page_number"), F.col("line").alias("pdf_text"),
        F.when(F.col("pos") % 3 != 0, F.concat(F.col("line"), F.lit(" "))).alias("ocr_text"), F.when(F.col("pos") % 7 == 0, F.col("line")).alias("final_text"),
        pick(PAGE_STATUSES, F.pmod(F.col("doc_id") + F.col("pos"), F.lit(5)).cast("int")).alias("ocr_status"),
    )


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and claims of two analysis types: document_id, version_id, analysis_type, status, created."""
    latest = versions(spark, sf_dir).groupBy("document_id").agg(F.max("id").alias("version_id"))
    each = latest.withColumn("analysis_type", F.explode(F.array(F.lit("ocr"), F.lit("ner")))).withColumn("k", bucket(F.concat("document_id", "analysis_type"), "a", 8))
    status = F.when(F.col("k") <= 2, "complete").when(F.col("k") <= 4, "failed").otherwise("pending")
    hours = bucket(F.concat(F.col("document_id"), F.col("analysis_type")), "h", 16) * 2
    return each.filter("k < 6").select("document_id", "version_id", "analysis_type", status.alias("status"), (F.lit(ANCHOR) - hours * 3600).cast("long").alias("created"))


def crawl_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, source_id, status, depth, discovered, fetched, retry_count, next_retry."""
    key = F.col("page_id").cast("string")
    status = bucket(key, "s", 6)
    return read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.regexp_extract("url", r"([a-z-]+\.example\.[a-z]+)", 1).alias("source_id"), pick(URL_STATUSES, status).alias("status"),
        (F.size(F.split("url", "/")) - 3).cast("long").alias("depth"), (F.lit(START) + F.col("page_id") * 30).alias("discovered"),
        F.when(status == 2, F.lit(ANCHOR) - bucket(key, "f", 16) * 86400 - F.col("page_id")).cast("long").alias("fetched"),
        F.when(status.isin(3, 4), bucket(key, "r", 4) + 1).otherwise(0).alias("retry_count"),
        F.when(status == 3, F.lit(ANCHOR) + (bucket(key, "n", 16) - 8) * 600).cast("long").alias("next_retry"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages in document order: page_id, url, pos, link."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(found).alias("pos", "link"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: id, source_id, url, ts, response_status, duration_ms, response_size, error."""
    kind = F.col("event_type")
    code = pick(("200", "200", "304", "403", "503"), F.pmod(F.col("event_id"), F.lit(5)).cast("int")).cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("src"), F.pmod(F.col("user_id"), F.lit(8)).cast("string")).alias("source_id"),
        F.concat(F.lit("https://src"), F.pmod(F.col("user_id"), F.lit(8)).cast("string"), F.lit(".example.org/"), kind, F.lit("/"), F.pmod(F.col("event_id"), F.lit(50)).cast("string")).alias("url"),
        F.col("ts").alias("ts"), code.alias("response_status"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.pmod(F.col("event_id"), F.lit(4096)).alias("response_size"), F.when(F.pmod(F.col("event_id"), F.lit(50)) == 7, F.lit("timeout")).alias("error"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, entity_type, entity_text, normalized_text, latitude, longitude; from customers and their nations."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    kind = pick(("person", "organization", "location", "file_number"), F.pmod(F.col("c_custkey"), F.lit(4)).cast("int"))
    base = read(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey")  # 25 nations
    place = F.pmod(F.col("c_custkey"), F.lit(4)) == 2
    text = F.when(place, F.col("n_name")).otherwise(F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" "), F.pmod(F.col("c_custkey"), F.lit(23)).cast("string")))
    return base.select(
        F.pmod(F.col("c_custkey"), F.lit(97)).cast("string").alias("document_id"), kind.alias("entity_type"), text.alias("entity_text"), F.lower(text).alias("normalized_text"),
        F.when(place, F.col("c_nationkey") * 5.0 - 60.0).alias("latitude"), F.when(place, F.col("c_nationkey") * 13.0 - 150.0).alias("longitude"),
    ).dropDuplicates(["entity_type", "normalized_text", "document_id"])


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result per page: page_id, document_id, page_number, backend, text, image_hash."""
    return pages(spark, sf_dir).select(
        (F.col("document_id").cast("long") * 100_000 + F.col("page_number")).alias("page_id"), "document_id", "page_number",
        F.when(F.col("page_number") % 2 == 0, "second").otherwise("first").alias("backend"), F.col("ocr_text").alias("text"), F.sha2("pdf_text", 256).alias("image_hash"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text results of pages, and of whole documents (page_id null): document_id, page_id, analysis_type, result_text, status."""
    done = F.when(F.col("ocr_status").isin("ocr_complete", "text_extracted"), "complete").otherwise("failed")
    each = pages(spark, sf_dir).select("document_id", (F.col("document_id").cast("long") * 100_000 + F.col("page_number")).alias("page_id"), F.lit("ocr").alias("analysis_type"), F.col("ocr_text").alias("result_text"), done.alias("status"))
    whole = read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(None).cast("long").alias("page_id"), F.lit("ocr").alias("analysis_type"),
        F.concat(F.lit("whole "), F.col("doc_id").cast("string")).alias("result_text"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("complete").alias("status"),
    )
    return each.unionByName(whole)
