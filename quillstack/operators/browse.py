"""Browsing documents: filters, sorting, paging, lookup, navigation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mime
from .crawl import checkpointed

MOST_PER_PAGE = 200
MOST_PAGES = 100_000


@dataclass(frozen=True)
class BrowseParams:
    """Optional filters, all of which must hold, and the order of the result."""

    source: str | None = None
    status: str | None = None
    categories: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    query: str | None = None
    sort: str = "updated"
    descending: bool = True
    page: int = 1
    per_page: int = 50

    def predicate(self) -> Column:
        """A tag matches as part of the joined tags, the query as part of title or synopsis, both case-sensitive."""
        tests = [F.lit(True)]
        if self.source is not None:
            tests.append(F.col("source_id") == self.source)
        if self.status is not None:
            tests.append(F.col("status") == self.status)
        if self.categories:
            tests.append(F.col("category_id").isin(*self.categories))
        tests += [F.contains(F.array_join("tags", ","), F.lit(t)) for t in self.tags]
        if self.query:
            tests.append(F.contains("title", F.lit(self.query)) | F.coalesce(F.contains("synopsis", F.lit(self.query)), F.lit(False)))
        return reduce(and_, tests)


def paginate(page: int | None = None, per_page: int | None = None) -> tuple[int, int, int]:
    """Page, page size and offset within their bounds."""
    size = min(max(50 if per_page is None else per_page, 1), MOST_PER_PAGE)
    number = min(max(1 if page is None else page, 1), MOST_PAGES)
    return number, size, (number - 1) * size


def total_pages(total: int, per_page: int) -> int:
    return -(-total // per_page)


def filtered(docs: DataFrame, params: BrowseParams) -> DataFrame:
    return docs.filter(params.predicate())


def browse(docs: DataFrame, params: BrowseParams) -> DataFrame:
    """One page of the documents; ties fall by id."""
    _, size, offset = paginate(params.page, params.per_page)
    column = {"created": "created", "created_at": "created", "title": "title"}.get(params.sort, "updated")
    order = F.desc_nulls_last(column) if params.descending else F.asc_nulls_last(column)
    return filtered(docs, params).orderBy(order, "id").offset(offset).limit(size)


def count(docs: DataFrame, params: BrowseParams) -> DataFrame:
    return filtered(docs, params).agg(F.count("*").alias("total"))


def with_latest_version(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents that have a version, with the newest one's id, type and size."""
    newest = versions.groupBy(F.col("document_id").alias("id")).agg(F.max_by(F.struct(F.col("id").alias("version_id"), "file_size"), F.col("id")).alias("v"))
    return docs.join(newest, "id").select("*", "v.version_id", "v.file_size").drop("v")


def by_tag(docs: DataFrame, tag: str, source: str | None = None) -> DataFrame:
    found = docs.filter(F.array_contains("tags", tag))
    return found if source is None else found.filter(F.col("source_id") == source)


def by_category(docs: DataFrame, versions: DataFrame, group: str, limit: int) -> DataFrame:
    """Documents with any version of the group, newest update first."""
    ids = versions.filter(mime.in_group(F.col("mime_type"), group)).select(F.col("document_id").alias("id"))
    return docs.join(ids, "id", "left_semi").orderBy(F.desc("updated"), "id").limit(limit)


def search(docs: DataFrame, text: str) -> DataFrame:
    """Lower-case substring of title, synopsis, a tag or the text."""
    low = F.lit(text.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    return docs.filter(has(F.col("title")) | has(F.col("synopsis")) | F.exists("tags", lambda t: F.contains(F.lower(t), low)) | has(F.col("extracted_text")))


def search_pages(pages: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Pages whose best text holds ``text``, with the document's title."""
    best = F.coalesce("final_text", "ocr_text", "pdf_text", F.lit(""))
    hits = pages.withColumn("text", best).filter(F.contains("text", F.lit(text)))
    return hits.join(docs.select(F.col("id").alias("document_id"), "title", "source_id"), "document_id").select("document_id", "page_number", "title", "source_id", "text")


def count_page_matches(pages: DataFrame, text: str) -> DataFrame:
    """Number of pages whose best text holds ``text``."""
    return pages.filter(F.contains(F.coalesce("final_text", "ocr_text", "pdf_text", F.lit("")), F.lit(text))).agg(F.count("*").alias("n"))


def listed(docs: DataFrame, versions: DataFrame, tag: str | None = None, kind: str | None = None, source: str | None = None, limit: int = 20) -> DataFrame:
    """Newest documents by the first given of tag, type group and source."""
    if tag is not None:
        docs = by_tag(docs, tag)
    elif kind is not None:
        return by_category(docs, versions, kind, limit)
    elif source is not None:
        docs = docs.filter(F.col("source_id") == source)
    return docs.orderBy(F.desc("updated"), "id").limit(limit)


def info(docs: DataFrame, key: str) -> DataFrame:
    """The document with the id; else those with the id prefix or, in any case, the title part."""
    exact = docs.filter(F.col("id") == key)
    loose = docs.filter(F.startswith("id", F.lit(key)) | F.contains(F.lower("title"), F.lit(key.lower())))
    return exact if exact.limit(1).count() else loose


def navigation(docs: DataFrame) -> DataFrame:
    """Previous and next id, position and total inside each source, by id."""
    by = Window.partitionBy("source_id")
    order = by.orderBy("id")
    return docs.select(
        "id", "source_id", F.lag("id").over(order).alias("prev_id"), F.lead("id").over(order).alias("next_id"),
        F.row_number().over(order).alias("position"), F.count("*").over(by).alias("total"),
    )


def neighbours(docs: DataFrame, key: str, source: str) -> DataFrame:
    """Navigation of one document by aggregates: no window over a large source."""
    own = docs.filter(F.col("source_id") == source)
    return own.agg(
        F.max(F.when(F.col("id") < key, F.col("id"))).alias("prev_id"), F.min(F.when(F.col("id") > key, F.col("id"))).alias("next_id"),
        F.count_if(F.col("id") <= key).alias("position"), F.count("*").alias("total"),
    )


def after(frame: DataFrame, cursor, limit: int, key: str = "id") -> DataFrame:
    """Keyset page: rows behind the cursor in key order."""
    return frame.filter(F.col(key) > F.lit(cursor)).orderBy(key).limit(limit)


def containers(docs: DataFrame, versions: DataFrame, kind: str) -> DataFrame:
    """Unprocessed documents that are archives or e-mails, oldest first."""
    is_kind = F.col("mime_type").isin(*mime.ARCHIVES) if kind == "archive" else mime.in_group(F.col("mime_type"), "email")
    ids = versions.filter(is_kind).select(F.col("document_id").alias("id"))
    return docs.filter(F.col("status").isin("pending", "downloaded")).join(ids, "id", "left_semi").orderBy("created", "id")


def all_tags(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def search_tags(docs: DataFrame, text: str, most: int = 100) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).filter(F.contains(F.lower("tag"), F.lit(text.lower()))).distinct().orderBy("tag").limit(most)


def sample(frame: DataFrame, key: str | list[Column], most: int = 10_000) -> DataFrame:
    """Every k-th row in key order, about ``most`` of them, without a window over all rows.

    A sampling operator: rows are numbered by range partition, from the counts
    of the partitions before.  Borders of range partitions are drawn anew in
    every run, so the numbered rows are cut by checkpoint(), and counted and
    taken from there.  ``key`` is a column or a list of sort orders; rows of
    one key are in no fixed order.
    """
    keys = [key] if isinstance(key, str) else key
    spread = frame.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id())
    spread = checkpointed(spread)
    counts = {r["__part"]: r["n"] for r in spread.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    total = sum(counts.values())
    step = max(1, -(-total // most))
    if not counts:
        return frame.limit(0)
    starts, before = [], 0
    for part in range(max(counts) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    place = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("__part")) + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.filter(place % step == 0).drop("__part", "__place")
