"""Work queues: what needs analysis, claims, retries, and state changes.

Tables are immutable: a change is a function from the old frame to the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRY_SECONDS = 12 * 3600
LOCK_SECONDS = 90 * 60


def needing_analysis(docs: DataFrame, versions: DataFrame, results: DataFrame, kind: str, now: int, retry: int = RETRY_SECONDS, source: str | None = None, mime_type: str | None = None) -> DataFrame:
    """Ids of live documents with a version that has no finished, freshly failed or locked result of ``kind``."""
    done = results.filter(F.col("analysis_type") == kind)
    blocked = done.filter(
        (F.col("status") == "complete")
        | ((F.col("status") == "failed") & (F.col("created") > now - retry))
        | ((F.col("status") == "pending") & (F.col("created") > now - LOCK_SECONDS))
    ).select("document_id", "version_id")
    live = docs.filter(F.col("status") != "failed")
    if source is not None:
        live = live.filter(F.col("source_id") == source)
    each = versions.select("document_id", F.col("id").alias("version_id"), "mime_type")
    if mime_type is not None:
        each = each.filter(F.col("mime_type") == mime_type)
    open_ = each.join(blocked, ["document_id", "version_id"], "left_anti")
    return open_.join(live.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("document_id").distinct()


def backfill(docs: DataFrame, versions: DataFrame, results: DataFrame, kind: str, now: int) -> DataFrame:
    """Completion rows for finished documents whose newest version lacks one."""
    last = versions.groupBy("document_id").agg(F.max("id").alias("version_id"))
    finished = docs.filter(F.col("status").isin("indexed", "ocr_complete")).select(F.col("id").alias("document_id"))
    complete = results.filter((F.col("analysis_type") == kind) & (F.col("status") == "complete")).select("document_id", "version_id")
    open_ = last.join(finished, "document_id", "left_semi").join(complete, ["document_id", "version_id"], "left_anti")
    return open_.select("document_id", "version_id", F.lit(kind).alias("analysis_type"), F.lit("complete").alias("status"), F.lit(now).cast("long").alias("created"))


def upsert(table: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``delta`` over ``table`` by null-safe keys; the last by ``order`` of repeated delta rows wins."""
    if order:
        fields = [c for c in delta.columns if c not in keys]
        delta = delta.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("__row")).select(*keys, "__row.*")
    gone = delta.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return table.join(gone, same, "left_anti").unionByName(delta, allowMissingColumns=True)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` appended where their keys are new; repeated rows once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def cascade(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Documents and everything that points at them, without ``ids`` (document_id)."""
    return {n: delete(t, ids if "document_id" in t.columns else ids.withColumnRenamed("document_id", "id")) for n, t in tables.items()}


def change(table: DataFrame, when: Column, **values: Column) -> DataFrame:
    """Columns set where ``when`` holds."""
    return table.withColumns({c: F.when(when, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


def finalize(docs: DataFrame) -> DataFrame:
    return change(docs, F.col("status") == "ocr_complete", status=F.lit("indexed"))


def reset_annotations(docs: DataFrame, source: str | None = None) -> DataFrame:
    hit = F.col("status") == "indexed"
    if source is not None:
        hit &= F.col("source_id") == source
    return change(docs, hit, status=F.lit("ocr_complete"), synopsis=F.lit(None), tags=F.lit(None))


def claim(results: DataFrame, ids: DataFrame, kind: str, now: int) -> DataFrame:
    """A pending row per (document_id, version_id) of ``ids``; it locks for LOCK_SECONDS."""
    rows = ids.select("document_id", "version_id", F.lit(kind).alias("analysis_type"), F.lit("pending").alias("status"), F.lit(now).cast("long").alias("created"))
    return upsert(results, rows, ["document_id", "version_id", "analysis_type"])


def fail(retries: Column, most: Column, now: Column) -> Column:
    """struct(status, retry_count, next_retry) after one more failure: 5**n minutes, or 70 days when exhausted."""
    n = retries + 1
    over = n >= most
    wait = F.when(over, 70 * 86400).otherwise(F.pow(F.lit(5.0), n).cast("long") * 60)
    return F.struct(F.when(over, "exhausted").otherwise("failed").alias("status"), n.alias("retry_count"), (now + wait).cast("long").alias("next_retry"))


def retryable(urls: DataFrame, now: int) -> DataFrame:
    """Failed URLs that are due, and reset ones that failed before, as discovered."""
    due = (F.col("status") == "failed") & (F.col("next_retry") <= now)
    reset = change(urls, due, status=F.lit("discovered"))
    return reset.filter((F.col("status") == "discovered") & (F.col("retry_count") > 0))


def reset_failed(urls: DataFrame, source: str | None = None) -> DataFrame:
    hit = F.col("status").isin("failed", "exhausted")
    if source is not None:
        hit &= F.col("source_id") == source
    return change(urls, hit, status=F.lit("discovered"), retry_count=F.lit(0), next_retry=F.lit(None))


def claim_urls(urls: DataFrame, n: int) -> DataFrame:
    """The ``n`` next discovered URLs, shallow and early ones first, as fetching."""
    return urls.filter("status = 'discovered'").orderBy("depth", "discovered", "id").limit(n).withColumn("status", F.lit("fetching"))


def pipeline(frame: DataFrame, *stages) -> DataFrame:
    """Stages applied one after the other; a stage is a function from frame to frame."""
    for stage in stages:
        frame = stage(frame)
    return frame


def heartbeat(states: DataFrame, beats: DataFrame) -> DataFrame:
    """Newest status per service."""
    both = states.unionByName(beats)
    fields = [c for c in both.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*fields), F.col("last_heartbeat")).alias("s")).select("id", "s.*")


def drop_stale(states: DataFrame, now: int, seconds: int) -> DataFrame:
    return states.filter(~((F.col("status") == "stopped") & (F.col("last_heartbeat") < now - seconds)))


class Queue:
    """Work of one kind over immutable tables: what is open, a batch of it, and the table after a claim, a result or a failure."""

    def __init__(self, docs: DataFrame, versions: DataFrame, kind: str, now: int):
        self.docs, self.versions, self.kind, self.now = docs, versions, kind, now

    def open(self, results: DataFrame) -> DataFrame:
        return needing_analysis(self.docs, self.versions, results, self.kind, self.now)

    def batch(self, results: DataFrame, after: str = "", size: int = 4096) -> DataFrame:
        return self.open(results).filter(F.col("document_id") > after).orderBy("document_id").limit(size)

    def _rows(self, ids: DataFrame, status: str) -> DataFrame:
        last = self.versions.groupBy("document_id").agg(F.max("id").alias("version_id")).join(ids.select("document_id"), "document_id", "left_semi")
        return last.select("document_id", "version_id", F.lit(self.kind).alias("analysis_type"), F.lit(status).alias("status"), F.lit(self.now).cast("long").alias("created"))

    def _put(self, results: DataFrame, ids: DataFrame, status: str) -> DataFrame:
        return upsert(results, self._rows(ids, status), ["document_id", "version_id", "analysis_type"])

    def claim(self, results: DataFrame, ids: DataFrame) -> DataFrame:
        return self._put(results, ids, "pending")

    def complete(self, results: DataFrame, ids: DataFrame) -> DataFrame:
        return self._put(results, ids, "complete")

    def fail(self, results: DataFrame, ids: DataFrame) -> DataFrame:
        return self._put(results, ids, "failed")


def wide(results: DataFrame, *stages) -> DataFrame:
    """Each stage over all its open work before the next one starts."""
    return pipeline(results, *stages)


def deep(chunks: list[DataFrame], results: DataFrame, *stages) -> DataFrame:
    """All stages over one chunk of ids before the next chunk; a stage is a function of (results, ids)."""
    for ids in chunks:
        for stage in stages:
            results = stage(results, ids)
    return results


def fetched(urls: DataFrame, answers: DataFrame, now: int) -> DataFrame:
    """Crawl URLs after ``answers`` (url, status, size): fetched, skipped if unchanged, failed else; others stay."""
    state = F.when(F.col("__s") == 304, "skipped").when(F.col("__s").isin(200, 206) & (F.col("__n") > 0), "fetched").otherwise("failed")
    hit = F.col("__s").isNotNull()
    joined = urls.join(answers.select("url", F.col("status").alias("__s"), F.col("size").alias("__n")), "url", "left")
    at = F.when(hit & (state == "fetched"), F.lit(now)).otherwise(F.col("fetched")).cast(urls.schema["fetched"].dataType)
    return joined.select(*[F.when(hit, state).otherwise(F.col("status")).alias(c) if c == "status" else at.alias(c) if c == "fetched" else F.col(c) for c in urls.columns])


def refresh_due(urls: DataFrame, now: int, ttl: int) -> DataFrame:
    """Fetched URLs older than ``ttl`` seconds."""
    return urls.filter((F.col("status") == "fetched") & (F.col("fetched") < now - ttl))


def changed_since(urls: DataFrame, heads: DataFrame) -> DataFrame:
    """Of ``urls`` (url, last_modified) those whose ``heads`` (url, last_modified) say another time, or none."""
    new = heads.select("url", F.col("last_modified").alias("__new"))
    return urls.join(new, "url").filter(F.col("__new").isNull() | ~F.col("__new").eqNullSafe(F.col("last_modified"))).drop("__new")


def start_jobs(jobs: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """``wanted`` (name) with ``accepted``: no job of that name runs; the accepted ones are started as of ``now``."""
    running = jobs.filter("status = 'running'").select("name").distinct().withColumn("__busy", F.lit(True))
    asked = wanted.select("name").distinct().join(running, "name", "left").withColumn("accepted", F.col("__busy").isNull())
    return asked.select("name", "accepted", F.when(F.col("accepted"), F.lit(now)).cast("long").alias("started"))
