"""Registered queries of state changes, queues, backends and pacing, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import backends
from .cache import Kept
from .functions import dates
from .operators import state, stats, versions, work
from .plans import views
from .plans.views import ANCHOR
from .queries import query
from .session import read
from .sources import api, progress
from .streaming import rate_limit

# Crawl URLs


@query("SELECT id, url, status FROM v_crawl UNION ALL SELECT -1, 'https://new.org/' || p, 'discovered' FROM (SELECT DISTINCT page_id % 3 AS p FROM pages)")
def added_urls(spark, d):
    """Known URLs are not added again; new ones once."""
    urls = views.crawl_urls(spark, d).select("id", "url", "status")
    new = read(spark, d, "pages").select(F.lit(-1).cast("long").alias("id"), F.concat(F.lit("https://new.org/"), (F.col("page_id") % 3).cast("string")).alias("url"), F.lit("discovered").alias("status"))
    return work.insert_new(urls, urls.withColumn("status", F.lit("again")).unionByName(new), ["url"])


@query("SELECT id, CASE WHEN status = 'fetched' AND id % 2 = 0 THEN 'discovered' ELSE status END AS status FROM v_crawl")
def urls_marked_for_refresh(spark, d):
    urls = views.crawl_urls(spark, d)
    return work.change(urls, (F.col("status") == "fetched") & (F.col("id") % 2 == 0), status=F.lit("discovered")).select("id", "status")


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'skipped' WHEN id % 4 = 1 THEN 'fetched' WHEN id % 4 = 2 THEN 'failed' ELSE status END AS status, CASE WHEN id % 4 = 1 THEN {ANCHOR} ELSE coalesce(fetched, 0) END AS fetched FROM v_crawl WHERE url NOT IN (SELECT url FROM v_crawl GROUP BY url HAVING count(*) > 1)")
def fetched_urls(spark, d):
    """Answers of one in four: unchanged, with content, empty, none."""
    urls = views.crawl_urls(spark, d)
    once = urls.groupBy("url").agg(F.count("*").alias("n")).filter("n = 1").select("url")
    urls = urls.join(once, "url", "left_semi")
    k = F.col("id") % 4
    answers = urls.filter(k < 3).select("url", F.when(k == 0, 304).otherwise(200).alias("status"), F.when(k == 1, 10).otherwise(0).alias("size"))
    return work.fetched(urls, answers, ANCHOR).select("id", "status", F.coalesce("fetched", F.lit(0)).alias("fetched"))


@query(f"SELECT id FROM v_crawl WHERE status = 'fetched' AND fetched < {ANCHOR} - 3 * 86400 AND id % 3 <> 0")
def changed_urls(spark, d):
    """Due URLs whose time changed or is unknown now."""
    due = work.refresh_due(views.crawl_urls(spark, d), ANCHOR, 3 * 86400).select("id", F.concat("url", F.lit("#"), "id").alias("url"), F.lit("Mon").alias("last_modified"))
    heads = due.select("url", F.when(F.col("id") % 3 == 0, "Mon").when(F.col("id") % 3 == 1, "Tue").alias("last_modified"))
    return work.changed_since(due, heads).select("id")


@query("SELECT id FROM v_crawl WHERE NOT (source_id = (SELECT min(source_id) FROM v_crawl) AND status IN ('discovered', 'fetching'))")
def cleared_source(spark, d):
    """Open URLs of one source deleted."""
    urls = views.crawl_urls(spark, d)
    first = urls.agg(F.min("source_id")).first()[0]
    gone = urls.filter((F.col("source_id") == first) & F.col("status").isin("discovered", "fetching")).select("id")
    return work.delete(urls, gone).select("id")


@query("SELECT source_id, count(*) AS n, min(id) FILTER (WHERE id > (SELECT max(event_id) FROM events)) IS NOT NULL AS added FROM (SELECT id, source_id FROM v_requests UNION ALL SELECT (SELECT max(event_id) FROM events) + 1 + doc_id, source FROM documents) GROUP BY 1")
def logged_requests(spark, d):
    """Rows appended to the request log, with ids after its largest."""
    log = views.requests(spark, d)
    out = progress.log_requests(log, read(spark, d, "documents").select(F.col("source").alias("source_id"), F.lit("https://x.org").alias("url"), F.lit(200).alias("response_status")))
    top = log.agg(F.max("id")).first()[0]
    assert out.groupBy("id").count().filter("count > 1").limit(1).count() == 0
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.bool_or(F.col("id") > top).alias("added"))


# Configurations, services, sources


@query("SELECT source_id, config_hash IS DISTINCT FROM wanted AS changed FROM (SELECT source_id, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN 'same' ELSE 'old' END AS config_hash, 'same' AS wanted FROM (SELECT source_id, count(*) AS n FROM v_documents GROUP BY 1))")
def changed_configs(spark, d):
    n = F.col("n") % 3
    held = stats.by(views.documents(spark, d), "source_id").withColumn("config_hash", F.when(n == 1, "same").when(n == 2, "old"))
    return held.select("source_id", state.config_changed(F.col("config_hash"), F.lit("same")).alias("changed"))


@query("SELECT DISTINCT source_id, CASE WHEN source_id = 'src3' THEN 'new' ELSE 'old' END AS config_hash FROM v_documents UNION ALL SELECT 'other', 'first'")
def stored_configs(spark, d):
    """A known source's hash replaced, an unknown one's added."""
    configs = views.documents(spark, d).select("source_id").distinct().withColumn("config_hash", F.lit("old"))
    return state.store_config(state.store_config(configs, "src3", "new"), "other", "first")


@query("SELECT hash, created FROM (SELECT content_hash AS hash, max(acquired) AS created FROM v_versions GROUP BY 1 UNION ALL SELECT 'fresh', 9999999999) ORDER BY created DESC, hash DESC LIMIT 16")
def config_history(spark, d):
    """A configuration is added if its hash is new, and the newest 16 stay."""
    held = views.versions(spark, d).groupBy(F.col("content_hash").alias("hash")).agg(F.max("acquired").alias("created"))
    fresh = spark.createDataFrame([("fresh", 9999999999)], "hash string, created long")
    known = held.orderBy("hash").limit(1).withColumn("created", F.lit(9999999999))
    return state.add_config(state.add_config(held, fresh, 10**6), known)


@query(f"SELECT id, event_type FROM (SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, max(event_id) AS last FROM events GROUP BY 1) WHERE NOT (event_type = (SELECT min(event_type) FROM events) AND last < (SELECT max(event_id) FROM events) - 200)")
def live_services(spark, d):
    """Stopped services that are silent for long are dropped; others stay however old."""
    events = read(spark, d, "events")
    kind, top = events.agg(F.min("event_type"), F.max("event_id")).first()
    beats = events.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("kind"), F.max("event_id").alias("last_heartbeat"))
    out = work.drop_stale(beats.withColumn("status", F.when(F.col("kind") == kind, "stopped").otherwise("running")), top, 200)
    return out.select("id", F.col("kind").alias("event_type"))


@query("SELECT 'documents' AS part, CASE WHEN source_id = 'src3' THEN 'renamed' ELSE source_id END AS source_id, count(*) AS n FROM v_documents GROUP BY 2 UNION ALL SELECT 'crawl', CASE WHEN source_id = 'src3' THEN 'renamed' ELSE source_id END, count(*) FROM v_crawl GROUP BY 2")
def renamed_source(spark, d):
    tables = state.rename_source({"documents": views.documents(spark, d), "crawl": views.crawl_urls(spark, d)}, "src3", "renamed")
    parts = [stats.by(t, "source_id").select(F.lit(n).alias("part"), "source_id", "n") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT source_id, CASE WHEN source_id = 'src3' THEN '{\"depth\":2}' ELSE '{}' END AS config FROM (SELECT DISTINCT source_id FROM v_documents) WHERE source_id <> 'src4' UNION ALL SELECT 'other', '{}'")
def scraper_configs(spark, d):
    """JSON configurations per source: one changed, one added, one deleted."""
    held = views.documents(spark, d).select("source_id").distinct().withColumn("config", F.lit("{}"))
    delta = spark.createDataFrame([("src3", '{"depth":2}'), ("other", "{}")], held.schema)
    return work.delete(work.upsert(held, delta, ["source_id"]), spark.createDataFrame([("src4",)], "source_id string"))


# Documents, versions, pages


@query(f"SELECT id, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS version, doc_id % 3 = 0 AS error, CASE WHEN doc_id % 3 < 2 THEN {ANCHOR} ELSE updated END AS updated FROM v_documents")
def recorded_annotations(spark, d):
    """Annotations of two kinds and versions recorded in the metadata; a later one of a kind replaces the former."""
    docs = views.documents(spark, d).withColumn("metadata", F.lit('{"keep":"x"}'))
    k = F.col("doc_id") % 3
    record = lambda kind, version, error: F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.lit("data").alias("data"), F.lit(error).cast("string").alias("error"))
    first = docs.filter(k < 2).select("id", F.inline(F.array(record("ner", 1, None), record("dates", 1, None))))
    out = state.annotate(state.annotate(docs, first, ANCHOR), docs.filter(k == 0).select("id", F.inline(F.array(record("ner", 2, "broken")))), ANCHOR)
    held = F.from_json(F.get_json_object(F.get_json_object("metadata", "$.annotations"), "$.ner"), "version int, error string")
    return out.select("id", F.coalesce(held["version"], F.lit(0)).alias("version"), F.coalesce(held["error"] == "broken", F.lit(False)).alias("error"), "updated")


@query("SELECT 'needing' AS part, count(*) FILTER (WHERE doc_id % 4 <> 0) AS n FROM documents UNION ALL SELECT 'current', count(*) FILTER (WHERE doc_id % 4 = 0) FROM documents")
def annotations_needed(spark, d):
    """Documents without an annotation, with an older one, and with the current one."""
    docs = views.documents(spark, d).withColumn("metadata", F.lit("{}").cast("string"))
    k = F.col("doc_id") % 4
    old = state.set_annotation(docs.filter(k == 1), "ner", 1, F.lit("x"))
    new = state.set_annotation(state.set_annotation(docs.filter(k == 0), "ner", 1, F.lit("x")), "ner", 2, F.lit("y"))
    every = docs.filter(k > 1).unionByName(old).unionByName(new)
    needing = state.needing_annotation(every, "ner", 2)
    rest = every.join(needing.select("id"), "id", "left_anti")
    count = lambda f, name: f.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(needing, "needing").unionByName(count(rest, "current"))


@query("SELECT d.id, CASE WHEN f.fid IS NOT NULL THEN CAST(CAST(strptime(regexp_extract(name, '[0-9]{8}'), '%Y%m%d') AS DATE) AS VARCHAR) ELSE CAST(estimated_date AS VARCHAR) END AS day, CASE WHEN f.fid IS NOT NULL THEN 'detected:filename' END AS source FROM v_documents d LEFT JOIN (SELECT document_id AS fid, arg_max(original_filename, id) AS name FROM v_versions GROUP BY 1 HAVING arg_max(original_filename, id) IS NOT NULL) f ON f.fid = d.id")
def dated_documents(spark, d):
    """Dates detected from the newest version's file name, written to the documents."""
    last = stats.latest(views.versions(spark, d), "original_filename", "acquired")
    found = dates.detect(F.lit(None).cast("timestamp"), F.timestamp_seconds("acquired"), F.coalesce("original_filename", F.lit("")), F.lit("x"), 2025)
    hits = last.select(F.col("document_id").alias("id"), found.alias("f")).filter("f IS NOT NULL").select("id", "f.*")
    return state.dated(views.documents(spark, d), hits).select("id", F.col("estimated_date").cast("string").alias("day"), F.col("date_source").alias("source"))


@query("SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'note ' || id ELSE synopsis END AS synopsis, CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE array_to_string(tags, ',') END AS tags, CASE WHEN doc_id % 2 = 0 THEN 'indexed' ELSE status END AS status FROM v_documents")
def summarised_documents(spark, d):
    docs = views.documents(spark, d)
    notes = docs.filter("doc_id % 2 = 0").select("id", F.concat(F.lit("note "), "id").alias("synopsis"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return state.summarised(docs, notes).select("id", "synopsis", F.array_join("tags", ",").alias("tags"), "status")


@query("SELECT document_id, count(*) AS n, max(id) > (SELECT max(id) FROM v_versions) AS added FROM (SELECT id, document_id FROM v_versions UNION ALL SELECT 10 * (SELECT max(id) FROM v_versions) + doc_id, id FROM v_documents WHERE doc_id % 5 = 0) GROUP BY 1")
def added_versions(spark, d):
    """Documents saved with a further version; ids go on after the largest."""
    held = views.versions(spark, d)
    new = views.documents(spark, d).filter("doc_id % 5 = 0").select(F.col("id").alias("document_id"), F.lit("h").alias("content_hash"))
    out = state.add_versions(held, new)
    top = held.agg(F.max("id")).first()[0]
    return out.groupBy("document_id").agg(F.count("*").alias("n"), (F.max("id") > top).alias("added"))


@query("SELECT document_id, page_number, CASE WHEN page_number % 2 = 0 THEN 'again' ELSE pdf_text END AS text FROM v_pages UNION ALL SELECT DISTINCT document_id, 0, 'cover' FROM v_pages")
def saved_pages(spark, d):
    """Every second page saved again, and a cover for each document."""
    pages = views.pages(spark, d).select("document_id", F.lit(1).alias("version_id"), "page_number", F.col("pdf_text").alias("text"))
    again = pages.filter("page_number % 2 = 0").withColumn("text", F.lit("again"))
    cover = pages.select("document_id", "version_id").distinct().withColumn("page_number", F.lit(0).cast("long")).withColumn("text", F.lit("cover"))
    return state.add_pages(pages, again.unionByName(cover)).select("document_id", "page_number", "text")


@query("SELECT document_id, page_number FROM v_pages WHERE document_id NOT IN (SELECT id FROM v_documents WHERE status = 'failed') UNION ALL SELECT document_id, page_number FROM v_pages WHERE document_id IN (SELECT id FROM v_documents WHERE status = 'failed') AND page_number > 3")
def deleted_pages(spark, d):
    """First three pages of failed documents deleted."""
    pages = views.pages(spark, d)
    gone = views.documents(spark, d).filter("status = 'failed'").select(F.col("id").alias("document_id")).withColumn("page_number", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 3)])))
    return work.delete(pages, gone).select("document_id", "page_number")


@query("SELECT document_id, entity_type, normalized_text FROM v_entities UNION SELECT document_id, 'topic', 'x' FROM v_entities")
def saved_entities(spark, d):
    """Known entities are not saved again; new ones once."""
    held = views.entities(spark, d).select("document_id", "entity_type", "normalized_text")
    new = held.select("document_id").withColumn("entity_type", F.lit("topic")).withColumn("normalized_text", F.lit("x"))
    return state.add_entities(held, held.unionByName(new))


@query("SELECT document_id, normalized_text FROM v_entities WHERE CAST(document_id AS INTEGER) % 2 = 1")
def deleted_entities(spark, d):
    held = views.entities(spark, d)
    return work.delete(held, held.filter(F.col("document_id").cast("int") % 2 == 0).select("document_id").distinct()).select("document_id", "normalized_text")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'text/csv' ELSE mime_type END AS mime_type, CASE WHEN id % 2 = 0 THEN 7 ELSE -1 END AS page_count FROM v_versions")
def updated_versions(spark, d):
    """Types corrected and page counts set."""
    v = views.versions(spark, d).withColumn("page_count", F.lit(None).cast("int"))
    return work.change(work.change(v, F.col("id") % 3 == 0, mime_type=F.lit("text/csv")), F.col("id") % 2 == 0, page_count=F.lit(7)).select("id", "mime_type", F.coalesce("page_count", F.lit(-1)).alias("page_count"))


@query("SELECT id, CASE WHEN id % 2 = 1 THEN legacy_path END AS path, CASE WHEN id % 2 = 0 THEN id % 5 ELSE -1 END AS dedup_index FROM v_versions")
def migrated_paths(spark, d):
    v = views.versions(spark, d).withColumnRenamed("legacy_path", "file_path")
    return state.migrated_paths(v, v.filter("id % 2 = 0").select("id", (F.col("id") % 5).alias("dedup_index"))).select("id", F.col("file_path").alias("path"), F.coalesce("dedup_index", F.lit(-1)).alias("dedup_index"))


_KEPT = "SELECT document_id, first_value(document_id) OVER (PARTITION BY content_hash ORDER BY document_id DESC) AS keeper, count(*) OVER (PARTITION BY content_hash) AS n FROM (SELECT document_id, arg_max(content_hash, id) AS content_hash FROM v_versions GROUP BY 1)"


@query(f"SELECT 'results' AS part, coalesce(k.keeper, a.document_id) AS id, count(DISTINCT (a.version_id, a.analysis_type)) AS n FROM v_analysis a LEFT JOIN ({_KEPT}) k ON k.document_id = a.document_id AND k.n > 1 GROUP BY 2 UNION ALL SELECT 'documents', id, 1 FROM v_documents WHERE id NOT IN (SELECT document_id FROM ({_KEPT}) WHERE n > 1 AND keeper <> document_id)")
def deduplicated(spark, d):
    """Results of duplicates moved to the last id of their group, the duplicates deleted."""
    last = stats.latest(views.versions(spark, d), "content_hash")
    best = last.groupBy("content_hash").agg(F.max("document_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    keepers = last.join(best, "content_hash").select("document_id", "keeper")
    moved = state.repoint(views.analysis(spark, d), keepers).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    left = state.drop_duplicates(views.documents(spark, d), keepers).select(F.lit("documents").alias("part"), "id", F.lit(1).cast("long").alias("n"))
    return moved.select(F.lit("results").alias("part"), "id", "n").unionByName(left)


# Queues and backends


@query("SELECT document_id, version_id, status FROM v_analysis WHERE analysis_type = 'ocr' AND NOT (status = 'pending' AND CAST(document_id AS INTEGER) % 2 = 0) AND document_id NOT IN (SELECT id FROM v_documents WHERE doc_id % 3 = 0) UNION ALL SELECT document_id, max(id), 'complete' FROM v_versions WHERE CAST(document_id AS INTEGER) % 3 = 0 GROUP BY 1")
def stored_results(spark, d):
    """Finished results stored over whatever a document had, and even claims deleted."""
    held = views.analysis(spark, d).filter("analysis_type = 'ocr'")
    q = work.Queue(views.documents(spark, d), views.versions(spark, d), "ocr", ANCHOR)
    done = q.complete(held, views.documents(spark, d).filter("doc_id % 3 = 0").select(F.col("id").alias("document_id")))
    claims = done.filter("status = 'pending' AND CAST(document_id AS INT) % 2 = 0").select("document_id", "version_id", "analysis_type")
    return work.delete(done, claims).select("document_id", "version_id", "status")


_OPEN = f"""SELECT DISTINCT v.document_id FROM v_versions v JOIN v_documents d ON d.id = v.document_id WHERE d.status <> 'failed'
  AND NOT EXISTS (SELECT 1 FROM v_analysis a WHERE a.document_id = v.document_id AND a.version_id = v.id AND a.analysis_type = 'ner' AND (a.status = 'complete' OR a.status = 'failed' AND a.created > {ANCHOR} - 43200 OR a.status = 'pending' AND a.created > {ANCHOR} - 5400))"""


@query(f"SELECT 'open' AS part, count(*) AS n FROM ({_OPEN}) UNION ALL SELECT 'after a claim', 0 UNION ALL SELECT 'batch', least(20, count(*)) FROM ({_OPEN}) WHERE document_id > '3'")
def queue_contract(spark, d):
    """What is open, a batch of it, and what is left when every version is claimed."""
    v = views.versions(spark, d)
    last = v.groupBy("document_id").agg(F.max("id").alias("id"))
    q = work.Queue(views.documents(spark, d), v, "ner", ANCHOR)
    held = views.analysis(spark, d)
    newest = work.Queue(views.documents(spark, d), v.join(last, ["document_id", "id"], "left_semi"), "ner", ANCHOR)
    count = lambda f, name: f.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    claimed = newest.claim(held, newest.open(held))
    return count(q.open(held), "open").unionByName(count(newest.open(claimed), "after a claim")).unionByName(count(q.batch(held, "3", 20), "batch"))


@query("SELECT way, status, count(*) AS n FROM (SELECT unnest(['wide', 'deep']) AS way, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'complete' END AS status FROM documents) GROUP BY 1, 2")
def stage_orders(spark, d):
    """Two stages over all documents, stage by stage and chunk by chunk, end alike."""
    docs, v = views.documents(spark, d), views.versions(spark, d)
    ids = docs.select(F.col("id").alias("document_id"), "doc_id")
    q = work.Queue(docs, v, "ocr", ANCHOR)
    empty = views.analysis(spark, d).limit(0)
    bad = ids.filter("doc_id % 4 = 0")
    wide = work.wide(empty, lambda r: q.complete(r, ids), lambda r: q.fail(r, bad))
    deep = work.deep([ids.filter("doc_id % 2 = 0"), ids.filter("doc_id % 2 = 1")], empty, q.complete, lambda r, part: q.fail(r, part.filter("doc_id % 4 = 0")))
    return reduce(DataFrame.unionByName, [stats.by(f, "status").select(F.lit(n).alias("way"), "status", "n") for n, f in (("wide", wide), ("deep", deep))])


def _shout(row: dict) -> str | None:
    if int(row["document_id"]) % 7 == 0:
        raise ValueError("broken")
    return None if int(row["document_id"]) % 5 == 0 else f"{row['document_id']}!"


_CUSTOM = backends.Backend("shout", "custom", _shout, ("application/*",))


@query("SELECT id AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'no_result' ELSE 'complete' END AS status, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN id || '!' END AS result, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: broken' END AS error FROM v_documents WHERE mime_type LIKE 'application/%'")
def custom_backend(spark, d):
    """A plug-in over the documents of its types: results, none, and errors that are recorded; stored over a former run's."""
    docs = views.documents(spark, d).select(F.col("id").alias("document_id"), "mime_type")
    out = backends.apply(docs, _CUSTOM, ["document_id"])
    former = out.withColumn("result", F.lit("former"))
    return backends.recorded(out, former).select("document_id", "status", "result", "error")


@query("SELECT id AS document_id, CASE mime_type WHEN 'application/pdf' THEN 'pdf' WHEN 'text/html' THEN 'text' WHEN 'text/plain' THEN 'text' ELSE NULL END AS backend FROM v_documents WHERE mime_type <> 'application/zip' UNION ALL SELECT id, 'any' FROM v_documents WHERE mime_type = 'application/zip'")
def chosen_backends(spark, d):
    """The first backend of the kind that supports the type; others and other kinds are passed over."""
    make = lambda name, kind, *patterns: backends.Backend(name, kind, lambda r: None, patterns)
    known = [make("voice", "speech", "*"), make("pdf", "text", "application/pdf"), make("text", "text", "text/*"), make("zip", "unpack", "application/zip"), make("any", "text", "application/zip", "application/pdf")]
    docs = views.documents(spark, d).select(F.col("id").alias("document_id"), "mime_type")
    return backends.chosen(docs, known, "text").select("document_id", "backend")


@query("SELECT page_id, arg_min(backend, CASE backend WHEN 'second' THEN 0 ELSE 1 END) AS backend FROM (SELECT page_id, unnest(['first', 'second', 'third']) AS backend FROM v_ocr) WHERE NOT (backend = 'second' AND page_id % 3 = 0) AND NOT (backend = 'first' AND page_id % 6 = 0) AND backend <> 'third' GROUP BY 1")
def fallback_results(spark, d):
    """The first backend in order that succeeded; pages on which all failed have none."""
    rows = views.ocr_results(spark, d).select(F.col("page_id").alias("document_id"), F.explode(F.array(F.lit("first"), F.lit("second"), F.lit("third"))).alias("backend"))
    bad = ((F.col("backend") == "second") & (F.col("document_id") % 3 == 0)) | ((F.col("backend") == "first") & (F.col("document_id") % 6 == 0))
    rows = rows.withColumn("status", F.when(bad, "failed").otherwise("complete")).withColumn("result", F.lit("x"))
    return backends.fallback(rows, ["second", "first"]).select(F.col("document_id").alias("page_id"), "backend")


@query("SELECT page_id, 'b' AS backend, length(text) + 1 AS chars, 1 AS distance FROM v_ocr WHERE text IS NOT NULL UNION ALL SELECT page_id, 'a', length(text), 0 FROM v_ocr WHERE text IS NOT NULL")
def compared_backends(spark, d):
    """Two backends' texts of a page, the second with one character more."""
    one = views.ocr_results(spark, d).filter("text IS NOT NULL").select("page_id", F.lit("a").alias("backend"), "text")
    two = one.withColumn("backend", F.lit("b")).withColumn("text", F.concat("text", F.lit("#")))
    return backends.compare(one.unionByName(two)).select("page_id", "backend", F.col("chars").cast("long").alias("chars"), F.col("distance").cast("long").alias("distance"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS document_id, 'budget|' || lower(n_name) || '|report ' || n_nationkey AS terms FROM nation")
def expanded_terms(spark, d):
    """Seeds, and the comma list of a term backend, each term once."""
    model = backends.Backend("terms", "terms", lambda r: f"BUDGET, {r['domain'].lower()} ,report {r['document_id']}")
    sites = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("document_id"), F.col("n_name").alias("domain"), F.array(F.lit("Budget")).alias("seeds"))
    return backends.term_list(model, sites).select("document_id", F.array_join("terms", "|").alias("terms"))


@query("SELECT page_id, image_hash FROM v_ocr")
def image_hashes(spark, d):
    """Digest of a page's bytes."""
    from .functions import names

    pages = views.pages(spark, d).select((F.col("document_id").cast("long") * 100_000 + F.col("page_number")).alias("page_id"), F.col("pdf_text").cast("binary").alias("image"))
    return pages.select("page_id", names.sha256(F.col("image")).alias("image_hash"))


# Pacing


@query("SELECT id, CASE WHEN response_status IN (429, 503) THEN 'limited' WHEN response_status = 403 THEN 'forbidden' WHEN response_status >= 500 THEN 'server_error' WHEN response_status BETWEEN 200 AND 399 THEN 'success' END AS outcome, greatest(0, 500 - duration_ms) AS ready FROM (SELECT id, duration_ms, CASE WHEN id % 11 = 0 THEN 404 WHEN id % 11 = 1 THEN 500 ELSE response_status END AS response_status FROM v_requests)")
def request_outcomes(spark, d):
    k = F.col("id") % 11
    log = views.requests(spark, d).withColumn("response_status", F.when(k == 0, 404).when(k == 1, 500).otherwise(F.col("response_status")))
    return log.select("id", rate_limit.outcome(F.col("response_status")).alias("outcome"), rate_limit.ready_in(F.lit(500), F.col("duration_ms")).alias("ready"))


@query("SELECT source_id, count(DISTINCT url) AS urls FROM v_requests WHERE response_status = 403 AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def kept_blocks(spark, d):
    """Forbidden answers that are older than the window are forgotten."""
    log = views.requests(spark, d)
    now = log.agg(F.max("ts")).first()[0]
    return rate_limit.kept(log.filter("response_status = 403"), F.lit(now), 86400).groupBy("source_id").agg(F.countDistinct("url").alias("urls"))


@query("SELECT page_id, 'b' || CAST(least(page_id, 0) + (page_id % 3) AS VARCHAR) AS browser FROM pages")
def browser_turns(spark, d):
    """Healthy browsers by turn."""
    return read(spark, d, "pages").select("page_id", rate_limit.browser(["b0", "b1", "b2"], F.col("page_id")).alias("browser"))


@query("SELECT source_id, count(*) AS n, 1 AS computed FROM v_documents GROUP BY 1")
def kept_counts(spark, d):
    """Counts computed once inside the time they are kept, and again after it."""
    kept, made = Kept(300), []
    docs = views.documents(spark, d)

    def make():
        made.append(1)
        return stats.by(docs, "source_id")

    first = kept.rows("counts", 0, make)
    assert kept.rows("counts", 299, make) is first
    return spark.createDataFrame(first, "source_id string, n long").withColumn("computed", F.lit(len(made)))


# Imports


_PROGRESS = "CASE page_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN ' offset:' || page_id WHEN 2 THEN 'error: no ' || page_id WHEN 3 THEN '{\"position\":' || page_id || ',\"done\":false,\"error\":null}' ELSE 'junk' END"


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN page_id WHEN 2 THEN 0 WHEN 3 THEN page_id ELSE -1 END AS position, CASE WHEN page_id % 5 < 4 THEN CAST(page_id % 5 = 0 AS VARCHAR) END AS done, CASE WHEN page_id % 5 = 2 THEN ' no ' || page_id END AS error FROM pages")
def import_progress(spark, d):
    """Progress files of both formats, and broken ones."""
    p = progress.parsed(F.expr(_PROGRESS.replace("CAST", "cast")))
    return read(spark, d, "pages").select("page_id", p.alias("p")).select("page_id", F.coalesce("p.position", F.lit(-1)).alias("position"), F.col("p.done").cast("string").alias("done"), "p.error")


@query("SELECT source AS run, CAST(sum(n_chars % 7) AS BIGINT) AS scanned, count(*) AS imported, 0 AS errors, string_agg('u' || doc_id, ',' ORDER BY 'u' || doc_id) AS urls FROM documents GROUP BY 1")
def import_totals(spark, d):
    """Counters of single imports added up by source."""
    zero = F.lit(0).cast("long")
    runs = read(spark, d, "documents").select(
        F.col("source").alias("run"), (F.col("n_chars") % 7).alias("scanned"), F.lit(1).alias("imported"), zero.alias("skipped"), zero.alias("filtered"), zero.alias("no_source"), zero.alias("errors"), zero.alias("missing_files"),
        F.array(F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("imported_urls"),
    )
    return progress.merged(runs, "run").select("run", "scanned", "imported", "errors", F.array_join("imported_urls", ",").alias("urls"))


@query("SELECT page_id FROM pages WHERE page_id > 7")
def resumed_import(spark, d):
    """A source goes on behind its position; one that is done has nothing left."""
    source = progress.TableSource("pages", read(spark, d, "pages"), "page_id")
    assert source.resume(spark, progress.Progress(done=True)) is None
    return source.resume(spark, progress.Progress(position=7)).select("page_id")


@query("SELECT name, rows FROM (SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region)")
def table_list(spark, d):
    """Tables that the session knows, with their rows."""
    return state.tables({n: read(spark, d, n) for n in ("nation", "region")})


@query("SELECT url, digest, captured FROM (SELECT d.source_url AS url, v.content_hash AS digest, v.acquired AS captured FROM v_versions v JOIN v_documents d ON d.id = v.document_id) GROUP BY ALL")
def archive_snapshots(spark, d):
    """Snapshots of every known URL, as an archive source lists them."""
    docs = views.documents(spark, d).select(F.col("id").alias("document_id"), F.col("source_url").alias("url"))
    held = views.versions(spark, d).join(docs, "document_id").select("url", F.col("content_hash").alias("digest"), F.col("acquired").alias("captured"))
    return versions.merged({"a": progress.TableArchive("a", held).snapshots(docs)}).select("url", "digest", "captured").distinct()


_LATE = "SELECT CAST(user_id AS VARCHAR) AS name, CASE WHEN max(event_id) % 2 = 0 THEN 'running' ELSE 'done' END AS status FROM events GROUP BY 1"


@query(f"SELECT name, status <> 'running' AS accepted, CASE WHEN status <> 'running' THEN {ANCHOR} ELSE 0 END AS started FROM ({_LATE}) UNION ALL SELECT 'new', true, {ANCHOR}")
def started_jobs(spark, d):
    """A job starts only if none of its name runs."""
    jobs = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("name")).agg(F.when(F.max("event_id") % 2 == 0, "running").otherwise("done").alias("status"))
    out = work.start_jobs(jobs, jobs.select("name").unionByName(spark.createDataFrame([("new",), ("new",)], "name string")), ANCHOR)
    return out.select("name", "accepted", F.coalesce("started", F.lit(0)).alias("started"))


def _answer(url: str) -> tuple[int, str | None, bytes]:
    kind = len(url) % 4
    if kind == 3:
        raise OSError("no route")
    return (200, "text/html", url.encode()) if kind == 0 else (304, None, b"") if kind == 1 else (200, None, b"")


@query("SELECT status, count(*) AS n, CAST(sum(CAST(now AS INTEGER)) AS BIGINT) AS now FROM (SELECT CASE WHEN c.url IS NULL THEN status WHEN length(u.url) % 4 = 0 THEN 'fetched' WHEN length(u.url) % 4 = 1 THEN 'skipped' ELSE 'failed' END AS status, c.url IS NOT NULL AND length(u.url) % 4 = 0 AS now FROM v_crawl u LEFT JOIN (SELECT DISTINCT url FROM (SELECT url FROM v_crawl WHERE status = 'discovered' ORDER BY depth, discovered, id LIMIT 40)) c ON c.url = u.url) GROUP BY 1")
def scraped_urls(spark, d):
    """The next 40 URLs fetched: with content, unchanged, empty, and failed requests."""
    _, after = api.scrape(views.crawl_urls(spark, d), _answer, ANCHOR, 40)
    return after.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("fetched") == ANCHOR, F.lit(False))).alias("now"))
