"""Registered queries of the engine's own operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, discovery, mime, names, terms, urls
from .operators import browse, crawl, export, geo, state, stats, versions, work
from .plans import views
from .plans.oracle import category, sql
from .plans.views import ANCHOR
from .session import read
from .sources import loadfiles, web

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers the function under its name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = sql(oracle)
        return f

    return add


# Browsing

_PAGE = browse.BrowseParams(status="indexed", categories=["documents", "data"], query="th", page=2, per_page=5)
_PAGE_WHERE = "status = 'indexed' AND category_id IN ('documents', 'data') AND (contains(title, 'th') OR coalesce(contains(synopsis, 'th'), false))"


@query(f"SELECT id, source_id, title, status, updated FROM v_documents WHERE {_PAGE_WHERE} ORDER BY updated DESC, id LIMIT 5 OFFSET 5")
def browse_filtered_page(spark, d):
    return browse.browse(views.documents(spark, d), _PAGE).select("id", "source_id", "title", "status", "updated")


@query(f"SELECT count(*) AS total FROM v_documents WHERE {_PAGE_WHERE}")
def browse_count(spark, d):
    return browse.count(views.documents(spark, d), _PAGE)


@query("SELECT d.id, d.title, max(v.id) AS version_id, arg_max(v.file_size, v.id) AS file_size FROM v_documents d JOIN v_versions v ON v.document_id = d.id GROUP BY d.id, d.title")
def browse_latest_version(spark, d):
    return browse.with_latest_version(views.documents(spark, d).select("id", "title"), views.versions(spark, d))


@query("SELECT id, source_id, updated FROM v_documents WHERE list_contains(tags, 'topic2')")
def tag_documents(spark, d):
    return browse.by_tag(views.documents(spark, d), "topic2").select("id", "source_id", "updated")


@query("SELECT DISTINCT unnest(tags) AS tag FROM v_documents")
def tag_list(spark, d):
    return browse.all_tags(views.documents(spark, d))


@query("SELECT tag FROM (SELECT DISTINCT unnest(tags) AS tag FROM v_documents) WHERE contains(lower(tag), 'opi') ORDER BY tag LIMIT 100")
def tag_search(spark, d):
    return browse.search_tags(views.documents(spark, d), "OPI")


@query("SELECT id, updated FROM v_documents WHERE id IN (SELECT document_id FROM v_versions WHERE contains(mime_type, 'rfc822') OR mime_type LIKE 'message/%') ORDER BY updated DESC, id LIMIT 20")
def type_category_documents(spark, d):
    return browse.by_category(views.documents(spark, d), views.versions(spark, d), "email", 20).select("id", "updated")


@query("SELECT id, source_id FROM v_documents WHERE contains(lower(title), 'erin') OR coalesce(contains(lower(synopsis), 'erin'), false) OR len(list_filter(tags, lambda t: contains(lower(t), 'erin'))) > 0 OR contains(lower(extracted_text), 'erin')")
def text_search(spark, d):
    return browse.search(views.documents(spark, d), "ErIn").select("id", "source_id")


@query("SELECT p.document_id, p.page_number, d.title FROM v_pages p JOIN v_documents d ON d.id = p.document_id WHERE contains(coalesce(final_text, ocr_text, pdf_text, ''), 'thing')")
def like_search_pages(spark, d):
    return browse.search_pages(views.pages(spark, d), views.documents(spark, d), "thing").select("document_id", "page_number", "title")


@query("SELECT id, title FROM v_documents WHERE id = '17'")
def document_info(spark, d):
    return browse.info(views.documents(spark, d), "17").select("id", "title")


@query("SELECT id, title FROM v_documents WHERE starts_with(id, 'onh') OR contains(lower(title), 'onh')")
def document_info_loose(spark, d):
    return browse.info(views.documents(spark, d), "OnH".lower()).select("id", "title")


@query(
    """SELECT id, source_id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, CAST(row_number() OVER w AS INTEGER) AS position,
    count(*) OVER (PARTITION BY source_id) AS total FROM v_documents WINDOW w AS (PARTITION BY source_id ORDER BY id)"""
)
def navigation(spark, d):
    return browse.navigation(views.documents(spark, d))


@query("SELECT max(id) FILTER (WHERE id < '17') AS prev_id, min(id) FILTER (WHERE id > '17') AS next_id, count(*) FILTER (WHERE id <= '17') AS position, count(*) AS total FROM v_documents WHERE source_id = 'src3'")
def navigation_one(spark, d):
    return browse.neighbours(views.documents(spark, d), "17", "src3")


@query("SELECT id, status FROM v_documents WHERE id > '30' ORDER BY id LIMIT 25")
def keyset_page(spark, d):
    return browse.after(views.documents(spark, d), "30", 25).select("id", "status")


@query("SELECT id, status, created FROM v_documents WHERE status IN ('pending', 'downloaded') AND id IN (SELECT document_id FROM v_versions WHERE mime_type = 'application/zip')")
def unprocessed_archives(spark, d):
    return browse.containers(views.documents(spark, d), views.versions(spark, d), "archive").select("id", "status", "created")


@query("SELECT count(*) AS n FROM v_documents WHERE status IN ('pending', 'downloaded') AND mime_type = 'message/rfc822'")
def unprocessed_emails_count(spark, d):
    return browse.containers(views.documents(spark, d), views.versions(spark, d), "email").agg(F.count("*").alias("n"))


@query("SELECT id, created FROM v_documents WHERE status = 'ocr_complete' ORDER BY created, id LIMIT 30")
def needing_summarization(spark, d):
    return views.documents(spark, d).filter("status = 'ocr_complete'").orderBy("created", "id").limit(30).select("id", "created")


@query("SELECT document_id, page_number, ocr_status FROM v_pages WHERE ocr_status IN ('pending', 'text_extracted')")
def pages_needing_ocr(spark, d):
    return views.pages(spark, d).filter(F.col("ocr_status").isin("pending", "text_extracted")).select("document_id", "page_number", "ocr_status")


@query("SELECT id, updated, source_id FROM v_documents ORDER BY updated DESC, id LIMIT 10")
def recent_documents(spark, d):
    return views.documents(spark, d).orderBy(F.desc("updated"), "id").limit(10).select("id", "updated", "source_id")


@query("SELECT DISTINCT source_url AS url FROM v_documents")
def all_urls(spark, d):
    return views.documents(spark, d).select(F.col("source_url").alias("url")).distinct()


@query("SELECT document_id, string_agg(substr(content_hash, 1, 8), ',' ORDER BY id DESC) AS hashes, count(*) AS n FROM v_versions GROUP BY document_id")
def versions_by_document(spark, d):
    v = views.versions(spark, d).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("id", "content_hash")), asc=False).alias("v"), F.count("*").alias("n"))
    return v.select("document_id", F.array_join(F.transform("v", lambda x: F.substring(x["content_hash"], 1, 8)), ",").alias("hashes"), "n")


# Statistics


@query("SELECT count(*) AS n FROM documents")
def document_count(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("n"))


@query("SELECT source_id, count(*) AS n FROM v_documents GROUP BY 1")
def source_counts(spark, d):
    return stats.by(views.documents(spark, d), "source_id")


@query("SELECT status, count(*) AS n FROM v_documents GROUP BY 1")
def status_counts(spark, d):
    return stats.by(views.documents(spark, d), "status")


@query("SELECT source_id, string_agg(status || '=' || n, ',' ORDER BY status) AS counts FROM (SELECT source_id, status, count(*) AS n FROM v_documents GROUP BY 1, 2) GROUP BY 1")
def source_status_counts(spark, d):
    found = stats.nested(views.documents(spark, d), "source_id", "status")
    return found.select("source_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT mime_type, count(*) AS n FROM (SELECT document_id, arg_max(mime_type, id) AS mime_type FROM v_versions GROUP BY 1) GROUP BY 1")
def type_stats(spark, d):
    return stats.types(views.versions(spark, d))


@query(f"SELECT {category('mime_type')} AS category, count(*) AS n FROM (SELECT document_id, arg_max(mime_type, id) AS mime_type FROM v_versions GROUP BY 1) GROUP BY 1")
def category_rollup(spark, d):
    return stats.categories(views.versions(spark, d))


@query(
    """SELECT 'type' AS dimension, mime_type AS value, count(*) AS n FROM v_documents GROUP BY 2 UNION ALL
    SELECT 'source', source_id, count(*) FROM v_documents GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM v_documents GROUP BY 2
    UNION ALL SELECT 'total', '', count(*) FROM v_documents"""
)
def export_stats(spark, d):
    return stats.export(views.documents(spark, d))


@query("SELECT source_id, count(*) AS total, count(*) FILTER (WHERE status = 'indexed') AS annotated, count(*) FILTER (WHERE status = 'ocr_complete') AS needing FROM v_documents GROUP BY 1")
def annotation_stats(spark, d):
    return stats.annotations(views.documents(spark, d))


@query(
    """SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(epoch(day) AS BIGINT) AS epoch FROM (SELECT coalesce(manual_date, estimated_date) AS day FROM v_documents)
    WHERE day BETWEEN DATE '2022-02-01' AND DATE '2023-06-30' GROUP BY day"""
)
def timeline_daily(spark, d):
    return stats.timeline(views.documents(spark, d), "2022-02-01", "2023-06-30")


@query(
    """SELECT source_id, count(*) AS discovered, count(*) FILTER (WHERE status = 'fetched') AS fetched, count(*) FILTER (WHERE status IN ('discovered', 'fetching')) AS pending,
    count(*) FILTER (WHERE status IN ('failed', 'exhausted')) AS failed, count(*) FILTER (WHERE status IN ('discovered', 'fetching')) > 0 AS needs_resume,
    count(*) FILTER (WHERE status IN ('discovered', 'fetching')) = 0 AS complete FROM v_crawl GROUP BY 1"""
)
def crawl_state(spark, d):
    return stats.crawl_state(views.crawl_urls(spark, d))


@query("SELECT source_id, status, count(*) AS n FROM v_crawl GROUP BY 1, 2")
def crawl_status_counts(spark, d):
    return stats.by(views.crawl_urls(spark, d), "source_id", "status")


@query(
    """SELECT source_id, count(*) FILTER (WHERE response_status = 200) AS ok, count(*) FILTER (WHERE response_status = 304) AS not_modified,
    count(*) FILTER (WHERE error IS NOT NULL OR response_status >= 400) AS errors, CAST(trunc(avg(duration_ms)) AS BIGINT) AS mean_ms,
    CAST(sum(response_size) AS BIGINT) AS bytes, count(*) AS total FROM v_requests GROUP BY 1"""
)
def request_stats(spark, d):
    return stats.requests(views.requests(spark, d))


@query(
    """SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.n, 0) AS documents, coalesce(b.n, 0) AS urls FROM
    (SELECT source_id, count(*) AS n FROM v_documents GROUP BY 1) a FULL JOIN (SELECT source_id, count(*) AS n FROM v_crawl GROUP BY 1) b ON a.source_id = b.source_id"""
)
def source_overview(spark, d):
    return stats.sources(views.documents(spark, d), views.crawl_urls(spark, d))


@query(
    """SELECT document_id, count(*) AS pages, count(*) FILTER (WHERE ocr_status IN ('pending', 'text_extracted')) AS needing,
    count(*) FILTER (WHERE ocr_status IN ('pending', 'text_extracted')) = 0 AS complete FROM v_pages GROUP BY 1"""
)
def page_progress(spark, d):
    return stats.page_progress(views.pages(spark, d))


@query("SELECT document_id, sha256(string_agg(ocr_text, chr(10) || chr(10) ORDER BY page_number)) AS digest FROM v_pages WHERE ocr_text IS NOT NULL GROUP BY 1")
def combined_page_text(spark, d):
    return stats.page_text(views.pages(spark, d), F.col("ocr_text")).select("document_id", F.sha2("text", 256).alias("digest"))


@query("SELECT document_id, sha256(string_agg(coalesce(final_text, ocr_text, pdf_text), chr(10) ORDER BY page_number)) AS digest FROM v_pages GROUP BY 1 HAVING string_agg(coalesce(final_text, ocr_text, pdf_text), chr(10) ORDER BY page_number) <> ''")
def document_content(spark, d):
    out = stats.page_text(views.pages(spark, d), F.coalesce("final_text", "ocr_text", "pdf_text"), "\n").filter("text IS NOT NULL")
    return out.select("document_id", F.sha2("text", 256).alias("digest"))


_TERM = r"""SELECT term, count(*) AS n FROM (SELECT lower(regexp_replace(w, '^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$', '', 'g')) AS term
  FROM (SELECT unnest(regexp_split_to_array(text, '[\s,;|/]+')) AS w FROM documents)) WHERE strlen(term) >= 3 AND NOT regexp_full_match(term, '\p{N}+') AND term NOT IN ("""


@query(_TERM + ", ".join(f"'{w}'" for w in terms.STOP_WORDS) + ") GROUP BY 1 ORDER BY n DESC, term LIMIT 100")
def term_frequency(spark, d):
    found = read(spark, d, "documents").select(F.explode(terms.terms(F.col("text"))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


# Versions


@query(
    """SELECT substr(content_hash, 1, 16) AS prefix, count(*) AS n_docs, count(DISTINCT source_id) AS n_sources, min(document_id) AS first_id
    FROM (SELECT document_id, arg_max(content_hash, id) AS content_hash FROM v_versions GROUP BY 1) JOIN (SELECT id, source_id FROM v_documents) d ON d.id = document_id
    GROUP BY content_hash HAVING count(DISTINCT source_id) > 1"""
)
def cross_source_duplicates(spark, d):
    return versions.cross_source(views.versions(spark, d), views.documents(spark, d))


@query("SELECT content_hash, count(DISTINCT document_id) AS n_docs FROM v_versions GROUP BY 1 HAVING count(DISTINCT document_id) > 1")
def dedup_groups(spark, d):
    return versions.dedup_groups(views.versions(spark, d))


_KEEPER = """SELECT document_id, keeper FROM (SELECT document_id, count(*) OVER w AS n, first_value(document_id) OVER (PARTITION BY content_hash ORDER BY score DESC, document_id DESC) AS keeper
  FROM (SELECT document_id, arg_max(content_hash, id) AS content_hash FROM v_versions GROUP BY 1) JOIN (SELECT id, {} AS score FROM v_documents) d ON d.id = document_id
  WINDOW w AS (PARTITION BY content_hash)) WHERE n > 1"""


@query(_KEEPER.format("strlen(extracted_text) + CASE WHEN synopsis IS NOT NULL THEN 1000 ELSE 0 END + CASE WHEN len(tags) > 0 THEN 500 ELSE 0 END"))
def dedup_keeper_most_complete(spark, d):
    return versions.keepers(views.documents(spark, d), views.versions(spark, d))


@query(_KEEPER.format("-created"))
def dedup_keeper_oldest(spark, d):
    return versions.keepers(views.documents(spark, d), views.versions(spark, d), "oldest")


@query("SELECT id, document_id FROM (SELECT *, lag(content_hash) OVER (PARTITION BY document_id ORDER BY id) AS before FROM v_versions) WHERE before IS DISTINCT FROM content_hash")
def version_changes(spark, d):
    return versions.changes(views.versions(spark, d)).select("id", "document_id")


@query("SELECT id, CAST(row_number() OVER (PARTITION BY original_filename, substr(content_hash, 1, 8) ORDER BY id) - 1 AS INTEGER) AS dedup_index FROM v_versions")
def version_dedup_index(spark, d):
    return versions.dedup_index(views.versions(spark, d)).select("id", "dedup_index")


@query("SELECT id, document_id, legacy_path FROM v_versions WHERE legacy_path IS NOT NULL AND id > 40 ORDER BY id LIMIT 50")
def legacy_paths_page(spark, d):
    return browse.after(views.versions(spark, d).filter("legacy_path IS NOT NULL"), 40, 50).select("id", "document_id", "legacy_path")


@query("SELECT digest, min(captured) AS captured FROM (SELECT content_hash AS digest, acquired AS captured FROM v_versions) GROUP BY 1")
def snapshot_dedup(spark, d):
    v = views.versions(spark, d).select(F.col("content_hash").alias("digest"), F.col("acquired").alias("captured"), "id")
    return versions.snapshots(v).select("digest", "captured")


@query("SELECT id, acquired FROM v_versions ORDER BY id DESC LIMIT 16")
def config_prune(spark, d):
    return versions.newest(views.versions(spark, d), 16).select("id", "acquired")


# Work queues

_NEEDING = f"""SELECT DISTINCT v.document_id FROM v_versions v JOIN v_documents d ON d.id = v.document_id WHERE d.status <> 'failed'
  AND NOT EXISTS (SELECT 1 FROM v_analysis a WHERE a.document_id = v.document_id AND a.version_id = v.id AND a.analysis_type = 'ocr' AND a.status = 'complete')
  AND NOT EXISTS (SELECT 1 FROM v_analysis a WHERE a.document_id = v.document_id AND a.version_id = v.id AND a.analysis_type = 'ocr' AND a.status = 'failed' AND a.created > {ANCHOR} - 43200)
  AND NOT EXISTS (SELECT 1 FROM v_analysis a WHERE a.document_id = v.document_id AND a.version_id = v.id AND a.analysis_type = 'ocr' AND a.status = 'pending' AND a.created > {ANCHOR} - 5400)"""


def _needing(spark, d):
    return work.needing_analysis(views.documents(spark, d), views.versions(spark, d), views.analysis(spark, d), "ocr", ANCHOR)


@query(f"SELECT count(*) AS n FROM ({_NEEDING})")
def needing_analysis_count(spark, d):
    return _needing(spark, d).agg(F.count("*").alias("n"))


@query(f"SELECT document_id FROM ({_NEEDING}) WHERE document_id > '20' ORDER BY 1 LIMIT 100")
def needing_analysis_page(spark, d):
    return browse.after(_needing(spark, d), "20", 100, "document_id")


@query(
    """SELECT document_id, max(id) AS version_id FROM v_versions v WHERE document_id IN (SELECT id FROM v_documents WHERE status IN ('indexed', 'ocr_complete')) GROUP BY 1
    HAVING NOT EXISTS (SELECT 1 FROM v_analysis a WHERE a.document_id = v.document_id AND a.version_id = max(v.id) AND a.analysis_type = 'ner' AND a.status = 'complete')"""
)
def backfill_candidates(spark, d):
    return work.backfill(views.documents(spark, d), views.versions(spark, d), views.analysis(spark, d), "ner", ANCHOR).select("document_id", "version_id")


@query(
    f"""SELECT id, CASE WHEN retry_count + 1 >= 4 THEN 'exhausted' ELSE 'failed' END AS status, retry_count + 1 AS retry_count,
    {ANCHOR} + CASE WHEN retry_count + 1 >= 4 THEN 70 * 86400 ELSE CAST(pow(5, retry_count + 1) AS BIGINT) * 60 END AS next_retry FROM v_crawl WHERE status IN ('failed', 'exhausted')"""
)
def retry_transition(spark, d):
    failed = views.crawl_urls(spark, d).filter(F.col("status").isin("failed", "exhausted"))
    return failed.select("id", work.fail(F.col("retry_count"), F.lit(4), F.lit(ANCHOR)).alias("s")).select("id", "s.*")


@query(f"SELECT id, url FROM v_crawl WHERE status = 'failed' AND next_retry <= {ANCHOR} AND retry_count > 0")
def retryable_urls(spark, d):
    return work.retryable(views.crawl_urls(spark, d), ANCHOR).select("id", "url")


@query("SELECT id, depth, discovered FROM v_crawl WHERE status = 'discovered' ORDER BY depth, discovered, id LIMIT 10")
def claim_urls(spark, d):
    return work.claim_urls(views.crawl_urls(spark, d), 10).select("id", "depth", "discovered")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN status IN ('failed', 'exhausted') THEN 'discovered' ELSE status END AS status FROM v_crawl) GROUP BY 1")
def reset_failed(spark, d):
    return stats.by(work.reset_failed(views.crawl_urls(spark, d)), "status")


@query(f"SELECT id, fetched FROM v_crawl WHERE status = 'fetched' AND fetched < {ANCHOR} - 5 * 86400 ORDER BY fetched, id LIMIT 40")
def urls_needing_refresh(spark, d):
    return views.crawl_urls(spark, d).filter((F.col("status") == "fetched") & (F.col("fetched") < ANCHOR - 5 * 86400)).orderBy("fetched", "id").limit(40).select("id", "fetched")


@query("SELECT id, fetched FROM v_crawl WHERE status = 'fetched' ORDER BY fetched DESC, id LIMIT 15")
def recent_downloads(spark, d):
    return views.crawl_urls(spark, d).filter("status = 'fetched'").orderBy(F.desc("fetched"), "id").limit(15).select("id", "fetched")


@query("SELECT id, CASE WHEN status = 'ocr_complete' THEN 'indexed' ELSE status END AS status FROM v_documents")
def finalize_documents(spark, d):
    return work.finalize(views.documents(spark, d)).select("id", "status")


@query("SELECT id, CASE WHEN status = 'indexed' THEN 'ocr_complete' ELSE status END AS status, CASE WHEN status <> 'indexed' THEN synopsis END AS synopsis FROM v_documents")
def reset_annotations(spark, d):
    return work.reset_annotations(views.documents(spark, d)).select("id", "status", "synopsis")


@query("SELECT id, status FROM v_documents WHERE status <> 'failed' UNION ALL SELECT id, 'pending' FROM v_documents WHERE status = 'failed' UNION ALL SELECT 'new', 'pending'")
def upsert_documents(spark, d):
    docs = views.documents(spark, d).select("id", "status")
    delta = docs.filter("status = 'failed'").withColumn("status", F.lit("pending")).unionByName(spark.createDataFrame([("new", "pending")], docs.schema))
    return work.upsert(docs, delta, ["id"])


@query("SELECT id, document_id FROM v_versions WHERE document_id NOT IN (SELECT id FROM v_documents WHERE status = 'failed')")
def delete_cascade(spark, d):
    gone = views.documents(spark, d).filter("status = 'failed'").select(F.col("id").alias("document_id"))
    return work.cascade({"versions": views.versions(spark, d)}, gone)["versions"].select("id", "document_id")


# Functions


@query(
    r"""SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/]*(/.*)$', 1) AS path, regexp_replace(url, '[0-9]+', '{N}', 'g') AS template,
    array_to_string(string_split(regexp_extract(url, '://([^/?#]+)', 1), '.')[-2:], '.') AS root FROM pages"""
)
def url_parts(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.template(u).alias("template"), urls.root_domain(urls.host(u)).alias("root"))


_LIST = " OR ".join(f"contains(lower(url), '{p}')" for p in urls.LISTING)


@query(f"SELECT page_id, {_LIST} AS listing FROM pages")
def listing_pages(spark, d):
    return read(spark, d, "pages").select("page_id", urls.is_listing(F.col("url")).alias("listing"))


@query(f"SELECT DISTINCT mime_type, {category('mime_type')} AS category FROM v_documents")
def mime_category(spark, d):
    return views.documents(spark, d).select("mime_type").distinct().withColumn("category", mime.category(F.col("mime_type")))


@query(
    """SELECT id, CASE WHEN file_size >= 1000000 THEN printf('%.1f MB', file_size / 1000000.0) WHEN file_size >= 1000 THEN printf('%.1f KB', file_size / 1000.0)
    ELSE file_size || ' B' END AS size FROM v_versions WHERE file_size % 100 <> 50"""
)
def file_sizes(spark, d):
    return views.versions(spark, d).filter("file_size % 100 <> 50").select("id", mime.format_size(F.col("file_size")).alias("size"))


@query(
    """SELECT id, substr(content_hash, 1, 2) || '/' || CASE WHEN original_filename IS NULL THEN document_id ELSE regexp_extract(original_filename, '^(.+)[.]', 1) END
    || '-' || substr(content_hash, 1, 8) || '.' || CASE WHEN original_filename IS NULL THEN regexp_extract(url, '[a-z]+$') ELSE regexp_extract(original_filename, '[a-z]+$') END AS path
    FROM v_versions JOIN (SELECT id AS did, source_url AS url FROM v_documents) d ON did = document_id"""
)
def storage_path(spark, d):
    docs = views.documents(spark, d).select(F.col("id").alias("document_id"), "source_url", "title")
    v = views.versions(spark, d).join(docs, "document_id")
    c = F.col
    return v.select("id", names.storage_path(c("content_hash"), c("mime_type"), c("original_filename"), F.lit(0), c("source_url"), c("title")).alias("path"))


@query("SELECT id, CAST(strptime(regexp_extract(original_filename, '[0-9]{8}'), '%Y%m%d') AS DATE)::VARCHAR AS day FROM v_versions WHERE original_filename IS NOT NULL")
def filename_dates(spark, d):
    return views.versions(spark, d).filter("original_filename IS NOT NULL").select("id", dates.in_name(F.col("original_filename"), 2025).cast("string").alias("day"))


@query(
    """SELECT event_id AS id, abs(date_diff('second', ts, TIMESTAMP '2024-01-15')) // 3600 > 24 AS published FROM events"""
)
def server_date_check(spark, d):
    ts = F.col("ts")
    return read(spark, d, "events").select(F.col("event_id").alias("id"), dates.server(F.date_trunc("second", ts), F.lit("2024-01-15 00:00:00").cast("timestamp")).isNotNull().alias("published"))


# Crawl


@query("SELECT page_id, count(*) AS links, min(pos) AS first FROM v_links WHERE NOT regexp_matches(link, '^(#|javascript:|mailto:|tel:)') AND link <> '' GROUP BY 1")
def link_extraction(spark, d):
    found = read(spark, d, "pages").select("page_id", urls.links(F.col("html")).alias("l"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("a"))
    return found.filter(F.size("l") > 0).select("page_id", F.size("l").cast("long").alias("links"), (F.array_position("a", F.get("l", F.lit(0))) - 1).alias("first"))


_BFS = """WITH RECURSIVE e AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS src, link AS dst FROM v_links),
  r AS (SELECT DISTINCT src AS node, 0 AS depth FROM e WHERE src LIKE 'm.%' UNION SELECT dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 3)
  SELECT node, min(depth) AS depth FROM r GROUP BY 1"""


@query()
def frontier_bfs_depth3(spark, d):
    table = views.links(spark, d).select(urls.host(F.col("url")).alias("src"), F.col("link").alias("dst")).distinct()
    return crawl.bfs(table.filter("src LIKE 'm.%'").select(F.col("src").alias("node")), table, 3)


SQL["frontier_bfs_depth3"] = _BFS.replace("WITH RECURSIVE", "WITH RECURSIVE v_links AS (" + sql("SELECT * FROM v_links") + "),", 1)


@query("SELECT template, count(*) AS n FROM (SELECT regexp_replace(url, '[0-9]+', '{N}', 'g') AS template FROM pages) GROUP BY 1 HAVING count(*) >= 2")
def url_templates(spark, d):
    return crawl.templates(read(spark, d, "pages").select("url"))


@query(
    r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^(.*?)(\d{1,9})(\D*)$', 1), '[0-9]+', '{N}', 'g') || '{N}' || regexp_extract(url, '^(.*?)(\d{1,9})(\D*)$', 3) AS template,
    CAST(regexp_extract(url, '^(.*?)(\d{1,9})(\D*)$', 2) AS BIGINT) AS value, page_id FROM (SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(.*?)(\d{1,9})(\D*)$'))),
    s AS (SELECT template, min(value) AS lo, max(value) AS hi FROM p GROUP BY 1 HAVING count(*) > 1)
    SELECT template, unnest(range(lo, hi + least(10, hi - lo) + 1)) AS value FROM s EXCEPT SELECT template, value FROM p"""
)
def pattern_gaps(spark, d):
    return crawl.gaps(read(spark, d, "pages").select("url"))


@query(
    """SELECT parent FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+)') || '/' || array_to_string(parts[1:n], '/') || '/' AS parent FROM
    (SELECT url, parts, unnest(range(1, len(parts))) AS n FROM (SELECT url, string_split(regexp_extract(rtrim(regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', ''), '/'), '^[a-z]+://[^/]*/(.*)$', 1), '/') AS parts FROM pages)))
    WHERE parent NOT IN (SELECT url FROM pages)"""
)
def parent_directories(spark, d):
    return crawl.parent_directories(read(spark, d, "pages").select("url"))


@query("SELECT 'https://' || host || '/' || p AS url FROM (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages), (SELECT unnest(['docs', 'foi/log']) AS p)")
def frontier_seeds(spark, d):
    bases = read(spark, d, "pages").select(F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/")).alias("base_url")).distinct()
    return crawl.seeds(bases, ["/docs", "foi/log"])


# Entities

_NEAR = f"2 * {geo.EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(latitude - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 20.0) / 2), 2))))"


@query(f"SELECT DISTINCT document_id FROM v_entities WHERE {_NEAR} <= 3000")
def near_location(spark, d):
    return geo.near(views.entities(spark, d), 10.0, 20.0, 3000.0)


@query("SELECT document_id FROM v_entities WHERE contains(normalized_text, 'nation_1') AND entity_type = 'location' INTERSECT SELECT document_id FROM v_entities WHERE contains(normalized_text, 'mach')")
def entity_and_search(spark, d):
    return geo.all_of(views.entities(spark, d), [("nation_1", "location", False), ("mach", None, False)])


@query("SELECT entity_type, count(*) AS n FROM v_entities GROUP BY 1")
def entity_type_counts(spark, d):
    return stats.by(views.entities(spark, d), "entity_type")


@query("SELECT entity_text, count(DISTINCT document_id) AS n_docs FROM v_entities WHERE entity_type = 'organization' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_entities(spark, d):
    return geo.top(views.entities(spark, d), "organization", 12)


@query("SELECT count(*) AS n FROM v_entities WHERE latitude IS NOT NULL")
def geocoded_count(spark, d):
    return views.entities(spark, d).filter("latitude IS NOT NULL").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT document_id FROM v_entities WHERE latitude > -22 AND latitude < 33 AND longitude > -101 AND longitude < 61")
def in_region(spark, d):
    ring = [[-101.0, -22.0], [61.0, -22.0], [61.0, 33.0], [-101.0, 33.0], [-101.0, -22.0]]
    region = spark.createDataFrame([("Middle", [ring])], "name string, rings array<array<array<double>>>")
    return geo.in_region(views.entities(spark, d), region, "middle")


# Export


@query("SELECT id, source_id, title, source_url, status, mime_type, coalesce(synopsis, '') AS synopsis, array_to_string(tags, ';') AS tags FROM v_documents ORDER BY updated DESC, id LIMIT 10000")
def export_rows(spark, d):
    return export.documents(views.documents(spark, d))


@query("SELECT id, synopsis, array_to_string(tags, ';') AS tags FROM (SELECT * FROM v_documents ORDER BY updated DESC, id LIMIT 60) WHERE synopsis IS NOT NULL OR len(tags) > 0")
def export_annotations(spark, d):
    return export.annotations(views.documents(spark, d), 60)


@query("""SELECT id, CASE WHEN contains(title, ',') OR contains(title, '"') OR contains(title, chr(10)) THEN '"' || replace(title, '"', '""') || '"' ELSE title END AS field FROM v_documents""")
def csv_quoting(spark, d):
    return views.documents(spark, d).select("id", export.quoted(F.col("title")).alias("field"))


# Streams, as batch queries


@query(
    """SELECT source_id, CAST(epoch(time_bucket(INTERVAL 60 SECOND, ts)) AS BIGINT) AS minute, count(DISTINCT url) AS urls FROM v_requests WHERE response_status = 403
    GROUP BY 1, 2 HAVING count(DISTINCT url) >= 1"""
)
def unique_403_window(spark, d):
    from .streaming import rate_limit

    return rate_limit.blocked_windows(views.requests(spark, d), 1)


# Lookups


@query("SELECT id, title, status FROM v_documents WHERE id IN ('3', '17', '29', 'none')")
def documents_batch(spark, d):
    return views.documents(spark, d).filter(F.col("id").isin("3", "17", "29", "none")).select("id", "title", "status")


@query("SELECT id, source_url FROM v_documents WHERE source_id = 'src3'")
def source_urls(spark, d):
    return views.documents(spark, d).filter("source_id = 'src3'").select("id", "source_url")


@query("SELECT d.id, max(v.id) AS version_id, count(*) AS n FROM v_documents d JOIN v_versions v ON v.document_id = d.id GROUP BY d.id")
def documents_with_versions(spark, d):
    held = views.versions(spark, d).groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "content_hash", "file_size"))).alias("versions"))
    return views.documents(spark, d).select("id").join(held, "id").select("id", F.array_max(F.transform("versions", lambda v: v["id"])).alias("version_id"), F.size("versions").cast("long").alias("n"))


@query("SELECT a.content_hash, a.document_id FROM v_versions a WHERE a.content_hash IN (SELECT content_hash FROM v_versions JOIN v_documents d ON d.id = document_id WHERE d.source_id = 'src3') AND a.document_id NOT IN (SELECT id FROM v_documents WHERE source_id = 'src3')")
def sources_by_hash(spark, d):
    """Documents of other sources that hold a hash of one source."""
    docs = views.documents(spark, d).select(F.col("id").alias("document_id"), "source_id")
    held = views.versions(spark, d).join(docs, "document_id")
    own = held.filter("source_id = 'src3'").select("content_hash").distinct()
    return held.filter("source_id <> 'src3'").join(own, "content_hash", "left_semi").select("content_hash", "document_id")


@query("SELECT id, url, status FROM v_crawl WHERE status IN ('failed', 'exhausted') ORDER BY id LIMIT 20")
def failed_urls(spark, d):
    return views.crawl_urls(spark, d).filter(F.col("status").isin("failed", "exhausted")).orderBy("id").limit(20).select("id", "url", "status")


@query("SELECT id, depth FROM v_crawl WHERE source_id = (SELECT min(source_id) FROM v_crawl) AND status IN ('discovered', 'fetching') ORDER BY depth, discovered, id LIMIT 20")
def pending_urls(spark, d):
    urls_ = views.crawl_urls(spark, d)
    first = urls_.agg(F.min("source_id")).first()[0]
    return crawl.claim_order(urls_, first, 20).select("id", "depth")


@query("SELECT document_id, version_id, analysis_type, created FROM v_analysis WHERE analysis_type = 'ner' AND status = 'complete' ORDER BY created DESC, document_id LIMIT 25")
def analysis_results(spark, d):
    found = views.analysis(spark, d).filter((F.col("analysis_type") == "ner") & (F.col("status") == "complete"))
    return found.orderBy(F.desc("created"), "document_id").limit(25).select("document_id", "version_id", "analysis_type", "created")


@query("SELECT analysis_type, status, count(*) AS n FROM v_analysis GROUP BY 1, 2")
def analysis_counts(spark, d):
    return stats.by(views.analysis(spark, d), "analysis_type", "status")


@query("SELECT id FROM v_documents WHERE manual_date IS NULL AND estimated_date IS NULL")
def needing_date_estimation(spark, d):
    return views.documents(spark, d).filter("manual_date IS NULL AND estimated_date IS NULL").select("id")


@query("SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) AS r, count(*) OVER () AS n FROM pages) WHERE (r - 1) % CAST(ceil(n / 20) AS BIGINT) = 0")
def url_sample(spark, d):
    return browse.sample(read(spark, d, "pages").select("page_id", "url"), [F.col("url").asc_nulls_last(), F.col("page_id").asc_nulls_last()], 20)


@query("SELECT document_id, entity_type, normalized_text FROM v_entities WHERE document_id = '5'")
def document_entities(spark, d):
    return views.entities(spark, d).filter("document_id = '5'").select("document_id", "entity_type", "normalized_text")


@query("SELECT document_id, string_agg(normalized_text, '|' ORDER BY entity_type, normalized_text) AS found FROM v_entities GROUP BY 1")
def entities_batch(spark, d):
    held = views.entities(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("entity_type", "normalized_text"))).alias("e"))
    return held.select("document_id", F.array_join(F.transform("e", lambda x: x["normalized_text"]), "|").alias("found"))


@query("SELECT DISTINCT document_id FROM v_entities WHERE latitude BETWEEN -22 AND 33 AND longitude BETWEEN -101 AND 61")
def near_region(spark, d):
    """Inside the region: no entity lies within a kilometre outside of its border."""
    ring = [[-101.0, -22.0], [61.0, -22.0], [61.0, 33.0], [-101.0, 33.0], [-101.0, -22.0]]
    region = spark.createDataFrame([("Middle", [ring])], "name string, rings array<array<array<double>>>")
    return geo.near_region(views.entities(spark, d), region, "middle", 1.0)


# Functions on driver tables


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_paths(spark, d):
    return read(spark, d, "events").select("event_id", web.json_value(F.col("props"), "k").cast("int").alias("k"))


@query("SELECT event_id, CASE WHEN json_extract(props, '$.z') IS NULL THEN 'https://api.example.org/' || CAST(json_extract(props, '$.k') AS VARCHAR) END AS url FROM events")
def api_item_urls(spark, d):
    return read(spark, d, "events").select("event_id", web.item_url(F.col("props"), "z", "https://api.example.org/{k}").alias("url"))


@query("SELECT id, CASE mime_type WHEN 'application/pdf' THEN '[pdf]' WHEN 'text/html' THEN '[htm]' WHEN 'text/plain' THEN '[txt]' WHEN 'message/rfc822' THEN '[eml]' WHEN 'application/zip' THEN '[zip]' WHEN 'application/vnd.ms-excel' THEN '[xls]' ELSE '[---]' END AS icon FROM v_documents")
def mime_icons(spark, d):
    return views.documents(spark, d).select("id", mime.icon(F.col("mime_type")).alias("icon"))


@query("SELECT id, mime_type AS guessed FROM v_documents")
def mime_from_url(spark, d):
    """The guess from the URL is the type that the URL was made from."""
    return views.documents(spark, d).select("id", mime.from_url(F.col("source_url")).alias("guessed"))


@query(r"""SELECT id, CASE WHEN n = '' THEN 'document' ELSE n END AS name FROM (SELECT id, substr(trim(trim(regexp_replace(title, '[/\\:*?"<>|\x00-\x1f\x7f]', '_', 'g')), '_'), 1, 100) AS n FROM v_documents)""")
def sanitized_names(spark, d):
    return views.documents(spark, d).select("id", names.sanitize(F.col("title")).alias("name"))


@query("SELECT page_id, translate(regexp_replace(string_split(url, '/')[-1], '[.]html$', ''), '_-', '  ') AS title FROM pages WHERE regexp_matches(url, '/[0-9]+([.]html)?$')")
def url_titles(spark, d):
    return read(spark, d, "pages").filter(F.col("url").rlike(r"/[0-9]+(\.html)?$")).select("page_id", urls.title(F.col("url")).alias("title"))


@query("SELECT page_id, link, CASE WHEN starts_with(link, '/') THEN regexp_extract(url, '^[a-z]+://[^/]+') || link ELSE link END AS target FROM v_links WHERE starts_with(link, '/') OR starts_with(link, 'http')")
def resolved_links(spark, d):
    table = views.links(spark, d).filter("link LIKE '/%' OR link LIKE 'http%'").filter("link NOT LIKE '//%'")
    return table.select("page_id", "link", urls.resolve(F.col("url"), F.col("link")).alias("target"))


@query("SELECT doc_id, strlen(cut) AS bytes, length(cut) AS chars FROM (SELECT doc_id, list_aggregate(list_filter(list_transform(range(1, 41), lambda n: substr(text, 1, n)), lambda t: strlen(t) <= 40), 'last') AS cut FROM documents WHERE strlen(text) > 40)")
def truncated_texts(spark, d):
    cut = read(spark, d, "documents").filter(F.octet_length("text") > 40).select("doc_id", discovery.truncate(F.col("text"), 40).alias("cut"))
    return cut.select("doc_id", F.octet_length("cut").cast("long").alias("bytes"), F.length("cut").cast("long").alias("chars"))


# Sources, from lines made of driver tables


@query("SELECT page_id, url FROM pages")
def cdx_rows(spark, d):
    """CDX answers of ten rows each, read back."""
    row = F.to_json(F.array(F.col("page_id").cast("string"), F.col("url"), F.lit("-")))
    answers = read(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 10)).agg(F.concat(F.lit('[["id","original","digest"],'), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("value"))
    fields = web.read_cdx(answers).select("fields").filter(F.element_at("fields", "digest").isNull())
    return fields.select(F.element_at("fields", "id").cast("long").alias("page_id"), F.element_at("fields", "original").alias("url"))


@query("SELECT DISTINCT url FROM pages")
def sitemap_rows(spark, d):
    line = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = read(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 25)).agg(F.array_join(F.collect_list(line), "\n").alias("xml"))
    return maps.select(F.explode(web.sitemap_urls(F.col("xml"))).alias("url")).distinct()


@query("SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def url_list_import(spark, d):
    pages = read(spark, d, "pages")
    lines = pages.filter("page_id % 3 <> 0").select(F.concat(F.lit("  "), "url").alias("value")).unionByName(spark.createDataFrame([("# list",), ("",), ("not a url",)], "value string"))
    return web.url_list(lines, pages.filter("page_id % 3 = 0").select("url"))[0]


@query(r"SELECT 'P' || c_custkey AS bates, 'V' || (c_nationkey % 3) AS volume, '\IMG\' || c_custkey || '.tif' AS file, c_custkey % 4 = 0 AS first_page FROM customer")
def opt_rows(spark, d):
    """OPT lines with a stale duplicate of every line in front."""
    key = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("P"), key, F.lit(",V"), (F.col("c_nationkey") % 3).cast("string"), F.lit(",\\IMG\\"), key, F.lit(".tif,"), F.when(F.col("c_custkey") % 4 == 0, "Y").otherwise(""), F.lit(",,,1"))
    base = read(spark, d, "customer").select((F.col("c_custkey") + 10**6).alias("line"), line.alias("value"), F.concat(F.lit("P"), key, F.lit(",old,x,,,,")).alias("stale"))
    return loadfiles.read_opt(base.select("line", "value").unionByName(base.select((F.col("line") - 10**6).alias("line"), F.col("stale").alias("value"))))


@query("SELECT 'https://h.example.org/' || c_custkey || '.tif' AS url, 'B' || c_custkey AS begin_bates FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 2 = 0 UNION ALL SELECT 'concordance://B' || c_custkey || '..E' || c_custkey, 'B' || c_custkey FROM customer WHERE c_custkey % 5 = 0")
def load_file_import(spark, d):
    """Records with and without a page file; known URLs are left out."""
    key = F.col("c_custkey").cast("string")
    dat = read(spark, d, "customer").select(F.concat(F.lit("B"), key).alias("begin_bates"), F.concat(F.lit("E"), key).alias("end_bates"), F.create_map(F.lit("name"), F.col("c_name")).alias("values"))
    opt = read(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.concat(F.lit("B"), key).alias("bates"), F.concat(F.lit("\\IMG\\"), key, F.lit(".tif")).alias("file"))
    known = read(spark, d, "customer").filter("c_custkey % 2 = 1").select(F.concat(F.lit("https://h.example.org/"), key, F.lit(".tif")).alias("url"))
    return loadfiles.load(dat, opt, known, "https://h.example.org").select("url", "begin_bates")


# State


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS status, max(event_id) AS last_heartbeat FROM events GROUP BY 1")
def service_heartbeats(spark, d):
    beats = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("last_heartbeat"))
    return work.heartbeat(beats.filter("last_heartbeat % 2 = 0"), beats.filter("last_heartbeat % 2 = 1"))


@query("SELECT id, source_url FROM v_documents WHERE status = 'indexed'")
def save_new_by_url(spark, d):
    """Found pages of unknown URLs become documents."""
    docs = views.documents(spark, d)
    found = docs.select("id", "source_url", F.lit("x").alias("content_hash"))
    new, _ = state.save_by_url(docs.filter("status <> 'indexed'"), views.versions(spark, d), found.withColumnRenamed("id", "found_id"))
    return new.select(F.col("found_id").alias("id"), "source_url")


from . import queries_lookups, queries_state, queries_texts  # noqa: E402, F401  they register their queries
