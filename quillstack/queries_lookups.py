"""Registered queries of lookups, results, statistics and exports, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import discovery, mime, names
from .operators import browse, export, geo, results, stats, versions, work
from .plans import views
from .plans.oracle import category
from .plans.views import ANCHOR
from .queries import query
from .session import read

# Documents and URLs


@query("SELECT id, title FROM v_documents WHERE source_url = (SELECT source_url FROM v_documents WHERE id = '17')")
def document_by_url(spark, d):
    docs = views.documents(spark, d)
    url = docs.filter("id = '17'").first()["source_url"]
    return docs.filter(F.col("source_url") == url).select("id", "title")


@query("SELECT w.id, w.id IN (SELECT id FROM v_documents) AS found FROM (SELECT unnest(['3', '17', 'none']) AS id) w")
def documents_exist(spark, d):
    wanted = spark.createDataFrame([("3",), ("17",), ("none",)], "id string")
    known = views.documents(spark, d).select("id", F.lit(True).alias("found"))
    return wanted.join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT id, url, status FROM v_crawl WHERE source_id = (SELECT min(source_id) FROM v_crawl) AND url = (SELECT min(url) FROM v_crawl WHERE source_id = (SELECT min(source_id) FROM v_crawl))")
def crawl_url(spark, d):
    """One URL of a source, by its compound key."""
    urls = views.crawl_urls(spark, d)
    source, url = urls.agg(F.min(F.struct("source_id", "url"))).first()[0]
    return urls.filter((F.col("source_id") == source) & (F.col("url") == url)).select("id", "url", "status")


@query("SELECT page_number, pdf_text, ocr_status FROM v_pages WHERE document_id = '5'")
def document_pages(spark, d):
    return views.pages(spark, d).filter("document_id = '5'").orderBy("page_number").select("page_number", "pdf_text", "ocr_status")


@query("SELECT page_number, pdf_text FROM v_pages WHERE document_id = '5' ORDER BY page_number LIMIT 20 OFFSET 1")
def document_page_window(spark, d):
    return results.page_window(views.pages(spark, d), "5", 1, 50).select("page_number", "pdf_text")


@query("SELECT count(*) AS n FROM v_pages WHERE contains(coalesce(final_text, ocr_text, pdf_text, ''), 'ing')")
def page_match_count(spark, d):
    return browse.count_page_matches(views.pages(spark, d), "ing")


@query("SELECT 'tag' AS by, id FROM (SELECT id FROM v_documents WHERE list_contains(tags, 'topic2') ORDER BY updated DESC, id LIMIT 9) UNION ALL SELECT 'type', id FROM (SELECT id FROM v_documents WHERE mime_type = 'application/pdf' ORDER BY updated DESC, id LIMIT 9) UNION ALL SELECT 'source', id FROM (SELECT id FROM v_documents WHERE source_id = 'src3' ORDER BY updated DESC, id LIMIT 9) UNION ALL SELECT 'all', id FROM (SELECT id FROM v_documents ORDER BY updated DESC, id LIMIT 9)")
def listed_documents(spark, d):
    """A tag comes before a type, a type before a source."""
    docs, v = views.documents(spark, d), views.versions(spark, d)
    asked = {"tag": {"tag": "topic2", "kind": "pdf", "source": "src3"}, "type": {"kind": "pdf", "source": "src3"}, "source": {"source": "src3"}, "all": {}}
    out = None
    for name, given in asked.items():
        part = browse.listed(docs, v, limit=9, **given).select(F.lit(name).alias("by"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT count(*) AS n FROM v_documents WHERE status IN ('pending', 'downloaded') AND mime_type = 'application/zip'")
def unprocessed_archives_count(spark, d):
    return browse.containers(views.documents(spark, d), views.versions(spark, d), "archive").agg(F.countDistinct("id").alias("n"))


@query("SELECT id, created FROM v_documents WHERE status IN ('pending', 'downloaded') AND mime_type = 'message/rfc822'")
def unprocessed_emails(spark, d):
    return browse.containers(views.documents(spark, d), views.versions(spark, d), "email").select("id", "created")


@query("SELECT DISTINCT content_hash, document_id FROM (SELECT document_id, arg_max(content_hash, id) AS content_hash FROM v_versions GROUP BY 1)")
def content_hashes(spark, d):
    return stats.latest(views.versions(spark, d), "content_hash").select("document_id", "content_hash")


@query("SELECT count(*) AS n FROM v_versions WHERE legacy_path IS NOT NULL")
def legacy_paths_count(spark, d):
    return views.versions(spark, d).filter("legacy_path IS NOT NULL").agg(F.count("*").alias("n"))


@query("SELECT max(id) AS id, arg_max(content_hash, id) AS hash FROM v_versions")
def latest_configuration(spark, d):
    v = views.versions(spark, d)
    return v.agg(F.max("id").alias("id"), F.max_by("content_hash", "id").alias("hash"))


@query("SELECT page, per_page, greatest(page - 1, 0) * per_page AS skip, CAST(ceil(doc_id / per_page) AS BIGINT) AS total_pages FROM (SELECT doc_id, least(greatest(doc_id % 7, 1), 100000) AS page, least(greatest(doc_id % 300, 1), 200) AS per_page FROM documents)")
def page_envelopes(spark, d):
    """Page numbers and sizes within their bounds, and the number of pages."""

    def envelope(total, page, size):
        number, per_page, offset = browse.paginate(page, size)
        return total, number, per_page, offset, browse.total_pages(total, per_page)

    ids = read(spark, d, "documents").select("doc_id")
    page = F.least(F.greatest(F.col("doc_id") % 7, F.lit(1)), F.lit(browse.MOST_PAGES))
    size = F.least(F.greatest(F.col("doc_id") % 300, F.lit(1)), F.lit(browse.MOST_PER_PAGE))
    assert envelope(450, 0, 900) == (450, 1, 200, 0, 3) and envelope(0, None, None) == (0, 1, 50, 0, 0)
    out = ids.select("doc_id", page.alias("page"), size.alias("per_page"))
    return out.select("page", "per_page", ((F.col("page") - 1) * F.col("per_page")).alias("skip"), F.ceil(F.col("doc_id") / F.col("per_page")).alias("total_pages"))


# Results


@query("SELECT w.image_hash, w.backend, arg_min(o.text, o.page_id) AS text FROM (SELECT DISTINCT image_hash, b AS backend FROM v_ocr, (SELECT unnest(['first', 'second', 'third']) AS b) WHERE page_id % 7 = 0) w LEFT JOIN (SELECT * FROM v_ocr WHERE text IS NOT NULL) o ON o.image_hash = w.image_hash AND o.backend = w.backend GROUP BY 1, 2")
def ocr_reuse(spark, d):
    """Texts that a backend gave for the same page image before."""
    held = views.ocr_results(spark, d)
    wanted = held.filter("page_id % 7 = 0").select("image_hash").distinct().withColumn("backend", F.explode(F.array(*[F.lit(b) for b in ("first", "second", "third")])))
    return results.reused(held, wanted)


@query("SELECT w.sha, w.blake, w.size, min(v.legacy_path) AS path FROM (SELECT content_hash AS sha, substr(content_hash, 2) AS blake, file_size + id % 2 AS size, id FROM v_versions) w LEFT JOIN v_versions v ON v.content_hash = w.sha AND v.file_size = w.size AND substr(v.content_hash, 2) = w.blake GROUP BY w.id, 1, 2, 3")
def existing_files(spark, d):
    """Stored files that agree in both digests and the size; every other wanted size is off by one."""
    v = views.versions(spark, d).withColumn("content_hash_blake3", F.substring("content_hash", 2, 64)).withColumnRenamed("legacy_path", "file_path")
    wanted = v.select(F.col("content_hash").alias("sha"), F.col("content_hash_blake3").alias("blake"), (F.col("file_size") + F.col("id") % 2).alias("size"))
    return versions.existing_file(v, wanted)


@query("SELECT page_id, text, backend FROM v_ocr WHERE document_id = '5' AND text IS NOT NULL AND backend = 'first'")
def page_results_by_type(spark, d):
    return views.ocr_results(spark, d).filter("document_id = '5' AND text IS NOT NULL AND backend = 'first'").select("page_id", "text", "backend")


@query("SELECT d.id AS document_id, EXISTS (SELECT 1 FROM v_results r WHERE r.document_id = d.id AND r.page_id IS NULL AND r.status = 'complete') AS found FROM v_documents d")
def documents_with_result(spark, d):
    return results.has_result(views.results(spark, d), views.documents(spark, d).select(F.col("id").alias("document_id")), "ocr")


@query("SELECT page_id, coalesce(bool_or(status = 'complete'), false) AS found FROM v_results WHERE page_id IS NOT NULL GROUP BY 1")
def pages_with_result(spark, d):
    held = views.results(spark, d)
    return results.has_result(held, held.filter("page_id IS NOT NULL").select("page_id").distinct(), "ocr", pages=True)


@query(
    """SELECT document_id, sha256(CASE WHEN coalesce(pages, '') <> '' THEN pages ELSE whole END) AS digest FROM (
    SELECT document_id, string_agg(result_text, chr(10) || chr(10) ORDER BY page_id) FILTER (WHERE page_id IS NOT NULL) AS pages, min(result_text) FILTER (WHERE page_id IS NULL) AS whole
    FROM v_results WHERE status = 'complete' AND result_text IS NOT NULL GROUP BY 1) WHERE coalesce(pages, '') <> '' OR whole IS NOT NULL"""
)
def combined_analysis_text(spark, d):
    return results.combined_text(views.results(spark, d), "ocr").select("document_id", F.sha2("text", 256).alias("digest"))


@query("SELECT page_id, 'first' AS backend, '' AS model, text, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new text ' || page_id ELSE pdf_text END AS text FROM (SELECT CAST(document_id AS BIGINT) * 100000 + page_number AS page_id, pdf_text FROM v_pages))")
def stored_ocr(spark, d):
    """Every third page's text is stored anew over the old."""
    pages = views.pages(spark, d).select((F.col("document_id").cast("long") * 100_000 + F.col("page_number")).alias("page_id"), F.lit("first").alias("backend"), F.lit(None).cast("string").alias("model"), F.col("pdf_text").alias("text"))
    empty = results.store(pages.limit(0).withColumn("chars", F.lit(0)).withColumn("words", F.lit(0)), pages)
    return results.store(empty, pages.filter("page_id % 3 = 0").withColumn("text", F.concat(F.lit("new text "), "page_id"))).select("page_id", "backend", "model", "text", F.col("chars").cast("long"), F.col("words").cast("long"))


# Entities


@query("SELECT document_id, entity_text, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude FROM v_entities WHERE latitude IS NOT NULL ORDER BY entity_text, document_id LIMIT 20 OFFSET 5")
def geocoded_page(spark, d):
    found = views.entities(spark, d).filter("latitude IS NOT NULL").orderBy("entity_text", "document_id").offset(5).limit(20)
    return found.select("document_id", "entity_text", "latitude", "longitude")


@query("SELECT DISTINCT document_id FROM v_entities WHERE contains(normalized_text, 'mach') AND entity_type = 'organization'")
def entity_filter(spark, d):
    return geo.matching(views.entities(spark, d), "MACH", "organization", exact=False)


@query(f"SELECT count(DISTINCT document_id) AS n FROM v_entities WHERE 2 * {geo.EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(latitude - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 20.0) / 2), 2)))) <= 3000")
def near_location_count(spark, d):
    return geo.near(views.entities(spark, d), 10.0, 20.0, 3000.0).agg(F.count("*").alias("n"))


@query(
    """SELECT e.document_id, coalesce(d.title, e.document_id) AS title, coalesce(d.source_id, '') AS source_id, e.n, e.matched FROM (
    SELECT document_id, count(*) AS n, string_agg(entity_type || ':' || entity_text, '|' ORDER BY entity_type, entity_text) AS matched FROM v_entities GROUP BY 1) e
    LEFT JOIN v_documents d ON d.id = e.document_id"""
)
def entity_results(spark, d):
    """Result rows of all documents with entities; a document that is gone keeps its id as title."""
    held = views.entities(spark, d)
    out = results.entity_results(held.select("document_id").distinct(), views.documents(spark, d), held)
    shown = F.array_join(F.transform("matched", lambda e: F.concat(e["entity_type"], F.lit(":"), e["entity_text"])), "|")
    return out.select("document_id", "title", "source_id", F.size("matched").cast("long").alias("n"), shown.alias("matched"))


@query("SELECT document_id, normalized_text, CASE WHEN n_regionkey = 1 THEN -1.0 ELSE CAST(n_nationkey AS DOUBLE) END AS latitude FROM v_entities JOIN nation ON lower(n_name) = normalized_text WHERE entity_type = 'location'")
def located_entities(spark, d):
    """Nations of one region are notable places, the others towns of which the larger of a name wins."""
    nation = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"))
    notable = nation.filter("r = 1").withColumn("latitude", F.lit(-1.0))
    towns = nation.select("name", F.upper("name").alias("ascii_name"), "latitude", "longitude", F.lit(9).alias("population"))
    towns = towns.unionByName(towns.withColumn("latitude", F.lit(-5.0)).withColumn("population", F.lit(2)))
    out = geo.located(views.entities(spark, d).filter("entity_type = 'location'"), notable, towns)
    return out.select("document_id", "normalized_text", "latitude")


@query("SELECT lower(n_name) AS name, CAST(max(n_nationkey) AS DOUBLE) AS latitude, max(n_nationkey) * 10 AS population FROM (SELECT n_name, n_nationkey FROM nation UNION ALL SELECT 'x' || n_name, n_nationkey FROM nation) GROUP BY 1")
def city_dimension(spark, d):
    """Names and plain names; of a name the most populous place."""
    key = F.col("n_nationkey")
    rows = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("x"), "n_name").alias("ascii_name"), key.cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), (key * 10).cast("long").alias("population"))
    small = rows.withColumn("latitude", F.lit(-9.0)).withColumn("population", F.lit(-1).cast("long"))
    return geo.cities(rows.unionByName(small)).select("name", "latitude", "population")


@query("SELECT n_name AS name, 'nation' AS type, 'N' || n_nationkey AS iso, 2 AS rings FROM nation")
def region_rows(spark, d):
    """Feature collections per region of the world; an older file's features of the same name lose."""
    key = F.col("n_nationkey").cast("string")
    ring = lambda x: f"[[{x},0],[{x},1],[9,1],[{x},0]]"
    feature = lambda iso, rings: F.concat(F.lit('{"properties":{"name":"'), "n_name", F.lit('","type":"nation","iso":"'), iso, F.lit('"},"geometry":{"type":"Polygon","coordinates":[' + ",".join(ring(i) for i in range(rings)) + "]}}"))
    nation = read(spark, d, "nation").select("n_regionkey", feature(F.concat(F.lit("N"), key), 2).alias("new"), feature(F.lit("old"), 1).alias("old"))
    file = lambda c, name: nation.groupBy("n_regionkey").agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list(c), ","), F.lit("]}")).alias("value")).select("value", F.lit(name).alias("file"))
    return geo.regions(file("new", "b").unionByName(file("old", "a"))).select("name", "type", "iso", F.size("rings").cast("long").alias("rings"))


@query("SELECT CASE entity_type WHEN 'file_number' THEN 'filenumber' ELSE entity_type END AS kind, count(*) AS n FROM v_entities GROUP BY 1")
def entity_kind_counts(spark, d):
    return geo.kinds(views.entities(spark, d))


# Statistics


@query("SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS days, string_agg(day, ',' ORDER BY day) AS listed FROM (SELECT CAST(coalesce(manual_date, estimated_date) AS VARCHAR) AS day, count(*) AS n FROM v_documents WHERE coalesce(manual_date, estimated_date) >= DATE '2022-06-01' GROUP BY 1)")
def timeline_envelope(spark, d):
    out = stats.timeline_envelope(stats.timeline(views.documents(spark, d), "2022-06-01"))
    return out.select("total", F.size("buckets").cast("long").alias("days"), F.array_join(F.transform("buckets", lambda b: b["day"]), ",").alias("listed"))


_TYPES = "SELECT 'types' AS section, mime_type AS key, count(*) AS n FROM (SELECT document_id, arg_max(mime_type, id) AS mime_type FROM v_versions GROUP BY 1) GROUP BY 2"


@query(f"SELECT 'documents' AS section, status AS key, count(*) AS n FROM v_documents GROUP BY 2 UNION ALL SELECT 'crawl', status, count(*) FROM v_crawl GROUP BY 2 UNION ALL {_TYPES}")
def system_status(spark, d):
    return stats.system(views.documents(spark, d), views.versions(spark, d), views.crawl_urls(spark, d))


@query(f"SELECT 'documents' AS section, status AS key, count(*) AS n FROM v_documents WHERE source_id = 'src3' GROUP BY 2 UNION ALL {_TYPES}")
def source_status(spark, d):
    """Counts of one source; the types stay those of all."""
    return stats.system(views.documents(spark, d), views.versions(spark, d), views.crawl_urls(spark, d), "src3")


@query(
    """SELECT s.source_id, coalesce(a.n, 0) AS documents, coalesce(b.fetched, 0) AS fetched, coalesce(b.pending, 0) AS pending, coalesce(b.failed, 0) AS failed FROM
    (SELECT DISTINCT source_id FROM v_documents UNION SELECT 'unused') s LEFT JOIN (SELECT source_id, count(*) AS n FROM v_documents GROUP BY 1) a ON a.source_id = s.source_id
    LEFT JOIN (SELECT source_id, count(*) FILTER (WHERE status = 'fetched') AS fetched, count(*) FILTER (WHERE status IN ('discovered', 'fetching')) AS pending, count(*) FILTER (WHERE status IN ('failed', 'exhausted')) AS failed FROM v_crawl GROUP BY 1) b ON b.source_id = s.source_id"""
)
def scraper_list(spark, d):
    docs = views.documents(spark, d)
    sources = docs.select("source_id").distinct().unionByName(spark.createDataFrame([("unused",)], "source_id string"))
    return stats.scrapers(sources, docs, views.crawl_urls(spark, d))


@query(f"SELECT old, new, count(*) AS n FROM (SELECT d.id, CASE WHEN d.doc_id % 4 = 0 THEN 'other' WHEN d.doc_id % 4 = 1 THEN NULL ELSE category_id END AS old, {category('m.mime_type')} AS new FROM v_documents d JOIN (SELECT document_id, arg_max(mime_type, id) AS mime_type FROM v_versions GROUP BY 1) m ON m.document_id = d.id) WHERE old IS DISTINCT FROM new GROUP BY 1, 2")
def category_remap(spark, d):
    """Half of the documents have an outdated category or none."""
    k = F.col("doc_id") % 4
    docs = views.documents(spark, d).withColumn("category_id", F.when(k == 0, "other").when(k == 1, F.lit(None)).otherwise(F.col("category_id")))
    return stats.remap(docs, views.versions(spark, d))


@query("SELECT user_id AS id, event_type AS service_type FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) WHERE event_type = (SELECT min(event_type) FROM events)")
def services_of_type(spark, d):
    from .operators import state

    beats = read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("service_type"))
    return state.services(beats, read(spark, d, "events").agg(F.min("event_type")).first()[0])


# Snapshots

_SNAP = "SELECT d.source_url AS url, v.acquired AS captured, CASE WHEN v.id % 4 <> 0 THEN v.content_hash END AS digest, v.id FROM v_versions v JOIN v_documents d ON d.id = v.document_id"


def _snapshots(spark, d):
    docs = views.documents(spark, d).select(F.col("id").alias("document_id"), F.col("source_url").alias("url"))
    v = views.versions(spark, d).join(docs, "document_id")
    return v.select("url", F.col("acquired").alias("captured"), F.when(F.col("id") % 4 != 0, F.col("content_hash")).alias("digest"), "id")


@query(f"SELECT id FROM ({_SNAP}) WHERE digest IS DISTINCT FROM (SELECT min(content_hash) FROM v_versions)")
def different_snapshots(spark, d):
    known = views.versions(spark, d).agg(F.min("content_hash")).first()[0]
    return versions.differing(_snapshots(spark, d), known).select("id")


@query(f"SELECT url, max(captured) AS last, arg_max(id, captured) AS last_id, min(captured) AS first, arg_min(id, captured) AS first_id FROM ({_SNAP}) GROUP BY 1")
def snapshot_ends(spark, d):
    s = _snapshots(spark, d)
    last = versions.extreme(s).select("url", F.col("captured").alias("last"), F.col("id").alias("last_id"))
    return last.join(versions.extreme(s, last=False).select("url", F.col("captured").alias("first"), F.col("id").alias("first_id")), "url")


@query(f"SELECT a.id, coalesce(a.digest = b.content_hash, false) AS same FROM ({_SNAP}) a JOIN v_versions b ON b.id = a.id")
def same_contents(spark, d):
    """Digests agree only if both are known."""
    own = views.versions(spark, d).select("id", "content_hash")
    return _snapshots(spark, d).join(own, "id").select("id", versions.same_content(F.col("digest"), F.col("content_hash")).alias("same"))


@query(f"SELECT url, captured, digest, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS service FROM ({_SNAP}) WHERE url LIKE '%7.%'")
def merged_snapshots(spark, d):
    """Two archives asked for some URLs."""
    from .sources import progress

    s = _snapshots(spark, d)
    wanted = s.select("url").filter("url LIKE '%7.%'")
    return progress.all_snapshots([progress.TableArchive("even", s.filter("id % 2 = 0")), progress.TableArchive("odd", s.filter("id % 2 = 1"))], wanted)


# Export


@query(
    """SELECT d.id, source_id, title, source_url, status, coalesce(synopsis, '') AS synopsis, array_to_string(tags, ';') AS tags, v.mime_type, coalesce(v.file_size, 0) AS file_size, v.content_hash,
    strftime(to_timestamp(created) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(to_timestamp(updated) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS updated_at
    FROM (SELECT * FROM v_documents ORDER BY updated DESC, id LIMIT 10000) d LEFT JOIN (SELECT document_id, arg_max(mime_type, id) AS mime_type, arg_max(file_size, id) AS file_size, arg_max(content_hash, id) AS content_hash FROM v_versions GROUP BY 1) v ON v.document_id = d.id"""
)
def export_csv(spark, d):
    return export.csv(export.records(views.documents(spark, d), views.versions(spark, d), include_text=True))


@query("SELECT id, sha256(extracted_text) AS text, len(tags) AS tags, v.file_size FROM (SELECT * FROM v_documents ORDER BY updated DESC, id LIMIT 70) d JOIN (SELECT document_id, arg_max(file_size, id) AS file_size FROM v_versions GROUP BY 1) v ON v.document_id = d.id")
def export_with_text(spark, d):
    out = export.records(views.documents(spark, d), views.versions(spark, d), 70, include_text=True)
    return out.select("id", F.sha2("extracted_text", 256).alias("text"), F.size("tags").cast("long").alias("tags"), "file_size")


@query("SELECT 'new' AS part, id FROM v_documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'known', id FROM v_documents WHERE doc_id % 3 = 0")
def copied_rows(spark, d):
    """Rows that a copy appends, and those that the target has."""
    docs = views.documents(spark, d).select("id", "doc_id", "title")
    new, known = export.copy(docs, docs.filter("doc_id % 3 = 0"), ["id"])
    return new.select(F.lit("new").alias("part"), "id").unionByName(known.select(F.lit("known").alias("part"), "id"))


# Small functions over tables


@query("SELECT id, array_to_string(list_filter(list_transform(string_split(' ' || lang || ' ,, topic, x ,' || id, ','), lambda x: trim(x)), lambda x: x <> '')[1:3], '|') AS parts FROM v_documents")
def comma_lists(spark, d):
    return views.documents(spark, d).select("id", F.array_join(discovery.listed(F.concat(F.lit(" "), "lang", F.lit(" ,, topic, x ,"), "id"), 3), "|").alias("parts"))


@query("SELECT page_id, regexp_full_match(regexp_extract(url, '/([^/]*)$', 1), '[A-Za-z0-9_]+') AS safe FROM pages")
def safe_identifiers(spark, d):
    return read(spark, d, "pages").select("page_id", names.identifier(F.regexp_extract("url", "/([^/]*)$", 1)).alias("safe"))


@query("SELECT id, mime_type IN ('application/pdf', 'application/vnd.ms-excel', 'text/html') AS document, mime_type IN ('application/pdf', 'text/plain', 'text/html') AS extractable, mime_type LIKE 'application/%' AS application, mime_type = 'text/html' AS html FROM v_documents")
def type_predicates(spark, d):
    m = F.col("mime_type")
    return views.documents(spark, d).select(
        "id", mime.is_document(m).alias("document"), mime.is_extractable(m).alias("extractable"),
        (mime.matches(F.lit("application/*"), m) & mime.matches(F.lit("*/*"), m)).alias("application"), mime.matches(F.lit("text/html"), m).alias("html"),
    )


@query("SELECT url FROM (SELECT DISTINCT url FROM pages) ORDER BY url LIMIT 30")
def distinct_urls(spark, d):
    return discovery.ordered(read(spark, d, "pages"), "url", 30)


@query(f"SELECT document_id, version_id FROM v_analysis WHERE analysis_type = 'ocr' AND NOT (status = 'pending' AND created > {ANCHOR} - 5400) UNION SELECT document_id, version_id FROM v_analysis WHERE analysis_type = 'ocr' AND status = 'pending' AND created > {ANCHOR} - 5400")
def analysis_claims(spark, d):
    """A claim on every result's version: one pending row each, that locks."""
    held = views.analysis(spark, d)
    ids = held.filter("analysis_type = 'ocr'").select("document_id", "version_id")
    return work.claim(held, ids, "ocr", ANCHOR).filter(f"analysis_type = 'ocr' AND status = 'pending' AND created = {ANCHOR}").select("document_id", "version_id")
