"""Registered queries of functions over texts, URLs, files and containers, each with its DuckDB SQL.

Where the tables hold nothing that a function looks for, a query puts varied
pieces beside the real texts; the SQL evaluates the same rules on both.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from . import backends
from .functions import blake3, dates, discovery, entities as ner, mime, names, terms, urls
from .operators import crawl, geo, ranked
from .plans import views
from .queries import QUERIES, SQL, query
from .session import read
from .sources import containers, html, loadfiles, web


def _texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Entities: real texts, and one sentence whose names change with the id

_PLACES = ner.STATES + ner.PLACES


def _sentence(key):
    of = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(key * k, F.lit(len(xs))) + 1).cast("int"))
    number = F.concat(F.lit("FOIA-2020-"), F.lpad(key.cast("string"), 5, "0"))
    return F.concat(
        F.lit(" Director John Q. Adams of the "), of(ner.AGENCIES, 1), F.lit(" and the "), of(ner.AGENCY_NAMES, 1), F.lit(" met Mary Jones in "), of(_PLACES, 1), F.lit(", then in "), of(_PLACES, 7),
        F.lit(". See "), number, F.when(key % 3 == 0, F.lit(" (SECRET//NOFORN).")).otherwise(F.lit(", MEMO No. 12-345.")),
    )


_PLANTED = f"""(SELECT doc_id, text || ' Director John Q. Adams of the ' || {_texts(ner.AGENCIES)}[doc_id % {len(ner.AGENCIES)} + 1] || ' and the ' || {_texts(ner.AGENCY_NAMES)}[doc_id % {len(ner.AGENCY_NAMES)} + 1]
  || ' met Mary Jones in ' || {_texts(_PLACES)}[doc_id % {len(_PLACES)} + 1] || ', then in ' || {_texts(_PLACES)}[doc_id * 7 % {len(_PLACES)} + 1] || '. See FOIA-2020-' || lpad(CAST(doc_id AS VARCHAR), 5, '0')
  || CASE WHEN doc_id % 3 = 0 THEN ' (SECRET//NOFORN).' ELSE ', MEMO No. 12-345.' END AS t FROM documents)"""
#: Letters beyond ASCII as a word character, which word borders of the SQL know.
_ASCII = "regexp_replace(t, '[^\\x00-\\x7F]', '_', 'g')"
_HELD = "list_filter({}, lambda n: contains(t, n))"
_SHOWN = "array_to_string(list_sort(list_distinct({})), '|')"
_WORDS = f"list_filter(list_distinct(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')), lambda w: list_contains({_texts(ner.AGENCIES)}, w))"
_STATES = f"list_filter({_texts(ner.STATES)}, lambda s: regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || s || '($|[^\\p{{L}}\\p{{N}}_])'))"
_NUMBERS = "flatten([" + ", ".join(f"list_transform(regexp_extract_all(a, '{p}', 1), lambda x: trim(x))" for p in ner.FILE_NUMBERS) + "])"


def _entities(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat("text", _sentence(F.col("doc_id"))).alias("t"))


def _shown(found):
    return F.array_join(F.sort_array(F.array_distinct(found)), "|")


@query(f"SELECT doc_id, {_SHOWN.format(f'list_concat({_WORDS}, {_HELD.format(_texts(ner.AGENCY_NAMES))})')} AS organizations, {_SHOWN.format(f'list_concat({_STATES}, {_HELD.format(_texts(ner.PLACES))})')} AS places, {_SHOWN.format(_NUMBERS)} AS marks FROM (SELECT *, {_ASCII} AS a FROM {_PLANTED})")
def entity_extraction(spark, d):
    """All kinds but persons, through the extractor's entry point."""
    found = _entities(spark, d).select("doc_id", ner.entities(F.col("t")).alias("e"))
    of = lambda kind: _shown(F.transform(F.filter("e", lambda x: x["type"] == kind), lambda x: x["text"]))
    return found.select("doc_id", of("organization").alias("organizations"), of("location").alias("places"), of("file_number").alias("marks"))


_GOOD = "list_filter({}, lambda n: len(regexp_split_to_array(n, '\\s+')) BETWEEN 2 AND 4 AND len(list_filter(regexp_split_to_array(n, '\\s+'), lambda p: strlen(p) < 2 OR NOT regexp_matches(p, '^[A-Z]'))) = 0)"
_TITLED = _GOOD.format(f"list_transform(regexp_extract_all(a, '{ner.TITLED}', 1), lambda x: trim(x))")
_PLAIN = _GOOD.format("list_transform(regexp_extract_all(a, '" + ner.CAPITALISED.replace("(?U)", "") + "', 1), lambda x: trim(x))")


@query(f"SELECT doc_id, {_SHOWN.format(f'list_concat({_TITLED}, list_filter({_PLAIN}, lambda n: NOT list_contains({_texts(ner.NOT_NAMES)}, n)))')} AS persons FROM (SELECT *, {_ASCII} AS a FROM {_PLANTED})")
def entity_persons(spark, d):
    return _entities(spark, d).select("doc_id", _shown(ner.persons(F.col("t"))).alias("persons"))


@query(f"SELECT doc_id AS document_id, 'organization' AS entity_type, lower(o) AS normalized_text FROM (SELECT doc_id, unnest(list_distinct(list_concat({_WORDS}, {_HELD.format(_texts(ner.AGENCY_NAMES))}))) AS o FROM {_PLANTED}) GROUP BY ALL")
def backfilled_entities(spark, d):
    """Extracted entities as unique rows."""
    found = backends.annotate_entities(_entities(spark, d).select(F.col("doc_id").alias("id"), F.col("t").alias("extracted_text")))
    return geo.materialise(found).filter("entity_type = 'organization'").select("document_id", "entity_type", "normalized_text")


# URLs in texts

_MARKS = "CASE page_id % 5 WHEN 0 THEN 'see (' || url || '). Or ' || url || '?a=(1),' WHEN 1 THEN '<' || url || '> https://www.google.com/x ' || url WHEN 2 THEN url || '/r.pdf), http://x.com HTTP://A.b.org/c.DOCX.' WHEN 3 THEN '[' || url || '] http://notx.com/q)).,' ELSE 'none' END"
_STEP = "substr(regexp_replace(u, '[.,]+$', ''), 1, length(regexp_replace(u, '[.,]+$', '')) - greatest(0, least(length(regexp_replace(regexp_replace(u, '[.,]+$', ''), '[^)]', '', 'g')) - length(regexp_replace(regexp_replace(u, '[.,]+$', ''), '[^(]', '', 'g')), length(regexp_extract(regexp_replace(u, '[.,]+$', ''), '(\\)*)$', 1)))))"
_CLEAN = f"list_distinct(list_transform(regexp_extract_all(t, '(?i)https?://[^\\s<>\\[\\]{{}}|\\\\^`\\x00-\\x1f\\x7f]+'), lambda x: list_reduce([x, '', '', '', '', '', ''], lambda u, k: {_STEP})))"
_FOUND = f"list_filter({_CLEAN}, lambda u: len(list_filter({_texts(urls.EXCLUDED)}, lambda e: lower(regexp_extract(u, '://([^/?#]+)', 1)) = e OR ends_with(lower(regexp_extract(u, '://([^/?#]+)', 1)), '.' || e))) = 0)"


def _marked(spark, d):
    u, k = F.col("url"), F.col("page_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("see ("), u, F.lit("). Or "), u, F.lit("?a=(1),"))).when(k == 1, F.concat(F.lit("<"), u, F.lit("> https://www.google.com/x "), u))
        .when(k == 2, F.concat(u, F.lit("/r.pdf), http://x.com HTTP://A.b.org/c.DOCX."))).when(k == 3, F.concat(F.lit("["), u, F.lit("] http://notx.com/q)).,"))).otherwise("none")
    )
    return read(spark, d, "pages").select("page_id", text.alias("t"))


@query(f"SELECT page_id, len({_FOUND}) AS n, array_to_string(list_sort({_FOUND}), ' ') AS found FROM (SELECT page_id, {_MARKS} AS t FROM pages)")
def url_finder(spark, d):
    """URLs in several kinds of brackets and ends; excluded domains and repeated URLs do not count."""
    found = _marked(spark, d).select("page_id", urls.found(F.col("t")).alias("f"))
    return found.select("page_id", F.size("f").cast("long").alias("n"), F.array_join(F.sort_array("f"), " ").alias("found"))


_KIND = "CASE regexp_extract(lower(regexp_replace(u, '[?#].*$', '')), '\\.([a-z]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mime.BY_SUFFIX.items()) + " END"


@query(f"SELECT page_id, u AS url, {_KIND} AS kind FROM (SELECT page_id, unnest({_FOUND}) AS u FROM (SELECT page_id, {_MARKS} AS t FROM pages)) WHERE {_KIND} IS NOT NULL")
def document_urls(spark, d):
    found = _marked(spark, d).select("page_id", F.inline(urls.typed(urls.found(F.col("t")))))
    return found.select("page_id", "url", "kind")


@query(f"SELECT CAST(page_id AS VARCHAR) AS document_id, len(list_filter({_FOUND}, lambda u: regexp_matches(lower(regexp_replace(u, '[?#].*$', '')), '\\.({'|'.join(mime.DOCUMENT_EXTENSIONS)})$'))) AS n FROM (SELECT page_id, {_MARKS} AS t FROM pages)")
def annotated_urls(spark, d):
    docs = _marked(spark, d).select(F.col("page_id").cast("string").alias("id"), F.col("t").alias("extracted_text"))
    return backends.annotate_urls(docs).select("document_id", F.col("n").cast("long").alias("n"))


# URL functions

_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"


@query(f"SELECT page_id, {_HOST} AS domain, 'https://' || {_HOST} AS base, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS bare, {_HOST} LIKE '%.example.net' AS below, array_to_string(string_split({_HOST}, '.')[-2:], '.') = 'example.net' AS allowed FROM pages")
def url_domains(spark, d):
    u = F.col("url")
    plain = mime.strip_url(u)
    return read(spark, d, "pages").select(
        "page_id", urls.domain(u).alias("domain"), urls.base(F.concat(urls.domain(u), F.lit("/"))).alias("base"), urls.base(plain).alias("bare"),
        (urls.is_subdomain(urls.host(u), ["example.net"]) & (urls.host(u) != "example.net")).alias("below"), urls.allowed(u, F.lit("https://www.example.net/")).alias("allowed"),
    )


@query("SELECT page_id, regexp_extract(url, '://[^/]*(/.*)$', 1) AS path, page_id % 8 = 1 OR page_id % 8 = 2 AS document, page_id % 8 IN (1, 2, 3) AS file FROM pages")
def url_extensions(spark, d):
    """Documents, other files and neither, by what ends the path."""
    k = F.col("page_id") % 8
    u = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(k == 1, ".PDF").when(k == 2, "/x.docx?y=1").when(k == 3, "/i.jpeg#z").otherwise(""))
    return read(spark, d, "pages").select("page_id", urls.path(F.col("url")).alias("path"), mime.has_document_extension(u).alias("document"), mime.has_file_extension(u).alias("file"))


@query(
    """SELECT page_id, CAST(round(1000 * least(1.0, least(1.0, least(1.0, 0.5 + CASE WHEN listing THEN 0.1 ELSE 0 END) + 0.05) + CASE WHEN page_id % 2 = 0 THEN 0.15 ELSE 0 END)) AS BIGINT) AS score,
    CAST(round(1000 * least(1.0, page_id % 10 / 10.0 + 0.2)) AS BIGINT) AS listing_score, CAST(round(1000 * greatest(0.0, least(1.0, page_id % 10 / 5.0 - 0.5))) AS BIGINT) AS clamped
    FROM (SELECT page_id, """ + " OR ".join(f"contains(lower(url), '{p}')" for p in urls.LISTING) + " AS listing FROM pages)"
)
def listing_scores(spark, d):
    title = F.when(F.col("page_id") % 2 == 0, "Documents by year").otherwise("A page")
    tenth = F.col("page_id") % 10
    whole = lambda c: F.round(c * 1000).cast("long")
    return read(spark, d, "pages").select(
        "page_id", whole(urls.listing_confidence(F.col("url"), title, F.lit(0.5))).alias("score"), whole(urls.as_listing(tenth / 10.0)).alias("listing_score"), whole(urls.clamped(tenth / 5.0 - 0.5)).alias("clamped"),
    )


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://blog.') THEN 'https://mirror.org/b/' || substr(url, 14) WHEN starts_with(url, 'https://') THEN 'http://' || substr(url, 9) ELSE url END AS url, starts_with(url, 'https://') AS rewritten FROM pages")
def via_rewrites(spark, d):
    """The first fitting prefix wins."""
    mapping = [("https://blog.", "https://mirror.org/b/"), ("https://", "http://"), ("https://blog.tion", "never")]
    return read(spark, d, "pages").select("page_id", urls.rewritten(F.col("url"), mapping).alias("r")).select("page_id", "r.url", "r.rewritten")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'folder' WHEN 1 THEN 'file' END AS kind, CASE WHEN page_id % 3 < 2 THEN 'k_' || page_id END AS id, page_id % 3 = 2 AS video FROM pages")
def special_urls(spark, d):
    key = F.concat(F.lit("k_"), F.col("page_id").cast("string"))
    k = F.col("page_id") % 3
    u = F.when(k == 0, F.concat(F.lit("https://drive.google.com/drive/u/0/folders/"), key, F.lit("?usp=x"))).when(k == 1, F.concat(F.lit("https://drive.google.com/file/d/"), key, F.lit("/view"))).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), key))
    return read(spark, d, "pages").select("page_id", discovery.drive_id(u).alias("d"), discovery.is_youtube(u).alias("video")).select("page_id", "d.kind", "d.id", "video")


_DOMAINS = f"(SELECT DISTINCT {_HOST} AS domain FROM pages)"


@query(f"""SELECT domain, 'site:' || domain || ' "' || p || '"' AS query FROM {_DOMAINS}, (SELECT unnest(['annual report', 'index of']) AS p) UNION ALL SELECT domain, 'site:' || domain || ' ' || t FROM {_DOMAINS}, (SELECT unnest(['budget', 'memo']) AS t) UNION ALL SELECT 'all', 'site:a.org filetype:pdf inurl:docs "x y" memo -draft'""")
def search_queries(spark, d):
    domains = read(spark, d, "pages").select(urls.host(F.col("url")).alias("domain")).distinct()
    one = discovery.search_query(site="a.org", filetype="pdf", inurl="docs", phrases=["x y"], terms=["memo"], excluded=["draft"])
    return crawl.domain_queries(domains, ["annual report", "index of"]).unionByName(discovery.site_queries(domains, ["budget", "memo"])).unionByName(spark.createDataFrame([("all", one)], "domain string, query string"))


@query(f"SELECT 'https://' || domain || p AS url, 'common_path' AS method, CAST(40 AS BIGINT) AS score FROM {_DOMAINS}, (SELECT unnest(['/docs', '/library', '/reports/all']) AS p)")
def common_paths(spark, d):
    domains = read(spark, d, "pages").select(urls.host(F.col("url")).alias("domain")).distinct()
    found = discovery.scored(discovery.paths(domains, ["docs", "/library", "reports/all"]), "common_path", 0.4)
    return found.select("url", "method", F.round(F.col("confidence") * 100).cast("long").alias("score"))


@query("SELECT page_id, 'https://web.example.org/cdx?url=' || replace(url_encode(regexp_replace(url, '[?#].*$', '') || '/*'), '%2A', '*') || '&output=json&fl=original,digest&matchType=prefix&collapse=digest&filter=statuscode:200&filter=!mimetype:text/html&from=2001&to=2020' || '&limit=5' AS query FROM pages")
def index_queries(spark, d):
    pattern = F.concat(mime.strip_url(F.col("url")), F.lit("/*"))
    of = lambda n: discovery.index_query("https://web.example.org/cdx", pattern, ["original", "digest"], "prefix", "digest", ["statuscode:200", "!mimetype:text/html"], "2001", "2020", n)
    assert read(spark, d, "pages").limit(5).filter(of(0).contains("limit")).count() == 0
    return read(spark, d, "pages").select("page_id", of(5).alias("query"))


@query("SELECT page_id, 'postgres://u' || page_id || ':***@db.example.org/x' AS url, 'https://plain.org/' || page_id AS other FROM pages")
def redacted_urls(spark, d):
    key = F.col("page_id").cast("string")
    u = F.concat(F.lit("postgres://u"), key, F.lit(":s3cr:et"), key, F.lit("@db.example.org/x"))
    return read(spark, d, "pages").select("page_id", urls.redact(u).alias("url"), urls.redact(F.concat(F.lit("https://plain.org/"), key)).alias("other"))


@query("SELECT page_id, 'https://web.example.org/' || strftime(ts, '%Y%m%d%H%M%S') || 'id_/' || url AS archived, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, page_id % 5 = 0 AS bad FROM pages JOIN events ON event_id = page_id")
def archive_urls(spark, d):
    """Capture stamps written and read back; every fifth stamp is broken."""
    both = read(spark, d, "pages").join(read(spark, d, "events").select(F.col("event_id").alias("page_id"), "ts"), "page_id")
    stamp = dates.to_cdx(F.col("ts"))
    broken = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x"), stamp)).otherwise(F.concat(stamp, F.lit("99")))
    return both.select(
        "page_id", dates.archive_url("https://web.example.org/", F.col("ts"), F.col("url"), raw=True).alias("archived"),
        F.date_format(dates.from_cdx(stamp), "yyyy-MM-dd HH:mm:ss").alias("at"), dates.from_cdx(broken).isNull().alias("bad"),
    )


# Files, digests, dates


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_digests(spark, d):
    return read(spark, d, "documents").select("doc_id", names.sha256(F.col("text").cast("binary")).alias("sha"))


@query()
def dual_digests(spark, d):
    """Both digests of the small tables' rows; BLAKE3 is beyond SQL and held to the specification's vectors in the tests."""
    name = F.col("n_name")
    return read(spark, d, "nation").select("n_nationkey", names.sha256(name.cast("binary")).alias("sha"), blake3.blake3(name).alias("blake"))


@query("SELECT id, '/files/' || legacy_path || CASE WHEN original_filename IS NOT NULL THEN '?filename=' || url_encode('a b+' || original_filename) ELSE '' END AS url FROM v_versions WHERE legacy_path IS NOT NULL")
def file_urls(spark, d):
    v = views.versions(spark, d).filter("legacy_path IS NOT NULL")
    return v.select("id", names.file_url(F.col("legacy_path"), F.concat(F.lit("a b+"), "original_filename")).alias("url"))


@query("SELECT id, CASE WHEN legacy_path IS NOT NULL AND id % 2 = 0 THEN '/data/old/' || document_id WHEN legacy_path IS NOT NULL THEN '/data/rel/' || document_id ELSE '/data/computed' END AS path FROM v_versions")
def resolved_paths(spark, d):
    """Old absolute paths, relative ones and none."""
    stored = F.when(F.col("legacy_path").isNotNull(), F.when(F.col("id") % 2 == 0, F.concat(F.lit("/srv/x"), "legacy_path")).otherwise(F.concat(F.lit("rel/"), "document_id")))
    return views.versions(spark, d).select("id", names.resolved("/data/", stored, F.lit("computed")).alias("path"))


_EXT = "CASE mime_type WHEN 'application/pdf' THEN 'pdf' WHEN 'text/html' THEN 'html' WHEN 'text/plain' THEN 'txt' WHEN 'application/vnd.ms-excel' THEN 'xls' WHEN 'application/zip' THEN 'zip' ELSE 'bin' END"


@query(f"SELECT id, '/c/' || substr(content_hash, 1, 2) || '/' || content_hash || '.' || {_EXT} AS plain, '/c/' || substr(content_hash, 1, 2) || '/a_b ' || document_id || '-' || substr(content_hash, 1, 8) || '.' || {_EXT} AS named FROM v_versions")
def content_paths(spark, d):
    h, e = F.col("content_hash"), names.content_extension(F.col("mime_type"))
    return views.versions(spark, d).select("id", names.content_path("/c/", h, e).alias("plain"), names.content_path("/c", h, e, F.concat(F.lit("a/b "), "document_id")).alias("named"))


_ALIASES = ("pdf", "TEXT", "email", "html", "xml", "Images", "data", "archives", "other", "none", "documents", "markup")


@query(f"SELECT k.id, CASE WHEN lower(k.id) IN ('pdf', 'text', 'email') THEN 'documents' WHEN lower(k.id) IN ('html', 'xml') THEN 'markup' WHEN lower(k.id) = 'none' THEN NULL ELSE lower(k.id) END AS category, count(*) AS n FROM documents, (SELECT unnest({_texts(_ALIASES)}) AS id) k GROUP BY 1")
def category_ids(spark, d):
    docs = read(spark, d, "documents").select(F.explode(F.array(*[F.lit(a) for a in _ALIASES])).alias("id"))
    return docs.groupBy("id", mime.category_from_id(F.col("id")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN acquired WHEN 1 THEN 0 WHEN 2 THEN acquired - 3600 ELSE 0 END AS required, id % 4 IN (0, 2) AS known FROM v_versions")
def parsed_times(spark, d):
    """RFC 3339 texts in UTC and with an offset, and broken ones."""
    iso = F.date_format(F.timestamp_seconds("acquired"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("id") % 4
    text = F.when(k == 0, F.concat(iso, F.lit(".25Z"))).when(k == 1, "yesterday").when(k == 2, F.concat(iso, F.lit("+01:00"))).otherwise(iso)
    return views.versions(spark, d).select("id", dates.parsed(text).cast("long").alias("required"), dates.parsed(text, required=False).isNotNull().alias("known"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN CAST(DATE '2019-05-06' AS VARCHAR) WHEN original_filename IS NOT NULL THEN CAST(CAST(strptime(regexp_extract(original_filename, '[0-9]{8}'), '%Y%m%d') AS DATE) AS VARCHAR) WHEN id % 3 = 1 THEN '2011-02-01' END AS date, CASE WHEN id % 3 = 0 THEN 'high' WHEN original_filename IS NOT NULL OR id % 3 = 1 THEN 'medium' END AS confidence FROM v_versions")
def detected_dates(spark, d):
    """Server dates, dates in names, dates in URL paths, none."""
    k = F.col("id") % 3
    sent = F.when(k == 0, F.lit("2019-05-06 07:00:00").cast("timestamp")).when(k == 1, F.timestamp_seconds(F.lit(0)))
    url = F.when(k == 1, "https://a.org/2011-02/x").otherwise("https://a.org/x")
    found = dates.detect(sent, F.timestamp_seconds("acquired"), F.coalesce("original_filename", F.lit("none")), url, 2025)
    return views.versions(spark, d).select("id", found.alias("f")).select("id", F.col("f.date").cast("string").alias("date"), "f.confidence")


# Lists, JSON, terms


@query("SELECT id, array_to_string(['memo', lang, 'fee waiver'], '|') AS tags FROM v_documents")
def model_tags(spark, d):
    """A model's tag answers, with a prefix, brackets, punctuation and one tag that is too long."""
    answer = F.concat(F.lit(' Tags: [Memo!, "'), F.upper("lang"), F.lit('", , Fee Waiver., '), F.repeat(F.lit("x"), 60), F.lit("]"))
    return views.documents(spark, d).select("id", F.array_join(terms.tags(answer), "|").alias("tags"))


@query("SELECT id, array_to_string(list_filter(['seed', lang, 'budget', id], lambda x, i: list_position(['seed', lang, 'budget', id], x) = i)[1:3], '|') AS merged FROM v_documents")
def merged_terms(spark, d):
    """Seeds, terms of a page and a model's terms, each once, three at most."""
    return views.documents(spark, d).select("id", F.array_join(discovery.union_terms(F.array(F.lit("Seed")), F.array("lang", F.lit("seed")), F.array(F.lit("BUDGET"), "lang", "id"), most=3), "|").alias("merged"))


@query("SELECT o_custkey AS c, o_orderkey AS o, CAST(l AS BIGINT) AS line FROM (SELECT o_custkey, o_orderkey, unnest(lines) AS l FROM (SELECT o_custkey, o_orderkey, list(l_linenumber) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2))")
def nested_items(spark, d):
    """Lines inside orders inside customers, taken out of nested JSON."""
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"))).alias("lines"))
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey")
    item = F.struct(F.col("o_orderkey").alias("o"), F.struct(F.col("lines").alias("items")).alias("page"))
    answers = orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(item).alias("orders"))).alias("item"))
    parents = web.descend(answers, "item", ["orders"]).withColumn("o", web.json_value(F.col("item"), "o").cast("long"))
    out = web.descend(parents, "item", ["page.items"])
    return out.select(F.col("o_custkey").alias("c"), "o", web.json_value(F.col("item"), "n").cast("long").alias("line"))


_STEM = lambda w: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({w}, '^(\\w{{2,}})ies$', '\\1y'), '^(\\w{{2,}}[^s])s$', '\\1'), '^(\\w{{3,}}?)(?:ing|edly|ed|ly)$', '\\1'), '^(\\w{{3,}})e$', '\\1')"
_LEX = f"list_transform(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains({_texts(terms.STOP_WORDS)}, w)), lambda w: {_STEM('w')})"


@query(f"SELECT document_id, page_number, CAST(round(1e6 * len(list_filter(lex, lambda w: w IN ('thing', 'nt'))) / (1 + ln(1.0 + len(lex)))) AS BIGINT) AS score FROM (SELECT document_id, page_number, {_LEX} AS lex FROM (SELECT document_id, page_number, coalesce(final_text, ocr_text, pdf_text, '') AS t FROM v_pages)) WHERE list_contains(lex, 'thing') AND list_contains(lex, 'nt') ORDER BY len(list_filter(lex, lambda w: w IN ('thing', 'nt'))) / (1 + ln(1.0 + len(lex))) DESC, document_id, page_number LIMIT 50")
def ranked_search(spark, d):
    """The best 50 pages with forms of both words."""
    return ranked.search(views.pages(spark, d), "things nt", 50).select("document_id", "page_number", F.round(F.col("rank") * 1e6).cast("long").alias("score"))


@query("SELECT document_id, page_number, CASE WHEN o > p + p // 5 THEN 'ocr' ELSE 'pdf' END AS best FROM (SELECT document_id, page_number, length(regexp_replace(pdf_text, '\\s', '', 'g')) AS p, CASE page_number % 3 WHEN 0 THEN 2 * length(regexp_replace(coalesce(ocr_text, ''), '\\s', '', 'g')) WHEN 1 THEN length(regexp_replace(coalesce(ocr_text, ''), '\\s', '', 'g')) ELSE length(regexp_replace(coalesce(ocr_text, ''), '\\s', '', 'g')) + 10 END AS o FROM v_pages)")
def page_merge(spark, d):
    """OCR texts that double the PDF's, equal it, or add ten characters, of all pages."""
    k = F.col("page_number") % 3
    pages = views.pages(spark, d).withColumn("ocr", F.when(k == 0, F.concat(F.coalesce("ocr_text", F.lit("")), F.lit(" "), F.coalesce("ocr_text", F.lit("")))).when(k == 1, F.col("ocr_text")).otherwise(F.concat(F.coalesce("ocr_text", F.lit("")), F.lit(" 0123456789"))))
    marked = pages.withColumn("pdf", F.concat(F.lit(" p"), "pdf_text")).withColumn("ocr", F.concat(F.lit("o"), F.coalesce("ocr", F.lit(""))))
    best = backends.best_page(F.regexp_replace("pdf", "^ p", ""), F.regexp_replace("ocr", "^o", ""))
    return marked.select("document_id", "page_number", F.when(best.eqNullSafe(F.regexp_replace("ocr", "^o", "")) & ~best.eqNullSafe(F.regexp_replace("pdf", "^ p", "")), "ocr").otherwise("pdf").alias("best"))


# HTML


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://' || {_HOST} || '/p/' || page_id WHEN 1 THEN 'https://' || {_HOST} || '/a/next?x=1&y=2' END AS next FROM pages")
def next_pages(spark, d):
    k = F.col("page_id") % 3
    key = F.col("page_id").cast("string")
    page = F.when(k == 0, F.concat(F.lit('<p class="pager-next"><a href="/no">x</a></p><div><a href="/x">1</a> <a rel="next" href="/p/'), key, F.lit('">n</a></div>')))
    page = page.when(k == 1, F.lit('<ul><li class="pager pager-next last"><a href="next?x=1&amp;y=2">more</a></li></ul>')).otherwise('<a rel="prev" href="/y">p</a><div class="pager-nextish"><a href="z">n</a></div>')
    base = F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/a/b"))
    return read(spark, d, "pages").select("page_id", html.next_page(page, base).alias("next"))


@query("SELECT page_id, n, CASE n WHEN 0 THEN url ELSE 'https://direct.org/' || page_id END AS url, CASE n WHEN 0 THEN 'Page ' || page_id END AS title FROM pages, (SELECT unnest([0, 1]) AS n)")
def search_hits(spark, d):
    """Result links with a redirect, without a title, and links that are no results."""
    key = F.col("page_id").cast("string")
    page = F.concat(F.lit('<div><a class="result__a x" href="//duckduckgo.com/l/?uddg='), F.url_encode("url"), F.lit('&amp;rut=1"> Page <b>'), key, F.lit('</b></a><a class="result__snippet" href="/s">s</a><a class="result__a" href="https://direct.org/'), key, F.lit('"> </a><a class="result__a" href="/rel">r</a></div>'))
    found = read(spark, d, "pages").select("page_id", F.posexplode(html.results(page)).alias("n", "r"))
    return found.select("page_id", "n", "r.url", "r.title")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages WHERE NOT regexp_matches(regexp_extract(html, '<title>([^<]*)</title>', 1), '&')")
def page_titles(spark, d):
    """The title comes first among the parts that name a page's subjects."""
    plain = read(spark, d, "pages").filter(~F.regexp_extract("html", "<title>([^<]*)</title>", 1).contains("&"))
    text = F.regexp_replace(html.terms_of(F.regexp_extract("html", "(?s)^(.*?</title>)", 1)), r"\s+", " ")
    return plain.select("page_id", F.btrim(text).alias("title"))


# Containers


def _zipped(names_, texts):
    """ZIP file of arrays of names and texts."""

    @F.pandas_udf("binary")
    def run(all_names: pd.Series, all_texts: pd.Series) -> pd.Series:
        import io
        import zipfile

        def one(ns, ts):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for n, t in zip(ns, ts):
                    z.writestr(n, t)
            return held.getvalue()

        return pd.Series([one(n, t) for n, t in zip(all_names, all_texts)])

    return run(names_, texts)


def _archives(spark, d):
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("__MACOSX/"), key, F.lit(".txt"))).when(key % 5 == 1, F.concat(F.lit("a/."), key)).when(key % 5 == 2, F.concat(F.lit("dir/"), key, F.lit(".PDF"))).otherwise(F.concat(key, F.lit(".dat")))
    rows = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("document_id"), name.alias("name"), F.col("c_name").alias("text"))
    held = rows.groupBy("document_id").agg(F.collect_list("name").alias("names"), F.collect_list("text").alias("texts"))
    return held.select("document_id", _zipped("names", "texts").alias("content"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS document_id, c_custkey || CASE WHEN c_custkey % 5 = 2 THEN '.PDF' ELSE '.dat' END AS filename, CASE WHEN c_custkey % 5 = 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type, strlen(c_name) AS file_size, CASE WHEN c_custkey % 5 = 2 THEN c_name END AS text FROM customer WHERE c_custkey % 5 >= 2")
def zip_members(spark, d):
    """Archives of customers per nation: hidden and resource-fork entries are left out, only known types are read."""
    found = containers.zip_files(_archives(spark, d), extract=True)
    return found.select("document_id", "filename", "mime_type", "file_size", F.col("content").cast("string").alias("text"))


def _spread(spark, frame):
    """``frame`` dealt out anew: a file of short rows is one partition, but each row may become a costly file."""
    return frame.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _mails(spark, d):
    key = F.col("c_custkey").cast("string")
    head = F.concat(F.lit("Subject: Case "), key, F.lit("\r\nFrom: a@b.org\r\nTo: c@d.org\r\nDate: Mon, 06 May 2019 07:00:00 +0000\r\nMIME-Version: 1.0\r\n"))
    plain = F.concat(head, F.lit("Content-Type: text/plain; charset=utf-8\r\n\r\nHello "), "c_name")
    page = F.concat(head, F.lit("Content-Type: text/html; charset=utf-8\r\n\r\n<style>x{}</style><p>Hello <b>"), "c_name", F.lit("</b></p>"))
    part = F.lit('\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="')
    mixed = F.concat(head, F.lit('Content-Type: multipart/mixed; boundary="B"\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nHello '), "c_name", F.lit("\r\n--B"), part, key, F.lit('.pdf"\r\n\r\ndata'), key, F.lit("\r\n--B--\r\n"))
    k = F.col("c_custkey") % 3
    rows = _spread(spark, read(spark, d, "customer").select("c_custkey", "c_name"))
    return rows.select(key.alias("document_id"), F.when(k == 0, plain).when(k == 1, page).otherwise(mixed).cast("binary").alias("content"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS document_id, 'Case ' || c_custkey AS subject, 'a@b.org' AS sender, 'Hello ' || c_name AS body, CASE WHEN c_custkey % 3 = 2 THEN c_custkey || '.pdf' ELSE '' END AS files, CAST(4 AS BIGINT) AS headers FROM customer")
def email_parts(spark, d):
    """Plain, HTML and mixed messages."""
    m = containers.emails(_mails(spark, d))
    return m.select("document_id", "subject", F.col("from").alias("sender"), F.btrim("body").alias("body"), F.array_join("attachments", ",").alias("files"), F.regexp_count("text", F.lit("(?m)^(Subject|From|To|Date): ")).cast("long").alias("headers"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS document_id, c_custkey || '.pdf' AS filename, 'application/pdf' AS mime_type, 'data' || c_custkey AS text FROM customer WHERE c_custkey % 3 = 2")
def email_attachments(spark, d):
    return containers.attachments(_mails(spark, d)).select("document_id", "filename", "mime_type", F.btrim(F.col("content").cast("string")).alias("text"))


@query("SELECT mime_type, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type FROM customer WHERE c_custkey % 5 >= 2 UNION ALL SELECT 'application/pdf' FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT 'text/plain' FROM customer) GROUP BY 1")
def virtual_files(spark, d):
    """Files inside archives and e-mails, and e-mail bodies."""
    files = _archives(spark, d).withColumn("mime_type", F.lit("application/zip")).unionByName(_mails(spark, d).withColumn("mime_type", F.lit("message/rfc822")))
    return containers.virtual_files(files).groupBy("mime_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS document_id, CASE c_custkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/zip' ELSE 'text/plain' END AS mime_type FROM customer")
def sniffed_types(spark, d):
    """Unknown and wrongly declared types are corrected; one of the same main type is kept."""
    k = F.col("c_custkey") % 4
    content = F.when(k == 0, F.lit("%PDF-1.4 x").cast("binary")).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 2, F.lit("%PDF-1.4").cast("binary")).otherwise(F.lit("plain").cast("binary"))
    declared = F.when(k == 0, mime.UNKNOWN).when(k == 1, "text/html").when(k == 2, "application/zip").otherwise("text/plain")
    files = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), declared.alias("mime_type"), content.alias("content"))
    return containers.types(files)


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, pos AS page_number, length(page) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def pdf_pages(spark, d):
    texts = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.replace(F.col("text"), F.lit("\n"), F.lit("\f")).alias("text"))
    return backends.pdf_pages(texts).select("document_id", "page_number", F.char_length("text").alias("chars"))


@query("SELECT 'B' || c_custkey AS begin_bates, CASE WHEN c_custkey % 3 = 0 THEN 'B' || c_custkey ELSE 'E' || c_custkey END AS end_bates, c_name AS name FROM customer")
def dat_rows(spark, d):
    """Load files of customers per nation, with the UTF-8 delimiter in some and the single byte in others; records without an end keep their begin."""
    one, sep = F.unhex(F.lit("FE")), F.unhex(F.lit("14"))
    quote = F.when(F.col("c_nationkey") % 2 == 0, one).otherwise(F.unhex(F.lit("C3BE")))
    cell = lambda c: F.concat(quote, c.cast("binary"), quote)
    key = F.col("c_custkey").cast("string")
    line = F.concat(cell(F.concat(F.lit("B"), key)), sep, cell(F.col("c_name")), sep, F.when(F.col("c_custkey") % 3 != 0, cell(F.concat(F.lit("E"), key))).otherwise(F.lit("").cast("binary")), F.lit("\r\n").cast("binary"))
    head = F.concat(cell(F.lit("Begin Bates")), sep, cell(F.lit("Name")), sep, cell(F.lit("End Bates")), F.lit("\r\n").cast("binary"))
    rows = read(spark, d, "customer").select("c_nationkey", line.alias("line"), head.alias("head"))
    files = rows.groupBy("c_nationkey").agg(F.first("head").alias("head"), F.array_join(F.collect_list(F.hex("line")), "").alias("body"))
    found = loadfiles.dat_records(files.select(F.col("c_nationkey").cast("string").alias("path"), F.concat("head", F.unhex("body")).alias("content")))
    return found.select("begin_bates", "end_bates", F.element_at("values", "Name").alias("name"))


@query(r"SELECT 'P' || c_custkey AS bates, CASE c_custkey % 5 WHEN 0 THEN '/r/IMG/' || c_custkey || '.tif' WHEN 1 THEN '/r/V1/IMG/' || c_custkey || '.tif' WHEN 2 THEN '/r/IMAGES/' || c_custkey || '.tif' WHEN 3 THEN '/r/' || c_custkey || '.tif' ELSE '/r/IMG/' || c_custkey || '.tif' END AS found FROM customer")
def resolved_page_files(spark, d):
    """Page files in each of the places where they may be, and nowhere."""
    key = F.col("c_custkey").cast("string")
    pages = read(spark, d, "customer").select(F.concat(F.lit("P"), key).alias("bates"), F.lit("V1").alias("volume"), F.concat(F.lit("\\IMG\\"), key, F.lit(".tif")).alias("file"))
    k = F.col("c_custkey") % 5
    place = F.when(k == 0, "/r/IMG/").when(k == 1, "/r/V1/IMG/").when(k == 2, "/r/IMAGES/").when(k == 3, "/r/").otherwise("/elsewhere/")
    listing = read(spark, d, "customer").select(F.concat(place, key, F.lit(".tif")).alias("path"))
    return loadfiles.resolve(pages, listing, "/r").select("bates", "found")


def _records(spark, d):
    """WARC records of pages: most are answers, some fail, some are requests, one in ten is empty."""
    k = F.col("page_id") % 10
    status = F.when(k == 1, "404 Not Found").when(k == 2, "206 Partial Content").otherwise("200 OK")
    body = F.when(k == 3, "").otherwise(F.concat(F.lit("body "), F.col("page_id").cast("string")))
    block = F.concat(F.lit("HTTP/1.1 "), status, F.lit("\r\nContent-Type: Text/HTML; charset=utf-8\r\nX: y\r\n\r\n"), body)
    kind = F.when(k == 4, "request").otherwise("response")
    at = F.concat(F.lit("2020-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("T00:00:00Z"))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Target-URI: <"), "url", F.lit(">\r\nWARC-Date: "), at, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))
    files = read(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 20).cast("string").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", record.alias("r")))), lambda x: x["r"]), "").cast("binary").alias("content"))
    return web.warc_rows(files)


@query("SELECT CASE WHEN page_id % 10 = 4 THEN 'not_response' WHEN page_id % 10 = 1 THEN 'status' WHEN page_id % 10 = 3 THEN 'empty' ELSE 'import' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def warc_reasons(spark, d):
    return _records(spark, d).select(F.coalesce(web.warc_reason(), F.lit("import")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT url, 'body ' || arg_min(page_id, (page_id % 9, CAST(page_id // 20 AS VARCHAR))) AS body, 'text/html' AS mime_type, CASE WHEN url LIKE 'https://%' THEN 'secure' WHEN url LIKE 'http://%.example.net/%' THEN NULL ELSE NULL END AS source_id FROM pages WHERE page_id % 10 NOT IN (1, 3, 4) AND url NOT IN (SELECT url FROM pages WHERE page_id % 7 = 0) GROUP BY url")
def warc_import(spark, d):
    """New answers, the first of a URL; sources by their base URL, of which the longest wins."""
    hosts = read(spark, d, "pages").select(urls.host(F.col("url")).alias("h")).distinct()
    sources = hosts.select(F.lit("secure").alias("source_id"), F.concat(F.lit("https://"), "h", F.lit("/")).alias("base_url")).unionByName(hosts.select(F.lit("any").alias("source_id"), F.concat(F.lit("https://"), "h").alias("base_url")))
    known = read(spark, d, "pages").filter("page_id % 7 = 0").select("url")
    out = web.load_warc(_records(spark, d), sources, known)
    return out.select("url", F.col("body").cast("string").alias("body"), "mime_type", "source_id")


@query("SELECT page_id, 2 AS n, 'https://' || regexp_extract(url, '://([^/?#]+)', 1) || '/sitemap.xml' AS first FROM pages")
def robots_sitemaps(spark, d):
    text = F.concat(F.lit("User-agent: *\r\nSITEMAP:  https://"), urls.host(F.col("url")), F.lit("/sitemap.xml \r\nDisallow: /\nsitemap:https://x.org/s2.xml"))
    found = read(spark, d, "pages").select("page_id", web.robots_sitemaps(text).alias("s"))
    return found.select("page_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"))


assert set(SQL) <= set(QUERIES)
