"""The model views as DuckDB common table expressions, written apart from the Spark views."""

from __future__ import annotations

from .views import ANCHOR, EXTENSIONS, MIMES, PAGE_STATUSES, START, STATUSES, URL_STATUSES


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def bucket(key: str, salt: str, k: int) -> str:
    return f"(ascii(substr(sha256({key} || '{salt}'), 1, 1)) % {k})"


def category(m: str) -> str:
    return f"""CASE WHEN {m} IN ('text/html','application/xhtml+xml','text/xml','application/xml') THEN 'markup'
    WHEN {m} = 'application/pdf' OR {m} LIKE '%word%' OR {m} LIKE '%rfc822%' OR {m} LIKE 'message/%' OR ({m} LIKE 'text/%' AND {m} <> 'text/csv') THEN 'documents'
    WHEN {m} LIKE 'image/%' THEN 'images' WHEN {m} LIKE '%spreadsheet%' OR {m} LIKE '%excel%' OR {m} IN ('text/csv','application/json') THEN 'data'
    WHEN {m} IN ('application/zip','application/x-zip','application/x-zip-compressed','application/x-tar','application/gzip','application/x-rar-compressed','application/x-7z-compressed') THEN 'archives'
    ELSE 'other' END"""


_ID = "CAST(doc_id AS VARCHAR)"
_PAGE = "CAST(page_id AS VARCHAR)"
VIEWS = {
    "v_documents": f"""
  SELECT {_ID} AS id, doc_id, source AS source_id, string_split(text, chr(10))[1] AS title,
    'https://' || source || '.example.org/files/' || {_ID} || '.' || {_list(EXTENSIONS)}[{bucket(_ID, "m", 6)} + 1] AS source_url,
    text AS extracted_text, lang, {_list(STATUSES)}[{bucket(_ID, "s", 5)} + 1] AS status,
    CASE WHEN {bucket(_ID, "y", 2)} = 1 THEN substr(string_split(text, chr(10))[1], 1, 60) END AS synopsis,
    CASE WHEN {bucket(_ID, "t", 4)} = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, 'topic' || CAST({bucket(_ID, "t", 4)} AS VARCHAR)] END AS tags,
    CASE WHEN {bucket(_ID, "d", 4)} = 0 THEN DATE '2023-01-01' + CAST(doc_id % 365 AS INTEGER) END AS manual_date,
    CASE WHEN {bucket(_ID, "e", 3)} <> 0 THEN DATE '2022-01-01' + CAST(doc_id % 365 AS INTEGER) END AS estimated_date,
    {_list(MIMES)}[{bucket(_ID, "m", 6)} + 1] AS mime_type, {category(f"{_list(MIMES)}[{bucket(_ID, 'm', 6)} + 1]")} AS category_id,
    {START} + doc_id * 60 AS created, {START} + doc_id * 60 + {bucket(_ID, "u", 16)} * 3600 AS updated
  FROM documents""",
    "v_versions": f"""
  SELECT doc_id * 10 + n AS id, id AS document_id, sha256(CASE WHEN n = last THEN extracted_text ELSE extracted_text || '#' || n END) AS content_hash,
    CAST(strlen(CASE WHEN n = last THEN extracted_text ELSE extracted_text || '#' || n END) AS BIGINT) AS file_size, mime_type, created + n * 7200 AS acquired,
    'report_' || replace(CAST(estimated_date AS VARCHAR), '-', '') || '.' || regexp_extract(source_url, '[a-z]+$') AS original_filename,
    CASE WHEN {bucket("id", "f", 4)} = 0 THEN '/old/' || id END AS legacy_path
  FROM (SELECT *, unnest(range(0, last + 1)) AS n FROM (SELECT *, {bucket("id", "v", 3)} AS last FROM v_documents))""",
    "v_pages": f"""
  SELECT {_ID} AS document_id, pos AS page_number, line AS pdf_text, CASE WHEN (pos - 1) % 3 <> 0 THEN line || ' ' END AS ocr_text,
    CASE WHEN (pos - 1) % 7 = 0 THEN line END AS final_text, {_list(PAGE_STATUSES)}[(doc_id + pos - 1) % 5 + 1] AS ocr_status
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
    "v_analysis": f"""
  SELECT document_id, version_id, analysis_type, CASE WHEN k <= 2 THEN 'complete' WHEN k <= 4 THEN 'failed' ELSE 'pending' END AS status,
    CAST({ANCHOR} - {bucket("document_id || analysis_type", "h", 16)} * 2 * 3600 AS BIGINT) AS created
  FROM (SELECT *, {bucket("document_id || analysis_type", "a", 8)} AS k
    FROM (SELECT document_id, max(id) AS version_id, unnest(['ocr', 'ner']) AS analysis_type FROM v_versions GROUP BY document_id)) WHERE k < 6""",
    "v_crawl": f"""
  SELECT page_id AS id, url, regexp_extract(url, '([a-z-]+\\.example\\.[a-z]+)', 1) AS source_id, {_list(URL_STATUSES)}[{bucket(_PAGE, "s", 6)} + 1] AS status,
    len(string_split(url, '/')) - 3 AS depth, {START} + page_id * 30 AS discovered,
    CASE WHEN {bucket(_PAGE, "s", 6)} = 2 THEN {ANCHOR} - {bucket(_PAGE, "f", 16)} * 86400 - page_id END AS fetched,
    CASE WHEN {bucket(_PAGE, "s", 6)} IN (3, 4) THEN {bucket(_PAGE, "r", 4)} + 1 ELSE 0 END AS retry_count,
    CASE WHEN {bucket(_PAGE, "s", 6)} = 3 THEN {ANCHOR} + ({bucket(_PAGE, "n", 16)} - 8) * 600 END AS next_retry
  FROM pages""",
    "v_links": """
  SELECT page_id, url, pos - 1 AS pos, link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link,
    generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages)""",
    "v_requests": """
  SELECT event_id AS id, 'src' || CAST(user_id % 8 AS VARCHAR) AS source_id,
    'https://src' || CAST(user_id % 8 AS VARCHAR) || '.example.org/' || event_type || '/' || CAST(event_id % 50 AS VARCHAR) AS url, ts,
    [200, 200, 304, 403, 503][event_id % 5 + 1] AS response_status, CAST(floor(value * 10) AS BIGINT) AS duration_ms,
    event_id % 4096 AS response_size, CASE WHEN event_id % 50 = 7 THEN 'timeout' END AS error
  FROM events""",
    "v_entities": """
  SELECT DISTINCT CAST(c_custkey % 97 AS VARCHAR) AS document_id, ['person', 'organization', 'location', 'file_number'][c_custkey % 4 + 1] AS entity_type,
    CASE WHEN c_custkey % 4 = 2 THEN n_name ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || CAST(c_custkey % 23 AS VARCHAR) END AS entity_text,
    lower(CASE WHEN c_custkey % 4 = 2 THEN n_name ELSE c_mktsegment || ' ' || CAST(c_custkey % 23 AS VARCHAR) END) AS normalized_text,
    CASE WHEN c_custkey % 4 = 2 THEN c_nationkey * 5.0 - 60.0 END AS latitude, CASE WHEN c_custkey % 4 = 2 THEN c_nationkey * 13.0 - 150.0 END AS longitude
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
VIEWS["v_ocr"] = """
  SELECT CAST(document_id AS BIGINT) * 100000 + page_number AS page_id, document_id, page_number, CASE WHEN page_number % 2 = 0 THEN 'second' ELSE 'first' END AS backend,
    ocr_text AS text, sha256(pdf_text) AS image_hash FROM v_pages"""
VIEWS["v_results"] = """
  SELECT document_id, CAST(document_id AS BIGINT) * 100000 + page_number AS page_id, 'ocr' AS analysis_type, ocr_text AS result_text,
    CASE WHEN ocr_status IN ('ocr_complete', 'text_extracted') THEN 'complete' ELSE 'failed' END AS status FROM v_pages
  UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'ocr', 'whole ' || doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'complete' END FROM documents"""
NEEDS = {"v_versions": ["v_documents"], "v_analysis": ["v_documents", "v_versions"], "v_ocr": ["v_pages"], "v_results": ["v_pages"]}


def sql(query: str) -> str:
    """``query`` with the views that it names in front of it."""
    named = [v for v in VIEWS if v in query]
    used = [v for v in VIEWS if v in named or any(v in NEEDS.get(n, []) for n in named)]
    return ("WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used) + "\n" if used else "") + query
