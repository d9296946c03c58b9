"""Functions and operators on small worked inputs."""

import datetime as dt

from pyspark.sql import functions as F

from quillstack.functions import dates, entities, mime, names, terms, urls
from quillstack.operators import browse, crawl, export, geo, versions, work
from quillstack.streaming import rate_limit


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t(v)}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def t(value):
    return {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string", dt.datetime: "timestamp"}[type(value)]


def test_mime_guesses_and_categories(spark):
    cat = lambda m: one(spark, mime.category(F.col("m")), m=m)
    assert [cat(m) for m in ("text/html", "text/plain", "image/png", "text/csv", "application/zip", "x/y", None)] == ["markup", "documents", "images", "data", "archives", "other", "other"]
    assert cat("application/vnd.openxmlformats-officedocument.wordprocessingml.document") == "documents"
    assert cat("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet") == "data"
    assert one(spark, mime.from_url(F.col("u")), u="https://a.gov/x/Report.PDF?v=1#p") == "application/pdf"
    assert one(spark, mime.format_size(F.col("n")), n=1536000) == "1.5 MB"
    assert one(spark, mime.format_size(F.col("n")), n=999) == "999 B"
    assert [one(spark, mime.matches(F.col("p"), F.lit("image/png")), p=p) for p in ("*", "image/*", "image/png", "text/*")] == [True, True, True, False]
    assert one(spark, mime.category_from_id(F.col("p")), p="PDF") == "documents"


def test_urls(spark):
    assert one(spark, urls.title(F.col("u")), u="https://a.gov/x/annual_report-2020.pdf") == "annual report 2020"
    base = "https://a.gov/x/y.html?q=1"
    resolved = [one(spark, urls.resolve(F.lit(base), F.col("l")), l=x) for x in ("https://b.org/z", "//c.org/z", "/z", "z.pdf")]
    assert resolved == ["https://b.org/z", "https://c.org/z", "https://a.gov/z", "https://a.gov/x/z.pdf"]
    assert one(spark, urls.links(F.col("h")), h='<a href="/a"><a href="#x"><a href="mailto:q@r"><a href="b.pdf">') == ["/a", "b.pdf"]
    assert one(spark, urls.parents(F.col("u")), u="https://a.gov/x/y/z.pdf") == ["https://a.gov/x/y/", "https://a.gov/x/"]
    assert one(spark, urls.is_listing(F.col("u")), u="https://a.gov/browse/all") is True
    assert one(spark, urls.is_listing(F.col("u")), u="https://a.gov/browse/all.pdf") is False
    assert one(spark, urls.found(F.col("t")), t="See https://a.gov/x (and http://b.org/y_(z)). Or https://www.facebook.com/q, https://a.gov/x.") == ["https://a.gov/x", "http://b.org/y_(z)"]
    assert one(spark, urls.redact(F.col("u")), u="postgres://me:secret@h/db") == "postgres://me:***@h/db"
    assert one(spark, urls.rewrite(F.col("u"), [("https://a/", "https://b/")]), u="https://a/x") == "https://b/x"


def test_dates(spark):
    got = lambda name: one(spark, dates.in_name(F.col("n"), 2025).cast("string"), n=name)
    assert [got(x) for x in ("memo-2024-01-15.pdf", "01-15-2024.pdf", "x20240115y", "2024-03", "2024-13-40", "1899-01-01", None)] == ["2024-01-15", "2024-01-15", "2024-01-15", "2024-03-01", None, None, None]
    far, near = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9, 1)
    assert one(spark, dates.server(F.col("s"), F.col("a")).isNotNull(), s=far, a=near) is True
    assert one(spark, dates.server(F.col("s"), F.col("a")).isNotNull(), s=near, a=near + dt.timedelta(hours=24, minutes=59)) is False
    assert one(spark, dates.to_cdx(dates.from_cdx(F.col("s"))), s="20240115123456") == "20240115123456"
    assert one(spark, dates.from_cdx(F.col("s")).isNull(), s="2024") is True


def test_names(spark):
    assert one(spark, names.sanitize(F.col("n")), n=' _a/b:c"d_ ') == "a_b_c_d"
    assert one(spark, names.sanitize(F.col("n")), n="___") == "document"
    path = names.storage_path(F.lit("abcdef0123456789"), F.lit("application/pdf"), F.col("f"), F.lit(1), F.lit("https://a/x"), F.lit("T"))
    assert one(spark, path, f="Big Report.PDF") == "abc/Big Report-abcdef01.pdf"
    assert one(spark, path, f=None) == "abc/T-abcdef01.pdf"
    assert one(spark, names.file_url(F.lit("ab/x.pdf"), F.col("f")), f="a b.pdf") == "/files/ab/x.pdf?filename=a%20b.pdf"


def test_terms(spark):
    assert one(spark, terms.terms(F.col("x")), x="NASA Budget Memos; Audits | Inspections 1998") == ["nasa", "budget", "memos", "audits", "inspections"]
    assert one(spark, terms.terms(F.col("x")), x="its, nasa, or, memo, an") == ["nasa", "memo"]
    assert one(spark, terms.tags(F.col("x")), x="Tags: [Alpha, beta!, , GAMMA]") == ["alpha", "beta", "gamma"]


def test_entities(spark):
    found = lambda text: [(e["type"], e["text"]) for e in one(spark, entities.entities(F.col("x")), x=text)]
    assert found("An audit by the EPA went to the GAO, then to NASA.") == [("organization", "EPA"), ("organization", "GAO"), ("organization", "NASA")]
    people = [x for k, x in found("Senator Ruth Calder wrote to Mayor Peter Lang.") if k == "person"]
    assert {"Ruth Calder", "Peter Lang"} <= set(people)
    numbers = [x for k, x in found("Kept under EPA-XY12-34567A8-1, asked for as FOIA-2019-00456.") if k == "file_number"]
    assert numbers == ["EPA-XY12-34567A8-1", "FOIA-2019-00456"]
    assert ("file_number", "TOP SECRET//SCI") in found("Page one bears TOP SECRET//SCI in red.")
    assert found("From the GAO to the GAO, by way of the GAO.") == [("organization", "GAO")]
    assert not [x for k, x in found("New York harbour, West Virginia mines.") if k == "person"]
    assert {x for k, x in found("In West Virginia and Area 51") if k == "location"} == {"West Virginia", "Virginia", "Area 51"}
    assert found(None) == []


def test_paging():
    assert browse.paginate() == (1, 50, 0)
    assert browse.paginate(3, 500) == (3, 200, 400)
    assert browse.paginate(0, 0) == (1, 1, 0)
    assert browse.total_pages(101, 50) == 3


def test_sample_is_every_kth(spark):
    got = sorted(r["id"] for r in browse.sample(spark.range(100), "id", 10).collect())
    assert got == list(range(0, 100, 10))


def test_needing_analysis(spark):
    docs = spark.createDataFrame([("a", "indexed", "s"), ("b", "indexed", "s"), ("c", "failed", "s"), ("d", "pending", "s"), ("e", "pending", "s")], "id string, status string, source_id string")
    vs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "id long, document_id string").withColumn("mime_type", F.lit("x"))
    done = spark.createDataFrame([("a", 1, "ocr", "complete", 0), ("b", 2, "ocr", "failed", 100_000 - 60), ("d", 4, "ocr", "failed", 0), ("e", 5, "ner", "complete", 0)], "document_id string, version_id long, analysis_type string, status string, created long")
    got = {r[0] for r in work.needing_analysis(docs, vs, done, "ocr", 100_000).collect()}
    assert got == {"d", "e"}
    claimed = work.claim(done, spark.createDataFrame([("d", 4)], "document_id string, version_id long"), "ocr", 100_000)
    assert {r[0] for r in work.needing_analysis(docs, vs, claimed, "ocr", 100_001).collect()} == {"e"}


def test_retry_states(spark):
    got = [one(spark, work.fail(F.col("n"), F.lit(3), F.lit(0)), n=n).asDict() for n in (0, 1, 2)]
    assert [(g["status"], g["next_retry"]) for g in got] == [("failed", 300), ("failed", 1500), ("exhausted", 70 * 86400)]


def test_upsert_is_null_safe(spark):
    table = spark.createDataFrame([("a", None, 1), ("b", "m", 2)], "k string, model string, v int")
    delta = spark.createDataFrame([("a", None, 5, 1), ("a", None, 6, 2), ("c", None, 7, 1)], "k string, model string, v int, at int")
    got = sorted((r["k"], r["v"]) for r in work.upsert(table, delta, ["k", "model"], "at").select("k", "v").collect())
    assert got == [("a", 6), ("b", 2), ("c", 7)]
    fresh = work.insert_new(table, spark.createDataFrame([("b", "m", 9), ("z", "m", 9), ("z", "m", 9)], table.schema), ["k"])
    assert fresh.count() == 3


def test_snapshots(spark):
    s = spark.createDataFrame([("d1", 5, "a"), ("d1", 3, "b"), (None, 1, "c"), (None, 2, "d")], "digest string, captured int, url string")
    assert sorted(r["url"] for r in versions.snapshots(s).collect()) == ["b", "c", "d"]


def test_crawl_pieces(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r["node"], r["depth"]) for r in crawl.bfs(spark.createDataFrame([("a",)], "node string"), edges, 2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    pages = spark.createDataFrame([("https://a/doc-1.pdf",), ("https://a/doc-4.pdf",)], "url string")
    assert sorted(r["value"] for r in crawl.gaps(pages).collect()) == [2, 3, 5, 6, 7]


def test_geo(spark):
    assert abs(one(spark, geo.haversine(F.lit(52.52), F.lit(13.405), F.lit(48.8566), F.lit(2.3522)), x=1) - 877.5) < 3
    shape = '{"features":[{"properties":{"name":"Box","type":"state","iso":"BX"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}}]}'
    region = geo.regions(spark.createDataFrame([(shape,)], "value string"))
    points = spark.createDataFrame([("in", 2.0, 2.0), ("hole", 5.0, 5.0), ("out", 20.0, 2.0)], "document_id string, latitude double, longitude double")
    assert [r[0] for r in geo.in_region(points, region, "box").collect()] == ["in"]


def test_entity_rows(spark):
    docs = spark.createDataFrame([("1", "The CIA in Berlin. The CIA.")], "document_id string, x string").select("document_id", entities.entities(F.col("x")).alias("entities"))
    places = geo.cities(spark.createDataFrame([("Berlin", "Berlin", 1.0, 2.0, 10), ("Berlin", "Berlin", 52.5, 13.4, 3_000_000)], "name string, ascii_name string, latitude double, longitude double, population long"))
    got = {r["entity_text"]: r["latitude"] for r in geo.materialise(docs, places).collect()}
    assert got == {"CIA": None, "Berlin": 52.5}


def test_csv_quoting(spark):
    assert [one(spark, export.quoted(F.col("x")), x=x) for x in ("a", "a,b", 'a"b', "a\rb")] == ["a", '"a,b"', '"a""b"', "a\rb"]


def test_pace():
    p = rate_limit.Pace()
    p.see(0, 429, "u")
    assert p.delay == 1000 and p.in_backoff
    for i in range(5):
        p.see(i, 200, "u")
    assert p.delay == 800 and p.in_backoff
    for i, u in enumerate("abc"):
        p.see(10 + i, 403, u)
    assert p.delay == 1600
    q = rate_limit.Pace()
    for i, u in enumerate("abc"):
        q.see(i * 50, 403, u)
    assert q.delay == 500
