"""Sources on files written by the tests, and backends."""

import gzip
import io
import zipfile
from email.message import EmailMessage

from pyspark.sql import functions as F

from quillstack import backends
from quillstack.sources import containers, loadfiles, web


def test_dat_rows():
    assert loadfiles.fields(b"\xfeABC\xfe\x14\xfeDEF\xfe") == ["ABC", "DEF"]
    assert loadfiles.fields(b"\xc3\xbeABC\xc3\xbe\x14\xc3\xbeDEF\xc3\xbe\r\n") == ["ABC", "DEF"]
    assert loadfiles.fields(b"\xfeA\xfe\x14\xfe\xfe\x14\xfeC\xfe") == ["A", "C"]
    assert loadfiles.fields(b"\xfeA\xfe\x14\xfe\xfe\x14\xfeC\xfe", keep_empty=True) == ["A", "", "C"]


def test_dat_opt_import(spark, tmp_path):
    q = "þ"
    line = lambda *v: "\x14".join(f"{q}{x}{q}" for x in v)
    (tmp_path / "a.dat").write_bytes("\n".join([line("Begin Bates", "End Bates", "Title"), line("A1", "A3", "one"), line("A4", "A4", "two")]).encode())
    dat = loadfiles.read_dat(spark, str(tmp_path / "a.dat"))
    assert sorted((r["begin_bates"], r["end_bates"], r["values"]["Title"]) for r in dat.collect()) == [("A1", "A3", "one"), ("A4", "A4", "two")]
    lines = spark.createDataFrame([(1, r"A1,V1,\IMG\a1.tif,Y,,,3"), (2, "bad"), (3, r"A1,V1,\IMG\a1b.tif,Y,,,3")], "line int, value string")
    opt = loadfiles.read_opt(lines)
    known = spark.createDataFrame([("concordance://A4..A4",)], "url string")
    got = [r["url"] for r in loadfiles.load(dat, opt, known, "https://h/p").collect()]
    assert got == ["https://h/p/a1b.tif"]
    listing = spark.createDataFrame([("/r/IMAGES/a1b.tif",)], "path string")
    assert loadfiles.resolve(opt, listing, "/r").first()["found"] == "/r/IMAGES/a1b.tif"


def _record(kind, url, block):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=x\r\n\r\n<p>hi</p>"
    content = _record("request", "https://a.gov/x", b"GET /") + _record("response", "https://a.gov/x", ok) + _record("response", "https://a.gov/y", b"HTTP/1.1 404 No\r\n\r\nz") + _record("response", "https://a.gov/x", ok) + _record("response", "https://a.gov/e", b"HTTP/1.1 200 OK\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(content))
    records = web.read_warc(spark, str(tmp_path / "a.warc.gz"))
    reasons = sorted(str(r["why"]) for r in records.select(web.warc_reason().alias("why")).collect())
    assert reasons == ["None", "None", "empty", "not_response", "status"]
    sources = spark.createDataFrame([("s1", "https://a.gov/"), ("s2", "https://a.gov/x")], "source_id string, base_url string")
    got = web.load_warc(records, sources, spark.createDataFrame([], "url string")).collect()
    assert [(r["url"], r["source_id"], r["mime_type"], bytes(r["body"])) for r in got] == [("https://a.gov/x", "s2", "text/html", b"<p>hi</p>")]


def test_cdx_sitemap_robots(spark):
    cdx = spark.createDataFrame([('[["urlkey","mimetype"],["a","-"],["b","text/html"]]',), ('[["urlkey"]]',), ("",)], "value string")
    assert sorted((r["fields"]["urlkey"], r["fields"]["mimetype"]) for r in web.read_cdx(cdx).collect()) == [("a", None), ("b", "text/html")]
    one = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x")).alias("y")).first()["y"]
    assert one(web.sitemap_urls, "<loc>https://a?x=1&amp;y=2</loc><loc>https://b</loc>\n<loc> https://c </loc>") == ["https://a?x=1&y=2", "https://c"]
    assert one(web.robots_sitemaps, "User-agent: *\nSITEMAP: https://a/s.xml\r\n#x") == ["https://a/s.xml"]
    new, bad = web.url_list(spark.createDataFrame([("# c",), ("",), ("https://a/x",), ("https://a/x",), ("nope",)], "value string"), spark.createDataFrame([], "url string"))
    assert [r[0] for r in new.collect()] == ["https://a/x"] and [r[0] for r in bad.collect()] == ["nope"]
    item = '{"a":{"b":["u0","u1"]},"id":7}'
    assert one(lambda c: web.item_url(c, "a.b.1"), item) == "u1"
    assert one(lambda c: web.item_url(c, "z", "https://h/{id}"), item) == "https://h/7"


def test_containers(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/report.pdf", b"%PDF-1")
        z.writestr("__MACOSX/x", b"")
        z.writestr("a/.hidden", b"")
        z.writestr("b.bin", b"1")
    mail = EmailMessage()
    mail["Subject"], mail["From"] = "Hello", "a@b"
    mail.set_content("<p>Hi <b>you</b></p>", subtype="html")
    mail.add_attachment(b"x", maintype="application", subtype="pdf", filename="f.pdf")
    files = spark.createDataFrame([("z", bytearray(raw.getvalue())), ("bad", bytearray(b"nozip"))], "document_id string, content binary")
    got = sorted((r["document_id"], r["filename"] or "", r["error"] is not None, r["content"] is not None) for r in containers.zip_files(files, True).collect())
    assert got == [("bad", "", True, False), ("z", "b.bin", False, False), ("z", "report.pdf", False, True)]
    m = containers.emails(spark.createDataFrame([("m", bytearray(bytes(mail)))], "document_id string, content binary")).first()
    assert (m["subject"], m["body"], m["attachments"]) == ("Hello", "Hi you", ["f.pdf"])
    assert containers.corrected("application/octet-stream", b"%PDF-1.4") == "application/pdf"
    assert containers.corrected("application/zip", b"%PDF-1.4") == "application/zip"
    assert containers.corrected("text/html", b"%PDF-1.4") == "application/pdf"


def test_backends(spark):
    def shout(row):
        if row["extracted_text"] is None:
            raise ValueError("no text")
        return row["extracted_text"].upper() or None

    docs = spark.createDataFrame([("1", "a", "text/plain"), ("2", None, "text/html"), ("3", "", "text/x"), ("4", "z", "image/png")], "document_id string, extracted_text string, mime_type string")
    loud = backends.Backend("loud", "summary", shout, ("text/*",))
    got = {r["document_id"]: r["status"] for r in backends.apply(docs, loud, ["extracted_text"]).collect()}
    assert got == {"1": "complete", "2": "failed", "3": "no_result"}
    both = backends.apply(docs, loud, ["extracted_text"]).unionByName(backends.apply(docs, backends.REGISTRY["first_sentence"], ["extracted_text"]))
    assert {r["document_id"]: r["backend"] for r in backends.fallback(both, ["loud", "first_sentence"]).collect()} == {"1": "loud", "4": "first_sentence"}


def test_pace_stream(spark, data, tmp_path):
    from quillstack.plans import views
    from quillstack.streaming import rate_limit

    log = views.requests(spark, data).filter("id < 200").select("source_id", "ts", "response_status", "url")
    log.repartition(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = rate_limit.pace(stream).writeStream.format("memory").queryName("paces").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["source_id"]: r["delay_ms"] for r in spark.table("paces").collect()}
    want = {}
    for r in log.orderBy("ts", "url").collect():
        want.setdefault(r["source_id"], rate_limit.Pace()).see(r["ts"].timestamp(), r["response_status"], r["url"])
    assert got == {k: p.delay for k, p in want.items()}
