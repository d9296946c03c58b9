"""BLAKE3 over batches, HTML, progress files, kept results, pacing, storage modes, regions."""

import random

import pytest

from quillstack import cache
from quillstack.functions import blake3
from quillstack.operators import geo
from quillstack.sources import html, progress
from quillstack.streaming import rate_limit


def test_batches_of_digests_like_single_ones():
    rng = random.Random(1)
    values = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 5000, 7169, 10_000, 31_744)]
    assert blake3.digests(values) == [blake3.digest(v) for v in values]
    assert blake3.digests([]) == []
    assert blake3.digests([b""]) == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"]


def test_next_links_and_results():
    assert html.next_link(None, "http://a/") is None
    assert html.next_link('<a rel=next>x</a><a rel="next" href="?p=2">y</a>', "http://a.org/b?p=1") == "http://a.org/b?p=2"
    assert html.next_link('<div class="pager-next"></div><a href="z">out</a>', "http://a.org/") is None
    assert html.search_results('<a class="result__a">no target</a>') == []
    assert html.answer_url("//d.org/l/?uddg=&rut=1") is None
    assert html.field_text('<title>A</title><h1>B <a>C</a></h1><p>no</p><meta name="keywords" content="D">').split() == ["A", "B", "C", "D"]


def test_kept_results(spark):
    kept, made = cache.Kept(10), []

    def make(n=1):
        made.append(n)
        return spark.range(n)

    assert [kept.rows("a", t, make)[0]["id"] for t in (0, 9, 10, 15)] == [0] * 4 and len(made) == 2
    kept.drop("a")
    kept.rows("a", 16, make)
    assert len(made) == 3
    with pytest.raises(ValueError):
        kept.rows("b", 0, lambda: make(cache.MOST + 1))


def test_sources_and_modes(spark, tmp_path):
    table = spark.createDataFrame([(i, f"u{i}") for i in range(5)], "id long, url string")
    source = progress.TableSource("t", table, "id")
    assert [source.resume(spark, p).count() for p in (None, progress.Progress(2), progress.Progress(9))] == [5, 2, 0]
    assert progress.Progress(3).text() == '{"position": 3, "done": false, "error": null}'
    assert progress.storage_mode(str(tmp_path), str(tmp_path)) == "hard_link" and progress.storage_mode(str(tmp_path), "/no/such") == "copy"
    with pytest.raises(TypeError):
        progress.ImportSource()


def test_pacing_store():
    limits = rate_limit.RateLimits()
    assert limits.see("a", 0, 429, "u").delay == 1000 and limits.get("b").delay == rate_limit.BASE
    for k in range(3):
        limits.see("b", k, 403, f"u{k}")
    assert limits.get("b").delay == 1000 and len(limits.get("b").blocked) == 3
    limits.forget(100)
    assert limits.get("b").blocked == ()


def test_regions_of_one_name_count_together(spark):
    ring = lambda x: [[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0], [x, 0.0]]]
    regions = spark.createDataFrame([("Twin", "state", ring(0.0)), ("twin", "county", ring(5.0))], "name string, type string, rings array<array<array<double>>>")
    points = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.5, 5.5), ("c", 0.5, 3.0), ("d", None, None)], "document_id string, latitude double, longitude double")
    assert {r["document_id"] for r in geo.in_region(points, regions, "TWIN").collect()} == {"a", "b"}
    assert geo.in_region(points, regions, "none").collect() == []


def test_files_read_in_splits(spark, tmp_path):
    """DAT and WARC files in splits far smaller than they are give the rows of the whole-file readers."""
    from test_sources import _record

    from quillstack.sources import loadfiles, web

    q, sep = b"\xfe", b"\x14"
    cell = lambda x: q + x + q
    for k in range(2):
        rows = [cell(b"Begin Bates") + sep + cell(b"N%d" % k)] + [cell(b"A%d-%d" % (k, i)) + sep + cell(b"caf\xe9" * (i % 40)) for i in range(500)] + [b"", cell(b"") + sep]
        (tmp_path / f"{k}.dat").write_bytes(b"\r\n".join(rows))
    answer = lambda i: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"body \xff\r\n\r\nmore " * i
    (tmp_path / "a.warc").write_bytes(b"".join(_record("response", f"https://a.org/{i}", answer(i % 50)) for i in range(300)))
    inner = _record("response", "https://inner.org/", b"HTTP/1.1 200 OK\r\n\r\nx")
    (tmp_path / "n.warc").write_bytes(_record("response", "https://a.org/n", b"HTTP/1.1 200 OK\r\n\r\n" + inner + inner) + inner)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        dat = loadfiles.read_dat(spark, f"{tmp_path}/*.dat")
        assert dat.rdd.getNumPartitions() > 4
        files = spark.read.format("binaryFile").load(f"{tmp_path}/*.dat").select("path", "content")
        plain = lambda f: sorted((r["begin_bates"], r["end_bates"], sorted(r["values"].items())) for r in f.collect())
        assert plain(dat) == plain(loadfiles.dat_records(files)) and dat.count() == 1000
        warc = lambda f, **k: sorted((r["url"], r["type"], r["status"], bytes(r["body"])) for r in web.read_warc(spark, f"{tmp_path}/{f}", **k).collect())
        assert warc("a.warc") == warc("a.warc", whole=True) and len(warc("a.warc")) == 300
        assert "truncated" in {r[1] for r in warc("n.warc")} and {r[1] for r in warc("n.warc", whole=True)} == {"response"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
