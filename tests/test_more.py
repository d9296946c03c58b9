"""Digests, discovery, ranked search, state tables, API walks."""

import pytest
from pyspark.sql import functions as F

from quillstack.functions import blake3, discovery
from quillstack.operators import geo, ranked, state
from quillstack.sources import api


def one(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_blake3(spark):
    assert blake3.digest(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.digest(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    # the specification's test inputs repeat the bytes 0..250
    data = bytes(i % 251 for i in range(3072))
    assert blake3.digest(data[:1024]) == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3.digest(data[:1025]) == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert blake3.digest(data) == "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2"
    assert one(spark, lambda x: blake3.blake3(x), "abc") == blake3.digest(b"abc")
    assert one(spark, lambda x: blake3.blake3(x), None) is None


def test_discovery(spark):
    assert one(spark, discovery.is_youtube, "https://youtu.be/x") is True
    assert tuple(one(spark, discovery.drive_id, "https://drive.google.com/drive/folders/AbC_1-2?x")) == ("folder", "AbC_1-2")
    assert tuple(one(spark, discovery.drive_id, "https://drive.google.com/file/d/XyZ/view")) == ("file", "XyZ")
    assert discovery.search_query("a.gov", "pdf", phrases=["x y"], terms=["z"], excluded=["q"]) == 'site:a.gov filetype:pdf "x y" z -q'
    for text, n, want in (("aéb", 2, "a"), ("aéb", 3, "aé"), ("abc", 9, "abc"), ("ééé", 5, "éé"), ("", 3, "")):
        assert one(spark, lambda x, n=n: discovery.truncate(x, n), text) == want
    urls = discovery.paths(spark.createDataFrame([("a",), ("b",)], "domain string"), ["/foia", "docs/"])
    assert {r["url"] for r in urls.collect()} == {"https://a/foia", "https://a/docs/", "https://b/foia", "https://b/docs/"}


def test_ranked_search(spark):
    pages = spark.createDataFrame([("1", 1, "The committee reported its findings on meetings."), ("1", 2, "No meeting."), ("2", 1, "Reports of the committee meeting, the committee meets."), ("3", 1, None)], "document_id string, page_number int, final_text string").withColumns({"ocr_text": F.lit(None).cast("string"), "pdf_text": F.lit(None).cast("string")})
    got = ranked.search(pages, "committees report meeting").collect()
    assert [(r["document_id"], r["page_number"]) for r in got] == [("2", 1), ("1", 1)]
    assert "<b>" in got[0]["headline"] and ranked.search(pages, "the of").count() == 0


def test_near_region(spark):
    region = spark.createDataFrame([("Box", [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]])], "name string, rings array<array<array<double>>>")
    points = spark.createDataFrame([("in", 5.0, 5.0), ("near", 10.5, 5.0), ("far", 30.0, 5.0), ("none", None, None)], "document_id string, latitude double, longitude double")
    assert {r[0] for r in geo.near_region(points, region, "BOX", 100).collect()} == {"in", "near"}


def test_state_tables(spark):
    history = spark.createDataFrame([(i, f"h{i}") for i in range(16)], "created int, hash string")
    more = state.add_config(history, spark.createDataFrame([(99, "new")], history.schema))
    assert more.count() == 16 and more.filter("hash = 'h0'").count() == 0
    assert state.add_config(history, spark.createDataFrame([(99, "h3")], history.schema)).count() == 16
    docs = spark.createDataFrame([("a", "text/html", "u1", None), ("b", "text/csv", "u2", "{}")], "id string, mime_type string, source_url string, metadata string")
    saved = {r["id"]: r["category_id"] for r in state.save(docs, docs.filter("id = 'a'").withColumn("mime_type", F.lit("image/png"))).collect()}
    assert saved == {"a": "images", "b": None}
    versions = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, document_id string, content_hash string")
    new, changed = state.save_by_url(docs, versions, spark.createDataFrame([("u1", "x"), ("u2", "z"), ("u3", "q")], "source_url string, content_hash string"))
    assert [r["source_url"] for r in new.collect()] == ["u3"] and [r["source_url"] for r in changed.collect()] == ["u2"]
    noted = state.set_annotation(docs, "ner", 2, F.lit("x"))
    assert state.needing_annotation(noted, "ner", 2).count() == 0 and state.needing_annotation(noted, "ner", 3).count() == 2
    assert state.add_versions(versions, spark.createDataFrame([("c", "w")], "document_id string, content_hash string")).agg({"id": "max"}).first()[0] > 2
    notes = spark.createDataFrame([("a", "s", ["t"])], "id string, synopsis string, tags array<string>")
    full = docs.withColumns({"synopsis": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>"), "status": F.lit("pending")})
    assert {(r["id"], r["synopsis"], r["status"]) for r in state.summarised(full, notes).collect()} == {("a", "s", "indexed"), ("b", None, "pending")}


def test_tables_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    state.copy_tables({"t": frame}, str(tmp_path))
    assert sorted(state.load_tables(spark, str(tmp_path), ["t"])["t"].collect()) == sorted(frame.collect())


def test_api_walks():
    pages = {1: [1, 2], 2: [3, 4], 3: [5]}
    assert list(api.paged(lambda u, p: {"d": {"items": pages.get(p["page"], [])}}, "u", "d.items", size=2)) == [1, 2, 3, 4, 5]
    answers = {None: {"i": [1], "next": "a"}, "a": {"i": [2], "next": "b"}, "b": {"i": [3], "next": "a"}}
    assert list(api.by_cursor(lambda u, p: answers[p.get("cursor")], "u", "i", "next")) == [1, 2, 3]
    tree = {"u": {"p": [{"id": 1}, {"id": 2}, {}]}, "c/1": ["x"], "c/2": {"y": 1}}
    assert list(api.nested(lambda u, p: tree[u], "u", "p", "id", "c/{id}")) == ["x", {"y": 1}]
    assert list(api.descend({"a": [{"b": [1, 2]}, {"b": [3]}, {}]}, ["a", "b"])) == [1, 2, 3]
    maps = {"r": "<sitemapindex><loc>s1</loc><loc>s2</loc><loc>r</loc>", "s1": "<loc>p1</loc>", "s2": "<loc>p2</loc><loc>p3</loc>"}
    assert list(api.walk_sitemaps(lambda u, p: maps[u], ["r"])) == ["p2", "p3", "p1"]
    assert api.conditional_headers(api.Seen("e")) == {"If-None-Match": "e"} and api.conditional_headers(None) == {}
    assert [api.fetched_state(s, b"x") for s in (200, 304, 500)] == ["fetched", "skipped", "failed"]
    assert api.pick_browser([], "d") is None and api.pick_browser(["b", "a"], "d", "round_robin", 3) == "b"
    assert len({api.pick_browser(["a", "b", "c"], "d.org") for _ in range(5)}) == 1


@pytest.mark.parametrize("n,left", [(1, 1), (1025, 1)])
def test_blake3_tree_shape(n, left):
    assert len(blake3.digest(b"x" * n)) == 64
