"""Findings on odd rows and larger tables, each with the rows that were wrong or slow."""

import pytest

from quillstack import queries
from quillstack.operators import browse


def test_sample_of_many_rows(spark):
    """Enough rows for borders of range partitions to differ from run to run."""
    frame = spark.range(60_000).selectExpr("id", "sha2(cast(id AS string), 256) AS url", "repeat('x', cast(id % 50 AS int)) AS other")
    got = {r["id"] for r in browse.sample(frame, "url", 20).collect()}
    order = [r["id"] for r in sorted(frame.select("id", "url").collect(), key=lambda r: r["url"])]
    assert got == set(order[::3000])


def test_url_sample_order(spark, tmp_path):
    """URLs that begin other URLs, none at all, and long or negative ids come in the order of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    long = 10**13
    pages = [(p, u) for u in ("http://a", "http://a\tb", "http://a\x01", "http://a b", None) for p in (long + 5, 10 * long, -3, -20, 7, 1)]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {tuple(r) for r in queries.QUERIES["url_sample"](spark, str(tmp_path)).collect()}
    want = {tuple(r) for r in con.sql(queries.SQL["url_sample"]).project("page_id, url").fetchall()}
    assert got == want and len(want) == 15


_ODD = [
    b"Subject: =?utf-8?q?caf=C3=A9?=\r\n x\r\nFrom: A <a@b.org>, c@d.org\r\nDate: Mon, 6 May 2019 07:00:00 -0400\r\n\r\nplain \xff",
    b"SUBJECT: twice\r\nsubject: second\r\nTo:\r\nDate: no date\r\n\r\n",
    b"Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=latin1\r\n\r\n<script>x</script><p>a&nbsp;\xe9</p>\r\n--B\r\nContent-Disposition: attachment; filename*=utf-8''n%20%C3%A9.pdf\r\nContent-Type: application/octet-stream\r\nContent-Transfer-Encoding: base64\r\n\r\nAAEC\r\n--B\r\nContent-Type: text/csv; name=\"t.csv\"\r\n\r\n1,2\r\n--B--\r\n",
    b"Content-Type: text/plain; charset=nothing\r\n\r\nx",
    b"Content-Type: ;;\r\nTo: " + b"a@b.org, " * 200 + b"\r\n\r\nlong",
    b"",
]


def test_mails_as_the_standard_policy_reads_them(monkeypatch):
    """Headers that are kept give what the standard policy gives, and equal ones are parsed once."""
    import email.headerregistry
    import email.policy

    from quillstack.sources import containers

    def tried(f, x):
        try:
            return f(x)
        except Exception as e:
            return repr(e)

    both = (containers.message, lambda c: list(containers.attached(containers.parsed(c))), lambda c: list(containers.inside_mail(c)))
    got = [[tried(f, x) for x in _ODD + _ODD] for f in both]
    monkeypatch.setattr(containers, "_POLICY", email.policy.default)
    assert got == [[tried(f, x) for x in _ODD + _ODD] for f in both]
    assert got[1][2][0]["filename"] == "n é.pdf" and [r["filename"] for r in got[2][2]] == ["n é.pdf", "t.csv", "body.txt"]
    monkeypatch.undo()
    parse, calls = email.headerregistry.ContentTypeHeader.value_parser, []
    monkeypatch.setattr(email.headerregistry.ContentTypeHeader, "value_parser", staticmethod(lambda v: calls.append(v) or parse(v)))
    for k in range(50):
        assert containers.message(b"Content-Type: text/plain; charset=ascii\r\nSubject: %d\r\n\r\nx" % k)["subject"] == str(k)
    assert len(calls) <= 1


def test_mails_are_dealt_out(spark, data):
    from quillstack import queries_texts

    assert queries_texts._mails(spark, data).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_broken_mails_and_archives(spark):
    """A broken file is an error row among whole ones; a broken body leaves the attachments."""
    from quillstack.sources import containers

    files = spark.createDataFrame([(str(k), bytearray(c)) for k, c in enumerate(_ODD)] + [("n", None)], "document_id string, content binary")
    errors = {r["document_id"]: r["error"] for r in containers.emails(files).collect()}
    assert set(errors) == {"0", "1", "2", "3", "4", "5", "n"} and errors["3"].startswith("LookupError") and errors["n"] and not errors["2"]
    assert {r["document_id"] for r in containers.zip_files(files).filter("error LIKE 'BadZipFile%'").collect()} == {"0", "1", "2", "3", "4", "5"}
    found = containers.attachments(files).filter("error IS NULL").collect()
    assert [(r["document_id"], r["filename"], r["mime_type"], r["file_size"]) for r in found] == [("2", "n é.pdf", "application/pdf", 3), ("2", "t.csv", "text/csv", 3)]


def test_mails_are_parsed_once_for_virtual_files(spark):
    from quillstack.sources import containers

    files = spark.createDataFrame([(str(k), "message/rfc822", bytearray(c)) for k, c in enumerate(_ODD)] + [("z", "application/zip", bytearray(b"no"))], "document_id string, mime_type string, content binary")
    found = containers.virtual_files(files)
    got = sorted((r["document_id"], r["filename"], r["file_size"]) for r in found.collect())
    assert got == [("0", "body.txt", 9), ("1", "body.txt", 0), ("2", "body.txt", 9), ("2", "n é.pdf", 3), ("2", "t.csv", 3), ("4", "body.txt", 4), ("5", "body.txt", 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 2


def _table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_like_the_table():
    import random

    from quillstack import backends

    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(0, 90)))
        b = list(a) if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 6)):
            b[rng.randrange(len(b) + 1) : rng.randrange(len(b) + 1)] = rng.choice(["", "a", "é", "zz"])
        assert backends.edit_distance(a, "".join(b)) == _table_distance(a, "".join(b))


def test_compare_long_texts(spark):
    """Pages of a million characters, whose whole table would take hours; short ones like the built-in distance."""
    from pyspark.sql import functions as F

    from quillstack import backends

    long = "word é " * 150_000
    rows = [(1, "b", long + "#"), (1, "a", long), (1, "c", "x" + long), (2, "a", "y" * 300 + "abc" * 500), (2, "b", "abd" * 500 + "z" * 100), (2, "c", ""), (3, "a", "kitten"), (3, "b", "sitting"), (4, "a", None), (4, "b", "x"), (4, "b", "y"), (5, None, "x"), (6, "a", "same"), (6, "a", "some"), (None, "a", "x")]
    got = sorted((tuple(r) for r in backends.compare(spark.createDataFrame(rows, "page_id long, backend string, text string")).select("page_id", "backend", "chars", "words", "distance").collect()), key=str)
    assert got == sorted([
        (1, "a", 1_050_000, 300_000, 0), (1, "b", 1_050_001, 300_001, 1), (1, "c", 1_050_001, 300_000, 1),
        (2, "a", 1800, 1, 0), (2, "b", 1600, 1, _table_distance(rows[3][2], rows[4][2])), (2, "c", 0, 0, 1800), (3, "a", 6, 1, 0), (3, "b", 7, 1, 3),
        (4, "a", None, None, None), (4, "b", 1, 1, None), (4, "b", 1, 1, None), (5, None, 1, 1, None), (6, "a", 4, 1, 0), (6, "a", 4, 1, 1),
    ], key=str)
    pairs = spark.range(200).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, (F.col("id") % 64).cast("int")).alias("a"), F.repeat(F.sha2((F.col("id") * 7).cast("string"), 256), 2).alias("b"))
    assert pairs.filter(~backends.distance(F.col("a"), F.col("b")).eqNullSafe(F.levenshtein("a", "b"))).count() == 0
