"""Line dedup against brute force: odd rows, hot lines, long documents."""

import hashlib

import pytest

from quillstack.llm import line_dedup as m

LONG = "This line is certainly longer than forty characters."


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    where = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                where.setdefault(key(line), set()).add(i)
    keeper = {k: max(v) for k, v in where.items() if len(v) >= 5}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in keeper and keeper[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, f"{LONG}\nown {i}\n  {LONG.upper()}\t\n") for i in range(7)] + [
    (7, None), (8, ""), (9, "\n\n"), (3, f"{LONG}\nown 3\n  {LONG.upper()}\t\n"), (None, f"{LONG}\nnull id"), (10, LONG),
    (11, "É" * 40 + "\n" + "é" * 40), *[(20 + i, "É" * 40) for i in range(5)], (30, "\n".join([LONG, "filler"] * 300)), (30, "other row of the same id\n" + LONG),
]


def run(spark, tmp_path, rows, monkeypatch=None):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in m.op8_line_dedup(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("small", [0, 500_000])
def test_like_brute_force(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(m, "SMALL", small)
    assert run(spark, tmp_path, ROWS) == brute(ROWS)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_extra_columns_pass(spark):
    docs = spark.createDataFrame([(i, LONG, 5, "x") for i in range(6)], "doc_id long, text string, drops int, key string")
    out = m.dedup_lines(docs).collect()
    assert sorted((r["doc_id"], r["text"], r["drops"], r["key"]) for r in out) == [(i, "" if i < 5 else LONG, 5, "x") for i in range(6)]


def test_sql_agrees(spark, data, duck):
    got = sorted(tuple(r) for r in m.op8_line_dedup(spark, data).select("doc_id", "kept_sha256", "n_dropped", "n_lines").collect())
    assert got == sorted(duck.sql(m.SQL).project("doc_id, kept_sha256, n_dropped, n_lines").fetchall())


def test_documents_that_keep_all_lines_pass_by(spark, tmp_path, monkeypatch):
    """The bitmaps of many documents are joined, by way of the filter, as the broadcast ones are."""
    from quillstack.llm import _spark

    monkeypatch.setattr(_spark, "ATTACH_ROWS", 0)
    monkeypatch.setattr(_spark, "MARKS", 2)
    assert run(spark, tmp_path, ROWS + [(100 + i, f"own text of {i}") for i in range(200)]) == brute(ROWS + [(100 + i, f"own text of {i}") for i in range(200)])


def test_keepers_stream_over_a_ranged_sort(spark):
    docs = spark.createDataFrame([(i, 1, i % 7, 0) for i in range(50)], "h1 long, h2 long, doc_id long, pos int")
    found = m.keepers(docs, 5)
    assert [tuple(r) for r in found.collect()] == []
    found = m.keepers(docs.withColumn("h1", docs.h1 % 2), 5)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 6), (1, 1, 6)]
    plan = found._jdf.queryExecution().toString()
    assert "rangepartitioning(h1" in plan and "row_number() windowspecdefinition(h1" in plan and "Sort [h1" in plan


def test_columns_of_the_operators_own_names(spark):
    docs = spark.createDataFrame([(i, LONG, 9, "x") for i in range(6)], "doc_id long, text string, n_lines int, __keeps string")
    out = m.dedup_lines(docs).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out) == [(i, "" if i < 5 else LONG, 1, int(i < 5)) for i in range(6)]
