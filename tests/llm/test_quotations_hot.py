"""Quotation linking of one large conversation full of equal lines, of runs of turns, and of very long texts, against SQL or by hand."""

import pytest

from quillstack.llm import quotations as m

duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = m.op6_quotations(spark, str(tmp_path))
    columns = sorted(got.columns)
    found = got.select(*columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, con.sql(m.SQL).project(", ".join(columns)).fetchall()))
    return found


@pytest.mark.parametrize("span", [2, 7, 1024])
def test_runs_of_turns(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(m, "SPAN", span)
    texts = ["ok", "> ok\nfine", "other\n\nlines here", "> lines here", ">> ok\n> fine\nsure", "> sure\n> ok\nok"]
    rows = [(c, t, "u", texts[(t * 5 + c) % 6]) for c in range(3) for t in range(40)] + [(1, 3, "u", "> ok"), (2, -5, "u", "ok"), (2, -7, "u", "> ok")]
    found = same_as_sql(spark, tmp_path, rows)
    assert sum(r["n_linked"] > 0 for r in found) > 50


def test_many_equal_lines_make_no_pairs(spark, tmp_path):
    rows = [(1, t, "u", "ok" if t % 2 else "> ok\nok") for t in range(3000)]
    found = same_as_sql(spark, tmp_path, rows)
    assert sum(r["n_linked"] for r in found) == 1499
    frame = spark.createDataFrame([(1, 7, 7, t) for t in range(3000)], "conv_id long, h1 long, h2 long, turn long")
    out = m.latest(frame, frame.withColumnRenamed("turn", "origin"))
    assert {(r["turn"], r["origin"]) for r in out.collect()} == {(t, t - 1) for t in range(1, 3000)}
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_very_long_texts(spark):
    long = "\n".join(f"line number {i} of a long message" for i in range(20_000))
    quoted = "\n".join("> " + x for x in long.split("\n"))
    rows = [(1, 0, "u", long), (1, 1, "a", quoted + "\nagreed"), (1, 2, "u", "> line number 19999 of a long message\nyes")]
    out = {r["turn"]: (r["reply_to"], r["thread"], r["body"][:6]) for r in m.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {0: (None, 0, "line n"), 1: (0, 0, "agreed"), 2: (0, 0, "yes")}
