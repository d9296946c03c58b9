"""Patience alignment and license scan; quotation linking."""

import random

import pytest

from quillstack.llm import licenses, quotations


def lis_length(v):
    best = [1] * len(v)
    for i in range(len(v)):
        best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
    return max(best, default=0)


def test_longest_increasing():
    rng = random.Random(0)
    for _ in range(100):
        v = rng.sample(range(50), rng.randrange(0, 20))
        got = [v[i] for i in licenses.longest_increasing(v)]
        assert got == sorted(got) and len(got) == lis_length(v)


def test_patience_pairs_match_and_increase():
    rng = random.Random(1)
    for _ in range(100):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 15))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 15))]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    words = "the quick brown fox jumps over the lazy dog".split()
    assert len(licenses.patience(words, words)) == 9
    assert len(licenses.patience(words, "the quick red fox jumps over a lazy dog".split())) == 7


def test_scan_finds_whole_changed_and_repeated_notices(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    long = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 200)
    changed = long.replace("obtain a copy", "get one copy").replace("See the License", "Refer to the License")
    mit = licenses.TEMPLATES[0][1]
    docs = [(1, f"{filler(500)} {long} {filler(500)}", ["Apache-2.0"]), (2, changed.upper(), ["Apache-2.0"]), (3, f"{mit} {filler(40)} {mit}", ["MIT", "MIT"]),
            (4, filler(3000), []), (5, "a licence to fish, and copyright law", []), (6, None, []), (7, "", []), (8, "All rights reserved.", ["all-rights-reserved"]), (8, mit, ["MIT"]),
            (None, "Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"])]
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = sorted(str((r["doc_id"], [m["license"] for m in r["licenses"]])) for r in licenses.matches(frame).collect())
    assert got == sorted(str((d[0], d[2])) for d in docs)
    assert licenses.matches(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.matches(frame, (("x", "nothing to trigger on"),))


@pytest.mark.parametrize("text, name", [("Available under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT", "MIT")])
def test_matches_without_a_trigger_string(text, name):
    ready = [licenses.Template(n, licenses.words_of(t)) for n, t in licenses.TEMPLATES]
    assert not any(t in text.lower() for t in licenses.TRIGGERS)
    assert [(f["license"], f["coverage"]) for f in licenses.scan(text, ready)] == [(name, 0.8)]


@pytest.mark.parametrize("copies", [2, 3, 5])
def test_adjacent_copies_are_reported_each(copies):
    ready = [licenses.Template(n, licenses.words_of(t)) for n, t in licenses.TEMPLATES]
    for name, text in licenses.TEMPLATES:
        n = len(licenses.words_of(text))
        found = licenses.scan(" ".join([text] * copies), ready)
        assert [(f["license"], f["first"], f["last"]) for f in found] == [(name, k * n, k * n + n - 1) for k in range(copies)]


def test_each_template_finds_itself():
    ready = [licenses.Template(n, licenses.words_of(t)) for n, t in licenses.TEMPLATES]
    for name, text in licenses.TEMPLATES:
        found = licenses.scan("before it " * 30 + text + " after it" * 30, ready)
        assert [f["license"] for f in found] == [name] and found[0]["coverage"] == 1


def test_license_query_like_plain_search(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    short = {t: n for n, t in licenses.TEMPLATES if len(t) < 90}
    for r in licenses.op1_license_scan(spark, data).collect():
        assert {n for t, n in short.items() if t in texts[r["doc_id"]]} <= set(r["licenses"])


ROWS = [
    (1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "On Monday X wrote:\n> Hello  THERE\n> How are you?\nFine thanks."), (1, 2, "u", ">> how are you?\n> fine thanks.\n\nGood."),
    (1, 3, "u", None), (2, 0, "u", "> Hello there\nText"), (None, 1, "u", "> a\nb"), (2, 1, "a", "Text"), (2, 2, "u", "> text\nsure"), (2, 2, "u", "> text\nsure"),
    (2, 3, "a", "> sure\n> extra\nok"), (2, None, "a", "> text"), (3, 0, "u", ""), (3, 1, "a", "> \n>\n"), (4, 0, "u", "a > b\n x"),
]


def test_links(spark):
    out = quotations.link(spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, thread int"))
    got = sorted(str((r["conv_id"], r["turn"], r["reply_to"], r["thread"], r["n_quotes"], r["n_linked"], r["body"])) for r in out.collect())
    want = [
        (1, 0, None, 0, 0, 0, "Hello there\nHow are you?"), (1, 1, 0, 0, 1, 1, "Fine thanks."), (1, 2, 1, 0, 2, 2, "Good."), (1, 3, None, 3, 0, 0, ""),
        (2, 0, None, 0, 1, 0, "Text"), (None, 1, None, 1, 0, 0, "b"), (2, 1, None, 1, 0, 0, "Text"), (2, 2, 1, 1, 1, 1, "sure"), (2, 2, 1, 1, 1, 1, "sure"),
        (2, 3, 2, 1, 1, 1, "ok"), (2, None, None, None, 0, 0, ""), (3, 0, None, 0, 0, 0, ""), (3, 1, None, 1, 0, 0, ""), (4, 0, None, 0, 0, 0, "a > b\n x"),
    ]
    assert got == sorted(map(str, want))


def test_sql_on_the_same_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = quotations.op6_quotations(spark, str(tmp_path))
    columns = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, con.sql(quotations.SQL).project(", ".join(columns)).fetchall()))


def test_long_chain_and_empty(spark):
    rows = [(1, 0, "u", "line number 0")] + [(1, i, "u", f"> line number {i - 1}\nline number {i}") for i in range(1, 40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r["turn"], r["thread"], r["body"]) for r in quotations.link(frame).collect()} == {(i, 0, f"line number {i}") for i in range(40)}
    assert quotations.link(frame.limit(0)).count() == 0


def test_query_keeps_every_message(spark, data):
    assert quotations.op6_quotations(spark, data).count() == spark.read.parquet(f"{data}/conversations.parquet").count()
