"""Decontamination: planted passages with edits, banded distance against the full table."""

import random

import numpy as np

from quillstack.llm import decontaminate as m


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def distance(pattern, text):
    """Least edits turning ``pattern`` into any run of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_banded_is_exact_inside_the_budget():
    rng = random.Random(1)
    for _ in range(60):
        text = words(rng, 30)
        at = rng.randrange(20, 60)
        piece = list(text[at : at + 60])
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(len(piece))
            kind = rng.randrange(3)
            piece[k : k + 1] = [] if kind == 0 else ["#"] if kind == 1 else [piece[k], "#"]
        want = distance("".join(piece), text)
        got = m.banded(m._codes("".join(piece)), m._codes(text), at, 6)
        assert got == want if want <= 6 else got > 6 or got >= want


def test_short_fragments_with_early_edits_like_brute_force():
    """A text that holds a window of the item within the budget is found, wherever the edits are."""
    rng = random.Random(3)
    hits = 0
    for n in range(120):
        item = words(rng, 60)
        at = rng.randrange(0, len(item) - 90)
        piece = list(item[at : at + rng.choice((64, 68, 72, 80))])
        for k in rng.sample(range(40), 3):
            piece[k : k + 1] = rng.choice(([], ["#"], [piece[k], "#"]))
        text = words(rng, 9) + "".join(piece) + words(rng, 9)
        index = m.Index([1], [m._codes(item)], m.Q, m.WINDOW, m.EDITS)
        found = list(index.matches(m._codes(text + "\x00" * m.Q), np.array([0])))
        want = any(distance(item[x : x + m.WINDOW], text) <= int(m.EDITS * m.WINDOW) for x in range(max(0, at - 4), min(len(item) - m.WINDOW, at + 20) + 1))
        hits += want
        assert bool(found) == want, n
    assert hits > 100


def test_planted_passages(spark):
    rng = random.Random(2)
    items = [(i, words(rng, 40)) for i in range(6)] + [(6, None), (7, "short"), (8, words(rng, 5) + " tail of an item"), (1, words(rng, 40))]
    spaced = lambda t: t.upper().replace(" ", " \n ", 3)
    typos = list(items[2][1])
    for k in range(30, len(typos), 40):
        typos[k] = "#"
    docs = [(1, words(rng, 300), "c"), (2, words(rng, 50) + " " + items[0][1] + " " + words(rng, 50), "d"), (3, spaced(items[1][1]), "d"), (4, words(rng, 9) + " " + "".join(typos), "d"),
            (5, items[3][1][20:150], "d"), (6, items[4][1][:40], "c"), (7, None, "c"), (8, "", "c"), (9, "short", "c"), (2, words(rng, 20), "c"), (None, items[5][1], "d"), (10, items[8][1], "d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = m.keep_clean(frame, bench).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(d[0]) for d in docs if d[2] == "c")
    assert all(r["found"] == "c" for r in kept)
    assert m.keep_clean(frame, bench.limit(0)).count() == len(docs)
    assert m.keep_clean(frame.limit(0), bench).count() == 0


def test_items_without_an_id_are_looked_for(spark):
    rng = random.Random(4)
    items = [(None, words(rng, 30)), (None, words(rng, 30)), (5, words(rng, 30))]
    docs = [(i, words(rng, 20) + " " + t + " " + words(rng, 20)) for i, (_, t) in enumerate(items)] + [(3, words(rng, 60))]
    found = m.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: [x["item_id"] for x in r["found"]] for r in found.collect()} == {0: [None], 1: [None], 2: [5], 3: []}


def test_blocks_find_the_same(spark, data, monkeypatch):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{data}/benchmark.parquet")
    got = lambda: {r["doc_id"]: sorted(x["item_id"] for x in r["found"]) for r in m.matches(docs, bench).collect()}
    whole = got()
    monkeypatch.setattr(m, "blocks", lambda b: iter_blocks(b, 3000))
    assert got() == whole
    grams = lambda t: {tuple(w[i : i + 10]) for w in [t.lower().split()] for i in range(len(w) - 9)}
    items = {r["item_id"]: grams(r["text"]) for r in bench.collect()}
    want = {r["doc_id"] for r in docs.collect() if any(grams(r["text"]) & g for g in items.values())}
    assert {i for i, f in whole.items() if f} >= want


_blocks = m.blocks


def iter_blocks(bench, chars):
    return _blocks(bench, block_chars=chars)


def test_qgrams_agree():
    a, b = m._qgrams(m._codes("hello world, here"), 10), m._qgrams(m._codes("xx hello world, here"), 10)
    assert np.array_equal(a, b[3:])
