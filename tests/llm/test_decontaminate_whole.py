"""Decontamination: every window within the budget is found, by brute force; runs of one character, pieces, tiles, short items, ids of other types."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from test_decontaminate import distance, words

from quillstack.llm import decontaminate as m


def index(items):
    return m.Index(list(range(len(items))), [m._codes(t) for t in items], m.Q, m.WINDOW, m.EDITS)


def found(items, text):
    return {x["item_id"] for x in m._found(index(items), [text])[0]}


def test_planted_windows_with_substitutions():
    rng = random.Random(11)
    lost = 0
    for _ in range(400):
        item = words(rng, 70)[:300]
        at = rng.randrange(0, len(item) - 64)
        piece = list(item[at : at + 64])
        for k in rng.sample(range(64), 4):
            piece[k] = "#"
        lost += not found([item], words(rng, 20) + "".join(piece) + words(rng, 20))
    assert lost == 0


def brute(item, text):
    codes = m.normal(text)
    w = min(m.WINDOW, len(item))
    return min(distance(item[x : x + w], codes) for x in range(len(item) - w + 1)) <= int(m.EDITS * w)


@pytest.mark.parametrize("letters", ["ab", "abcd ", "abcdefghijklmnop "])
def test_equal_to_a_scan_of_all_windows(letters):
    rng = random.Random(12)
    hits = 0
    for n in range(60):
        size = rng.choice((24, 30, 50, 64, 70, 80))
        item = m.normal("".join(rng.choice(letters) for _ in range(size)))
        if len(item) < 24:
            continue
        at = rng.randrange(0, max(1, len(item) - 64))
        piece = list(item[at : at + 64])
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(piece))
            piece[k : k + 1] = rng.choice(([], ["#"], [piece[k], "#"], [rng.choice(letters)]))
        text = "".join(rng.choice(letters) for _ in range(60)) + "".join(piece) + "".join(rng.choice(letters) for _ in range(60))
        want = brute(item, text)
        hits += want
        assert bool(found([item], text)) == want, (item, text)
    assert 10 < hits < 60


def test_runs_of_one_character():
    run, other = "a" * 2000, "b" * 30 + "a" * 50 + "c" * 40 + "a" * 50 + "d" * 30
    tracemalloc.start()
    began = time.time()
    assert found([run, other], "a" * 20_000) == {0}
    assert found([other], "a" * 20_000) == set()
    assert found([run], "x" + "ab" * 10_000) == set()
    assert found([run], "z" * 5000 + "a" * 64 + "z" * 5000) == {0}
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()


def test_pieces_and_tiles_find_the_same(monkeypatch):
    rng = random.Random(13)
    items = [words(rng, 40) for _ in range(4)] + ["ab" * 60]
    texts = []
    for n in range(30):
        item = rng.choice(items)
        piece = list(item[rng.randrange(30) :][:80])
        for k in rng.sample(range(60), rng.randrange(0, 6)):
            piece[k] = "#"
        texts.append(words(rng, rng.randrange(400)) + "".join(piece) + rng.choice(("ab", "xy ")) * rng.randrange(300) + words(rng, rng.randrange(100)))
    ids = lambda: [[x["item_id"] for x in f] for f in m._found(index(items), texts)]
    want = ids()
    assert 10 < sum(map(bool, want))
    for chunk, hits in ((300, 1 << 20), (1 << 20, 200), (500, 50)):
        monkeypatch.setattr(m, "CHUNK", chunk)
        monkeypatch.setattr(m, "HITS", hits)
        assert ids() == want


def test_places_are_those_in_the_text(monkeypatch):
    rng = random.Random(14)
    item = words(rng, 30)
    text = words(rng, 300)
    for chunk in (1 << 20, 400):
        monkeypatch.setattr(m, "CHUNK", chunk)
        (hit,) = m._found(index([item]), [text + " " + item + " " + text])[0]
        assert hit["item_pos"] == 0 and hit["edits"] == 0 and abs(hit["pos"] - len(text) - 1) <= 2 * int(m.EDITS * m.WINDOW) + 2


def test_short_items_as_whole_words(spark):
    items = [(1, "yes"), (2, "Bach's  Mass"), (3, "no way"), (4, None), (5, " "), (None, "Alone"), (7, "yes")]
    docs = [(1, "Oh YES, or yes"), (2, "yesterday"), (3, "bach's\nmass in b"), (4, "no wayside"), (5, "alone"), (6, None), (7, "")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["found"]] for r in m.matches(frame, bench, short=True).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [], 5: [None], 6: [], 7: []}
    assert not any(r["found"] for r in m.matches(frame, bench).collect())


@pytest.mark.parametrize("chars", [4_000_000, 400])
def test_ids_of_other_types_and_repeated_items(spark, monkeypatch, chars):
    blocks = m.blocks
    monkeypatch.setattr(m, "blocks", lambda b: blocks(b, chars))
    rng = random.Random(15)
    texts = [words(rng, 30) for _ in range(8)]
    items = [(f"q{i}", t) for i, t in enumerate(texts)] + [("a", texts[3]), (None, texts[4])]
    docs = [(f"d{i}", words(rng, 9) + " " + t, i) for i, t in enumerate(texts)] + [(None, texts[2], 8), ("d0", words(rng, 60), 9), ("d0", words(rng, 9) + " " + texts[0], 10), ("dd", texts[1] + " " + texts[5], 11)]
    out = m.matches(spark.createDataFrame(docs, "doc_id string, text string, found int"), spark.createDataFrame(items, "item_id string, text string"), to="hits").collect()
    want = {i: [f"q{i}"] for i in range(8)} | {3: ["a"], 8: ["q2"], 9: [], 10: ["q0"], 11: ["q1", "q5"]}
    assert {r["found"]: sorted(x["item_id"] for x in r["hits"]) for r in out} == want


def test_very_long_text():
    rng = random.Random(16)
    item = words(rng, 40)
    text = words(rng, 300_000)
    began = time.time()
    assert found([item], text + " " + item) == {0} and found([item], text) == set()
    assert time.time() - began < 60
    assert np.array_equal(m._ranges(np.array([5, 0, 9]), np.array([2, 0, 3])), [5, 6, 9, 10, 11])
