"""Near-duplicate classes of texts that repeat their shingles, against weighted similarity by brute force; ids of other types, very long texts."""

import random
from collections import Counter

import numpy as np
import pytest

from quillstack.llm import near_dup as m
from quillstack.llm._text import shingles, unique_per_text, word_hashes


def bag(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    bags = [(i, bag(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(bags)):
        for b in range(a):
            (i, x), (j, y) = bags[a], bags[b]
            common = sum((x & y).values())
            if common >= 0.8 * (sum(x.values()) + sum(y.values()) - common):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in parent}


def texts():
    rng = random.Random(9)
    out = []
    for _ in range(6):
        line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(200))
        for n in (1, 2, 4, 8, 9, 10, 20, 21, 24):
            out.append(f"{line} " * n + other[: rng.choice((0, 60))])
    return out


@pytest.mark.parametrize("direct", [4, 64])
def test_classes_by_weighted_similarity(spark, monkeypatch, direct):
    monkeypatch.setattr(m, "DIRECT", direct)
    monkeypatch.setattr(m, "BLOCK", 8)
    rows = list(enumerate(texts()))
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 6 < len(set(want.values())) < len(rows)


def test_ids_may_be_text(spark):
    rows = [(f"d{i:03}", t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r["class_id"] for r in m.classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == brute(rows)


def test_occurrences_have_the_weighted_similarity():
    a, b = "x y z u v " * 7 + "tail of it all", "x y z u v " * 5 + "another tail of it"
    sets = []
    for t in (a, b):
        items, owner = m.occurrences(*unique_per_text(*shingles(*word_hashes([t]), 5, 1)))
        assert (np.diff(items.astype(object)) > 0).all() and not owner.any()
        sets.append(set(items.tolist()))
    x, y = bag(a), bag(b)
    assert len(sets[0] & sets[1]) == sum((x & y).values()) and [len(s) for s in sets] == [sum(x.values()), sum(y.values())]


@pytest.mark.parametrize("scale", [1.0, 100.0, 10_000.0])
def test_estimate_of_heavy_sets(scale):
    items = np.tile(np.arange(1, 4, dtype=np.uint64), 2)
    sig = m.dart_signatures(items, np.array([5.0, 1, 2, 2.5, 1, 4]) * scale, np.repeat([0, 1], 3), 2, 4000, 28000)
    assert abs((sig[0] == sig[1]).mean() - 5.5 / 10) < 0.04


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**5)}" for _ in range(150_000)]
    changed = words[:70_000] + ["x"] * 50 + words[70_050:]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, "same " * 400_000), (4, "same " * 380_000), (5, "same " * 100_000), (6, " ".join(words[:100_000]))]
    got = {r["doc_id"]: r["class_id"] for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_large_texts_fill_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(m, "DIRECT", 2)
    monkeypatch.setattr(m, "BLOCK_BYTES", 4000)
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r["class_id"] for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
