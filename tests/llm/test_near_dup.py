"""DartMinHash estimates, near-duplicate classes and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import near_dup as m


def shingled(text):
    words = [w for w in (text or "").lower().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else None


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingled(t)) for i, t in rows if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def family(rng, size, first, edits):
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    return [(first + i, edited(words, rng, rng.choice(edits))) for i in range(size)]


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_estimate(share):
    rng = np.random.default_rng(1)
    n = 400
    common = int(2 * n * share / (1 + share))
    a = rng.integers(0, 2**63, n).astype(np.uint64)
    b = np.concatenate((a[:common], rng.integers(0, 2**63, n - common).astype(np.uint64)))
    sig = m.dart_signatures(np.concatenate((a, b)), np.ones(2 * n), np.repeat([0, 1], n), 2, 2000, 16000)
    assert abs((sig[0] == sig[1]).mean() - share) < 0.05


def test_weighted_estimate():
    items = np.tile(np.arange(1, 4, dtype=np.uint64), 2)
    sig = m.dart_signatures(items, np.array([5.0, 1, 2, 2.5, 1, 4]), np.repeat([0, 1], 3), 2, 4000, 28000)
    assert abs((sig[0] == sig[1]).mean() - 5.5 / 10) < 0.04


def test_signature_does_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    alone = m.dart_signatures(items[:100], np.ones(100), np.zeros(100, int), 1)
    both = m.dart_signatures(items, np.ones(300), np.repeat([0, 1], [100, 200]), 2)
    assert (alone[0] == both[0]).all()


def test_classes_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "DIRECT", 4)
    monkeypatch.setattr(m, "BLOCK", 8)
    rng = random.Random(3)
    rows = family(rng, 40, 0, [0, 1, 2, 3, 4]) + family(rng, 10, 100, [1, 2]) + family(rng, 5, 200, [8, 12])
    rows += [(300, rows[0][1]), (301, rows[0][1].upper()), (301, rows[0][1].upper()), (302, None), (303, ""), (304, "  \n"), (305, "a b"), (306, "A  b"), (307, "a b c"), (None, rows[0][1])]
    rows += [(308, rows[1][1]), (308, rows[45][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in m.classes(docs).collect()}
    want = brute(rows)
    assert {i: got.get(i, i) for i in want} == want


def test_keep_one_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 9), (2, "a b c d e f", "y", 9), (3, None, "z", 9), (None, "a b c d e f", "n", 9)], "doc_id long, text string, label string, rep int")
    assert sorted((r["label"], r["rep"]) for r in m.keep_one(docs).collect()) == [("n", 9), ("x", 9), ("z", 9)]
    assert m.keep_one(docs.limit(0)).collect() == []


def test_keep_one_of_repeated_rows_and_rows_without_an_id(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "A b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (4, None, "z"), (4, None, "z"), (5, "g h i j k", "w"),
            (None, "l m n", "n"), (None, "L  m n", "n"), (None, "l m n o", "o"), (None, None, "p"), (None, " ", "p")]
    kept = m.keep_one(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    assert sorted((str(r["doc_id"]), r["label"]) for r in kept) == [("1", "x"), ("4", "z"), ("5", "w"), ("None", "n"), ("None", "o"), ("None", "p"), ("None", "p")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in m.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 103: 100}


def test_whole_query_on_small_table(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    out = m.op5_near_dup(spark, data).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute(rows)
    assert sum(1 / r["class_size"] for r in out) == pytest.approx(len({r["class_id"] for r in out}))


def test_block_rows_of_a_large_bucket_do_not_grow_with_its_square(spark, monkeypatch):
    """Texts apart from all others leave the bucket, and its largest component is a row for each block of the others."""
    monkeypatch.setattr(m, "DIRECT", 4)
    monkeypatch.setattr(m, "BLOCK", 8)
    rng = random.Random(5)
    rows = family(rng, 160, 0, [0, 1, 1, 2, 3, 4, 5, 6])
    dealt, verified = [], m._blockwise

    def blockwise(rows, sets, least):
        dealt.append(rows.count())
        return verified(rows, sets, least)

    monkeypatch.setattr(m, "_blockwise", blockwise)
    got = {r["doc_id"]: r["class_id"] for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) > 20 and sum(dealt) == 0  # nothing is left to compare block against block


def test_blocks_hold_every_pair_of_different_components_once_at_least(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 8)
    labels = {i: 0 if i < 60 else i // 3 for i in range(90)}
    rows = spark.createDataFrame([(7, i, n, 20) for i, n in labels.items()], "key long, doc_id long, label long, size long")
    sets = spark.createDataFrame([(i, bytearray(np.arange(20, dtype=np.uint64).tobytes())) for i in labels], "doc_id long, shingles binary")
    met, held = set(), []
    group = type(rows.groupBy("key"))
    apply = group.applyInPandas
    monkeypatch.setattr(group, "applyInPandas", lambda self, f, schema: held.append(self._df) or apply(self, f, schema))
    links = m._blockwise(rows, sets, 0.8).collect()
    for r in held[0].groupBy("key", "i", "j").agg(F.collect_list("doc_id").alias("ids")).collect():
        met |= {(a, b) for a in r["ids"] for b in r["ids"] if a < b}
    assert all((a, b) in met for a in labels for b in labels if a < b and labels[a] != labels[b])
    assert held[0].count() <= 60 * 4 + 30 * (8 + 4)
    parent = {n: n for n in labels.values()}
    for r in links:
        x, y = labels[r["a"]], labels[r["b"]]
        old, new = parent[x], parent[y]
        parent = {k: new if v == old else v for k, v in parent.items()}
    assert len(set(parent.values())) == 1  # equal texts: all components are tied


@pytest.mark.parametrize("ranges, fan", [(18, 8), (6, 2)])
def test_shared_shingles_are_never_counted_short(spark, monkeypatch, ranges, fan):
    monkeypatch.setattr(m, "RANGE", ranges)
    monkeypatch.setattr(m, "FAN", fan)
    rng = np.random.default_rng(6)
    sets = {i: np.unique(rng.integers(0, 900, 60).astype(np.uint64) << np.uint64(16)) for i in range(40)}
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "doc_id long, shingles binary")
    rows = spark.createDataFrame([(i % 2, i, i // 4) for i in sets], "key long, doc_id long, label long")
    got = {r["doc_id"]: (r["size"], r["shared"]) for r in m._linkable(rows, frame.repartition(5), 0.01).collect()}
    for i, x in sets.items():
        there = set().union(*(set(y.tolist()) for j, y in sets.items() if j // 4 != i // 4))
        least = sum(v in there for v in x.tolist())
        assert got[i][0] == len(x) and least <= got[i][1] <= len(x)
