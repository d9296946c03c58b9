"""Mixing: targets by repeated resharing, Sainte-Lague seats by highest quotients, limits per document."""

import re

import pytest
from pyspark.sql import functions as F

from quillstack.llm import mixing as m


def targets(sizes, epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    left = total
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > epochs * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def seats(weights, n):
    won = {k: 0 for k in weights}
    for _ in range(n):
        if sum(weights.values()):
            won[min(weights, key=lambda k: (-weights[k] / (2 * won[k] + 1), k))] += 1
    return won


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50, 333])
def test_seats_by_highest_quotients(spark, n):
    weights = {"a": 5.0, "b": 5.0, "c": 0.0, "d": 31.5, "e": 1.0, "f": 0.2}
    parts = spark.createDataFrame([(1, k, v, n) for k, v in weights.items()], "g int, k string, w double, n long")
    got = {r["k"]: r["q"] for r in m.apportion(parts, ["g"], [F.col("k")], "w", "n", "q").collect()}
    assert got == seats(weights, n)


def check(rows):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
    return sizes, taken, want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD", 4)
    docs = [(i, "w " * (i % 9 * 40), s, "extra", 1) for i, s in enumerate(["b"] * 60 + ["a"] * 20 + [None] * 20 + ["ä"] * 3 + ["Z"] * 30 + ["void"] * 2)]
    docs = [d if d[2] != "void" else (d[0], None, "void", "x", 1) for d in docs] + [docs[5], docs[5], (None, "x y z", "b", "e", 1), (900, "q " * 30_000, "big", "e", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, target string, shard int")
    rows = m.mix(frame).collect()
    assert len(rows) == len(docs)
    sizes, taken, want = check(rows)
    shards = {s: -(-sum(d[2] == s for d in docs) // 4) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= m.BLOCK * (shards[s] + 1), s
    assert sorted(map(str, rows)) == sorted(map(str, m.mix(frame.repartition(7)).collect()))
    assert m.mix(frame.limit(0)).count() == 0


def test_whole_query(spark, data):
    rows = m.op2_mixing(spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in rows)
    _, taken, want = check(rows)
    assert all(abs(taken[s] - want[s]) <= m.BLOCK for s in want)


def test_sql_agrees(spark, data, duck):
    got = m.op2_mixing(spark, data)
    columns = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, duck.sql(m.SQL).project(", ".join(columns)).fetchall()))


def test_small_and_capped_sources_meet_their_targets(spark, monkeypatch):
    """Sources below a block take their target to the word, capped ones all that their documents hold, whatever the shards."""
    monkeypatch.setattr(m, "SHARD", 3)
    docs = [(i, "w " * (7 + i % 5), "a") for i in range(3)] + [(100 + i, "w " * (i % 50), "b") for i in range(90)] + [(300 + i, "w " * 900, "c") for i in range(60)] + [(500, "w " * 40, None)]
    rows = m.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    sizes, taken, want = check(rows)
    assert all(abs(taken[s] - want[s]) <= (0.5 if want[s] < m.BLOCK * (m.FEW - 1) else m.BLOCK) for s in want), (taken, want)
    assert want["b"] == 3 * sizes["b"] == pytest.approx(taken["b"], abs=m.BLOCK)


def test_blocks_are_drawn_by_seed(spark):
    """What a shard takes in its last pass lies in blocks all over the run, not at its beginning, and changes with the seed."""
    docs = [(i, "w " * 64, "ab"[i % 10 == 0]) for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    one, two = ({r["doc_id"]: r["taken"] for r in m.mix(frame, (3, 2), seed=s).collect() if r["source"] == "a"} for s in (1, 2))
    assert sum(one.values()) == sum(two.values()) and one != two
    assert {v for v in one.values()} <= {0, 64} | {v for v in one.values() if 0 < v < 64} and sum(0 < v < 64 for v in one.values()) <= 2
    assert 0 < sum(v > 0 for v in one.values()) < 1800
