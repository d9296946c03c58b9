"""Small graphs and frames of the near-duplicate rounds: as few tasks as they need, with the results of the rounds over all partitions."""

import random

import pytest

from quillstack.llm import near_dup as m
from quillstack.llm._spark import packed


def graph(kind):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(40)] + [(7, 7), (9, 8), (9, 8)]
    return [(kind(a), kind(b)) for a, b in edges]


@pytest.mark.parametrize("kind, name", [(int, "long"), (lambda x: f"{'é' if x % 2 else 'z'}{x}", "string")])
def test_one_task_finds_the_components_of_the_rounds(spark, monkeypatch, kind, name):
    frame = spark.createDataFrame(graph(kind), f"a {name}, b {name}").repartition(7)
    one = m.components(frame)
    assert one.rdd.getNumPartitions() == 1
    monkeypatch.setattr(m, "FEW_EDGES", 0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, m.components(frame).collect()))


def test_ids_of_other_kinds_and_no_edges(spark):
    dates = spark.sql("SELECT date'2020-01-03' AS a, date'2020-01-01' AS b")
    assert [tuple(map(str, r)) for r in m.components(dates).collect()] == [("2020-01-03", "2020-01-01")]
    assert m.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_packed_keeps_rows_in_the_tasks_they_need(spark):
    few = packed(spark.range(50).repartition(9))
    assert few.rdd.getNumPartitions() == 1 and sorted(r[0] for r in few.collect()) == list(range(50))
    many = packed(spark.range(20000).repartition(9), 1 << 12)
    assert many.rdd.getNumPartitions() == 9 and many.count() == 20000
    assert packed(spark.range(0).repartition(3)).count() == 0
