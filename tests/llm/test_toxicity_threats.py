"""Toxicity: learnt threats and insults are told apart; rows that were not learnt from; odd tables and very long texts."""

import random
import time

from pyspark.sql import functions as F

from quillstack.llm import toxicity as m


def test_learnt_threats_are_threats(spark):
    rng = random.Random(1)
    common = "i will tonight you them it for they said she never are a he to".split()
    filler = lambda n: " ".join(rng.choice((f"w{rng.randrange(300)}", f"w{rng.randrange(300)}", rng.choice(common))) for _ in range(n))
    docs, labels = [], []
    for i in range(900):
        kind = i % 6
        text = filler(30)
        if kind == 0:
            text += f". I will zorkle {rng.choice(("you", "them", "it for you"))} tonight, {filler(5)}"
        if kind == 1:
            text += f". You are a blurgh, {filler(5)}"
        if kind == 2:
            text += f". They said she will never zorkle it, {filler(5)}" if i % 90 == 2 else f" you {filler(3)}"
        docs.append((i, text))
        labels.append((i, int(kind < 2)))
    frame, marked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    g = m.fit(frame, marked, F.lit(True))
    assert ("zorkle", False) in g.threats and ("blurgh", False) not in g.threats and {"zorkle", "blurgh"} <= set(g.whole)
    marks = lambda t: {p for p, v in zip(m.PATTERNS, g.features([t])[0]) if v}
    assert marks("you there, zorkle them") == {"threat_targeted"} and marks("never zorkle it") == {"threat_negated"} and marks("what a blurgh") == {"insult_plain"}
    assert marks("he reported: zorkle you") == {"threat_plain"} and marks("he reported to zorkle you") == {"threat_reported"}


def test_rows_not_learnt_from(spark, data):
    """Held-out rows only.  Of the tables' toxic labels a few stand on texts without any mark, which no text model can know."""
    folder = data.replace("sf0.001", "sf0.1")
    toxic = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = m.op9_toxicity(spark, folder).filter("held_out").join(toxic, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out}
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


def test_odd_tables_and_long_texts(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "you idiot", "c"), (2, "fine " * 300_000 + "you idiot", "d"), (2, ("x" * 300 + " ") * 2000, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    began = time.time()
    for labels in ([], [(1, None)], [(None, 1)], [(2, 1), (2, 0)], [(1, 1), (2, 0)]):
        marked = spark.createDataFrame(labels, "doc_id long, toxic int")
        out = m.score(frame, m.fit(frame, marked, F.lit(True))).collect()
        assert [r["toxic"] for r in out] == list("abcde") and all(0 <= r["toxicity"] <= 1 for r in out)
        assert out[0]["toxicity"] == out[1]["toxicity"] == out[4]["toxicity"] < 0.7
        if labels != [(1, 1), (2, 0)]:
            assert out[2]["toxicity"] >= 0.7 and out[3]["toxicity"] >= 0.7
    assert time.time() - began < 120
