"""Quality rules: what labels call bad is rejected, what they call good stays; tables with repeated and contradicting labels, very long texts."""

import random

from pyspark.sql import functions as F

from quillstack.llm import quality as m


def test_bad_labelled_documents_are_rejected(spark, data):
    """Of the labelled documents that pass the base rules, nearly all bad ones go and all good ones stay."""
    folder = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = m.op7_quality(spark, folder).filter("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0)) and n[0, False] >= 10
    assert n.get((1, False), 0) == 0 and n[1, True] > 100


def test_strange_words_are_told_from_trusted_ones(spark):
    rng = random.Random(2)
    text = lambda kind: " ".join(f"{kind}{rng.randrange(50)}" for _ in range(80))
    good = [(i, text("good"), 1) for i in range(60)]
    bad = [(100 + i, text("bad"), 0) for i in range(30)]
    new = [(200, text("good"), None), (201, text("bad"), None), (202, "good1 " * 60_000, None), (203, None, None)]
    docs = spark.createDataFrame([r[:2] for r in good + bad + new], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad if q is not None] + [(0, 0), (1, 1), (None, 1), (100, None)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in m.judge(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad)
    assert kept[200] and not kept[201] and not kept[202] and not kept[203]
