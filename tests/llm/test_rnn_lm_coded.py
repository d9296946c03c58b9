"""LM scoring: texts are coded once for training and score, and the passes of a step against plain sums."""

from collections import Counter

import numpy as np
import pytest

from quillstack.llm import rnn_lm as m
from quillstack.llm._text import slices, word_hashes

TEXTS = ["b a a c", None, "", "A a a b rare rare other", " \n", "b é", "a b c d", "only held words"]


def test_training_and_score_read_coded_rows_only(spark, monkeypatch):
    """Without the texts, coded rows train the network and give the score."""
    monkeypatch.setattr(m, "MODEL_WORDS", 3)  # the rest of the head shares the rare symbol
    monkeypatch.setattr(m, "HEAD", 4)
    docs = spark.createDataFrame([(i, i == 7, t) for i, t in enumerate(TEXTS)], "doc_id long, held_out boolean, text string")
    training = docs.filter("NOT held_out")
    counts = m.cut(m.word_counts(training))
    model = m.count_model(training, counts)
    n = model.network.n
    split = [(t or "").lower().split() for t in TEXTS]
    near = {w: int(model.lookup(word_hashes([w])[0])[0]) for x in split for w in x}
    coded = m.cut(m.code(docs, model))
    assert "text" not in coded.columns
    rows = {r["doc_id"]: r for r in coded.collect()}
    for i, words in enumerate(split):
        want = [int(model.symbol[near[w]]) if near[w] >= 0 else n - 2 for w in words]
        assert np.frombuffer(rows[i]["symbols"], np.int16).tolist() == [*want, n - 1]
        far = [h for w in words if near[w] < 0 for h in word_hashes([w])[0]]
        assert np.frombuffer(rows[i]["far"], np.uint64).tolist() == far
        assert (rows[i]["chars"], rows[i]["n_tokens"]) == (len(TEXTS[i] or ""), len(words) + 1)
    before = {k: v.copy() for k, v in model.network.p.items()}
    m.fit(coded.filter("NOT held_out").select("symbols", "chars"), model)
    assert all((before[k] != model.network.p[k]).any() for k in before)
    out = {r["doc_id"]: r for r in m.score(coded, model, counts).collect()}
    count = Counter(w for x in split[:7] for w in x)
    assert {i: r["n_known"] for i, r in out.items()} == {i: sum(w in count for w in x) + 1 for i, x in enumerate(split)}
    for i, words in enumerate(split):
        log = model.network.likelihood([np.frombuffer(rows[i]["symbols"], np.int16)])[0] / np.log(10)
        log += sum(np.log10((count[w] + 1) / model.rare_mass) for w in words if near[w] < 0 or model.symbol[near[w]] == n - 2)
        assert out[i]["score"] == pytest.approx(log, rel=1e-5)


def test_query_scans_the_texts_no_more_than_for_counts_and_codes(spark, data):
    """The plan of the score starts from checkpoints, not from the documents."""
    plan = m.op4_lm_score(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "parquet" not in plan and "text#" not in plan


def test_coded_slices_are_those_of_the_texts():
    import pyarrow as pa

    texts = ["x" * k for k in (3, 0, 9, 10, 1, 1, 25, 2)]
    b = pa.RecordBatch.from_arrays([pa.array([b"\0\0"] * len(texts)), pa.array([len(t) for t in texts])], names=["symbols", "chars"])
    for limit in (1, 5, 11, 100):
        assert [(lo, hi) for lo, hi, _ in m._coded_slices(b, limit)] == list(slices(texts, limit))


def test_rows_of_a_symbol_add_up():
    rng = np.random.default_rng(0)
    symbols = np.concatenate((np.full(50, 4), rng.integers(0, 90, 200), [-1, -1], np.repeat([95, 96], m.SOME), np.full(m.SOME + 1, 97)))
    rng.shuffle(symbols)
    g = rng.normal(size=(len(symbols), 6))
    rows, sums = m._by_symbol(symbols, g)
    assert sorted(rows) == sorted(set(symbols.tolist()) - {-1})
    for s, x in zip(rows, sums):
        assert np.allclose(x, g[symbols == s].sum(0))
    assert [len(x) for x in m._by_symbol(np.array([-1]), g[:1])] == [0, 0]


def test_large_sums_saturate_without_warnings():
    n = m.Network(np.arange(1.0, 60))
    n.p["x"][:] *= 1e4
    tokens = np.arange(12).reshape(6, 2)
    with np.errstate(all="raise", under="ignore"):
        got = n._forward(np.zeros((2, m.HIDDEN), np.float32), tokens, np.zeros((6, 2), bool), False)[0]
    h = np.zeros((2, m.HIDDEN), np.float32)
    for t in range(6):
        h = n.step(h, tokens[t])[0]
        assert np.allclose(got[t], h, atol=1e-5)
