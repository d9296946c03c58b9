"""LM scoring: gradients, normalisation, state across windows, base scores by brute force, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import rnn_lm as m


def net(n=150, seed=0):
    return m.Network(np.random.default_rng(seed).integers(1, 99, n).astype(float))


def test_untrained_network_is_near_the_unigram():
    n = net()
    for k in ("c", "w"):
        n.p[k][:] = 0
    h = np.zeros((n.n, m.HIDDEN), np.float32)
    logs, _ = n.log_probs(h, np.arange(n.n))
    mass = np.random.default_rng(0).integers(1, 99, n.n) + 1.0
    assert np.allclose(np.exp(logs), mass / mass.sum(), rtol=1e-3)


def test_probabilities_sum_to_one():
    n = net()
    h = np.repeat(np.random.default_rng(1).normal(0, 0.7, (1, m.HIDDEN)).astype(np.float32), n.n, 0)
    logs, _ = n.log_probs(h, np.arange(n.n))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_likelihood_is_step_by_step_whatever_the_lanes(monkeypatch):
    n = net()
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(0, n.n - 1, k), n.n - 1).astype(np.int32) for k in (0, 1, 5, 40, 3, 170, 2)]
    want = []
    for d in docs:
        h, before, total = np.zeros((1, m.HIDDEN), np.float32), n.n - 1, 0.0
        for t in d:
            h = n.step(h, np.array([before]))[0]
            total += n.log_probs(h, np.array([t]))[0][0]
            before = t
        want.append(total)
    for lanes in (1, 3, 256):
        monkeypatch.setattr(m, "LANES", lanes)
        assert np.allclose(n.likelihood(docs), want, rtol=1e-4)
    assert len(n.likelihood([])) == 0


def test_gradients_by_differences():
    n = net(80)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    rng = np.random.default_rng(3)
    windows = rng.integers(0, n.n, (3, 6))
    windows[0, 4:] = -1
    seen = {}
    n._descend = lambda name, rows, g, memory: seen.update({name: (rows, g.copy())})

    def loss():
        total, h = 0.0, np.zeros((3, m.HIDDEN))
        for t in range(5):
            h = n.step(h, windows[:, t])[0]
            real = windows[:, t + 1] >= 0
            total -= n.log_probs(h[real], windows[:, t + 1][real])[0].sum()
        return total

    n.train(windows, {})
    count = (windows[:, 1:] >= 0).sum() / 64
    for name, at in (("u", (3, 7)), ("u", (5, 70)), ("c", (2, 1)), ("w", (0, 4, 9)), ("cb", (1,)), ("x", (int(windows[1, 0]), 11)), ("x", (int(windows[2, 2]), 90))):
        old = n.p[name][at]
        n.p[name][at] = old + 1e-4
        up = loss()
        n.p[name][at] = old - 1e-4
        down = loss()
        n.p[name][at] = old
        rows, g = seen[name]
        got = g[np.flatnonzero(rows == at[0])[0], at[1]] if name == "x" else g[at]
        assert got * count == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-3), (name, at)


def test_training_goes_through_whole_texts_with_the_state(monkeypatch):
    """Every token is a target once, and the states met are those of each text from its own start to its end."""
    n = net()
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(0, n.n - 1, k), n.n - 1).astype(np.int32) for k in (0, 1, 31, 32, 33, 500, 70, 64)]
    monkeypatch.setattr(m, "BATCH", 3)
    n._descend = lambda *a: None  # parameters stay, so that states can be compared
    met, log_probs = [], n.log_probs
    monkeypatch.setattr(n, "log_probs", lambda h, targets, grad=None: (met.append((h, targets)), log_probs(h, targets, grad))[1])
    assert n.learn(docs, {}) == sum(map(len, docs))
    want = []
    for d in docs:
        h, before = np.zeros((1, m.HIDDEN), np.float32), n.n - 1
        for t in d:
            h = n.step(h, np.array([before]))[0]
            want.append((int(t), *h[0, :4].round(3).tolist()))
            before = t
    got = [(int(t), *x[:4].round(3).tolist()) for h, targets in met for x, t in zip(h, targets)]
    assert len(got) == len(want)
    assert np.allclose(sorted(got), sorted(want), atol=3e-3)


def test_gradients_across_a_text_border():
    n = net(80)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    rng = np.random.default_rng(5)
    windows = rng.integers(0, n.n - 1, (2, 7))
    first = np.zeros((2, 6), bool)
    first[0, 3] = first[1, 0] = True
    start = rng.normal(0, 0.5, (2, m.HIDDEN))
    seen = {}
    n._descend = lambda name, rows, g, memory: seen.update({name: g.copy()})

    def loss():
        total, h = 0.0, start
        for t in range(6):
            h = n.step(np.where(first[:, t, None], 0.0, h), windows[:, t])[0]
            total -= n.log_probs(h, windows[:, t + 1])[0].sum()
        return total

    n.train(windows, {}, start, first)
    for at in ((3, 7), (5, 70), (20, 40)):
        old, found = n.p["u"][at], []
        for d in (1e-4, -1e-4):
            n.p["u"][at] = old + d
            found.append(loss())
        n.p["u"][at] = old
        assert seen["u"][at] * 12 / 64 == pytest.approx((found[0] - found[1]) / 2e-4, rel=2e-2, abs=2e-3)


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [w for w in re.split("[ \t\n\x0b\x0c\r]+", (t or "").translate(low)) if w]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [split(t) for i, t in rows if not held(i)]
    count, ends = Counter(w for x in train for w in x), len(train)
    total, distinct = sum(count.values()) + ends, len(count) + (ends > 0)
    out = []
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((ends + 1) / (total + distinct + 1))
        out.append((str(i), held(i), len(w) + 1, sum(count[x] > 0 for x in w) + (ends > 0), total, round(base, 6)))
    return sorted(out)


def scored(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    out = m.op4_lm_score(spark, str(tmp_path)).collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)


def test_base_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "HEAD", 8)  # most words go through the join
    rows = [(i, " ".join(f"W{(i * k) % 37}" for k in range(i % 23))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (7, rows[7][1]), (7, rows[7][1]), (None, "w1 w2"), (103, "É é " * 3000), (9, "another row of nine")]
    assert scored(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(2, "only held out words here")]])
def test_no_training_rows(spark, tmp_path, rows):
    rows = [(next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2), t) for _, t in rows]
    assert scored(spark, tmp_path, rows) == brute(rows)


def test_average_is_weighted_whatever_the_tree(spark, monkeypatch):
    import pickle

    monkeypatch.setattr(m, "FAN", 3)
    rows = [(i, float(i + 1), bytearray(pickle.dumps({"x": np.full((2, 2), i, np.float32)}))) for i in range(11)]
    got = m._average(spark.createDataFrame(rows, "task long, weight double, params binary"))
    want = sum(i * (i + 1) for i in range(11)) / sum(i + 1 for i in range(11))
    assert np.allclose(got["x"], want, rtol=1e-5)
    assert m._average(spark.createDataFrame([], "task long, weight double, params binary")) is None


def test_held_out_gain_over_the_base(spark, data):
    out = m.op4_lm_score(spark, data).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > out["b"]
