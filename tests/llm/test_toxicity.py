"""Toxicity: the composed machine, learnt terms, held-out accuracy, odd rows."""

import zlib

import numpy as np

from quillstack.llm import toxicity as m


def marks(grammar, text):
    row = grammar.features([text])[0]
    return {p for p, v in zip(m.PATTERNS, row) if v}


def test_patterns():
    g = m.Grammar(whole=dict.fromkeys(m.INSULTS, 1.0))
    assert marks(g, "What an idiot.") == {"insult_plain"}
    assert marks(g, "You are an idiot.") == {"insult_targeted"}
    assert marks(g, "You are not an idiot.") == {"insult_negated"}
    assert marks(g, "He said you are an idiot.") == {"insult_reported"}
    assert marks(g, "He said so. Idiot!") == {"insult_plain"}
    assert marks(g, "They kill. You murder") == {"threat_targeted"}
    assert marks(g, "Ich sage du bist kein Dummkopf") == {"insult_negated"}
    assert marks(g, "a fine day") == marks(g, "") == marks(g, None) == set()
    scores = g.score(g.features(["you idiot", "you are not an idiot", "a fine day", None, "", "x " * 10_000 + "idiot"]))
    assert scores[0] >= 0.7 > scores[1] > scores[2] == scores[3] == scores[4]
    assert scores[5] >= 0.7 and ((scores >= 0) & (scores <= 1)).all()


def test_composition_equals_running_the_parts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        symbols = rng.choice(m.SYMBOLS, 12)
        state, out = 0, []
        parts = [(t, t.start) for t in (m.NEGATION, m.TARGET, m.REPORT)]
        for s in symbols:
            out.append(m.EMIT[state][m.SYMBOLS.index(s)])
            state = m.GOTO[state][m.SYMBOLS.index(s)]
            steps = [(t, *t.step(x, s)) for t, x in parts]
            parts = [(t, x) for t, x, _ in steps]
            held = set().union(*(k for _, _, k in steps))
            how = next((k for k in ("reported", "negated", "targeted") if k in held), "plain")
            assert out[-1] == (m.PATTERNS.index(f"{s}_{how}") if s in ("insult", "threat") else -1)


def test_learns_terms_and_holds_out(spark):
    docs, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        filler = " ".join(f"w{(i * 7 + k) % 211}" for k in range(30))
        docs.append((i, filler + (f". grumpf{'abcdefghij'[i % 10]}en {filler}" if bad else ""), "x"))
        labels.append((i, 1, int(bad)))
    docs += [(None, "idiot", "x"), (2000, None, "x"), (2001, "", "x"), (0, docs[0][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxicity string")
    marked = spark.createDataFrame(labels + [(3, 1, 0), (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    kept = m.reject_toxic(frame, marked)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not [i for i in ids if i is not None and i < 900 and i % 6 == 0]
    assert len([i for i in ids if i is not None and i < 900]) == 750 and {2000, 2001} <= set(ids)
    assert m.reject_toxic(frame, marked.limit(0)).count() > 900
    assert m.reject_toxic(frame.limit(0), marked).count() == 0


def test_whole_query(spark, data):
    out = m.op9_toxicity(spark, data).collect()
    assert len(out) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in out if r["doc_id"] in toxic]
    assert np.mean([a == b for a, b in held]) > 0.9
