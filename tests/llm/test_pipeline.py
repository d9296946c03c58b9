"""The pipeline: each stage on its own input, and the whole run on planted documents."""

import random

import corpus_pipeline as p
import pytest

from quillstack.llm import registry
from quillstack.llm._spark import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, stage string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(7)
    items = [(i, words(rng, 30)) for i in range(3)]
    common = words(rng, 55)
    rows, labels = [], []

    def add(i, text, stage, source="a"):
        rows.append((i, text, "en", source, len(text) if text is not None else None, stage))

    for i in range(300):
        bad = i % 5 == 0
        add(i, words(rng, 60) + (" you vile grobbler, " + words(rng, 10) if bad else ""), "toxic" if bad else "clean", "ab"[i % 2])
        labels.append((i, 1, int(bad)))
    for i in range(400, 408):
        add(i, f"{words(rng, 80)}\n{common}\n{words(rng, 80)}", "shared")
    base = words(rng, 200)
    for i in range(500, 504):
        parts = base.split()
        parts[17 * (i - 499)] = "changed"
        add(i, " ".join(parts), "copy")
    add(504, base, "copy")
    for i in range(600, 603):
        add(i, f"{words(rng, 30)} {items[i - 600][1].upper()} {words(rng, 30)}", "leak", None)
    add(700, None, "clean")
    add(701, "", "clean")
    add(702, "long " + words(rng, 20_000), "clean", "b")
    add(None, words(rng, 50), "clean")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), rows, common


def test_stages_are_named_in_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontamination", "mixing"]
    assert len(registry.QUERIES) == 10 and sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_decisions_take_effect_and_clean_documents_stay(spark, folder):
    at, rows, common = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        docs = cut(stage(spark, docs, at))
        if name != "mixing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    ids = lambda stage: {r[0] for r in rows if r[5] == stage}
    assert set(seen["toxicity"]) == {r[0] for r in rows} - ids("toxic")
    assert set(seen["line_dedup"]) == set(seen["toxicity"])
    holders = {i for i in ids("shared") if common in seen["line_dedup"][i]["text"]}
    assert holders == {max(ids("shared"))}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in seen["line_dedup"].values())
    assert set(seen["near_dup"]) == set(seen["line_dedup"]) - (ids("copy") - {min(ids("copy"))})
    assert set(seen["decontamination"]) == set(seen["near_dup"]) - ids("leak")
    assert set(seen["mixing"]) == set(seen["decontamination"])


def test_run_gives_the_last_stage(spark, folder):
    at, rows, _ = folder
    out = p.run(spark, at).collect()
    kept = {r[0] for r in rows if r[5] in ("clean", "shared")} | {500}
    assert {r["doc_id"] for r in out} == kept
    assert {"size", "source_size", "target", "taken"} <= set(out[0].asDict())


def test_empty_tables(spark, folder, tmp_path):
    at, _, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []
