"""Quality rules: fixed text rules and a hashed n-gram likelihood ratio.

Words and word pairs fall into ``BUCKETS`` hash buckets.  The raw multinomial
counts them over all documents, the target multinomial over trusted documents:
those labelled good, at most ``TRUSTED`` of them (lowest id hash first).  A
document's verdict is the mean log ratio target / raw of its n-grams, kept at
``LEAST`` and above; the same text always gets the same verdict.

Counting is one aggregation of exploded buckets, summed per task first; scoring
is one map over the documents with the ratios held as an array of fixed size.
Nothing of the size of the data is shuffled.

Defined cases: null, empty or blank texts have no words, so they fail the base
rules.  Without labels nothing is rejected beyond the base rules.  Repeated
rows are judged alike; an id that any label calls good is trusted.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import BLANK, array_literal, let, table, words

BUCKETS = 1 << 15
TRUSTED = 20_000
LEAST = -0.15
SYMBOLS = "[#*$%&|<>]"


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(spelled: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(spelled) - 3), lambda i: F.xxhash64(F.get(spelled, i), F.get(spelled, i + 1), F.get(spelled, i + 2)))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(x - F.get(p, j - 1), F.lit(3)))), F.lit(0), lambda s, x: s + x)
    count = lambda h: let(placed(h), lambda s: let(F.sort_array(F.transform(twice(s), lambda e: e["i"])), covered))
    return F.when(F.size(spelled) < 4, 0).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(count(h))))


def features(spelled: Column) -> Column:
    """Bucket of each word and of each word pair."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    return F.transform(spelled, lambda w: bucket(w)), F.when(F.size(spelled) > 1, F.transform(F.sequence(F.lit(1), F.size(spelled) - 1), lambda i: bucket(F.get(spelled, i - 1), F.get(spelled, i)))).otherwise(F.array().cast("array<int>"))


def ratios(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> Column:
    """Constant array of log target / raw by bucket."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    flagged = docs.join(F.broadcast(good.withColumn("__good", F.lit(1))), "doc_id", "left")  # at most ``trusted`` ids
    spelled = flagged.select(F.coalesce("__good", F.lit(0)).alias("good"), words(F.col("text")).alias("words"))
    single, pair = features(F.col("words"))
    counts = spelled.select("good", F.explode(F.concat(single, pair)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    raw, hits = [0] * BUCKETS, [0] * BUCKETS
    for bucket, n, g in counts.collect():  # BUCKETS rows at most
        raw[bucket], hits[bucket] = n, g
    n_raw, n_hits = sum(raw) + BUCKETS, sum(hits) + BUCKETS
    if n_hits == BUCKETS:
        return array_literal([0] * BUCKETS, "float")
    return array_literal([math.log((g + 1) / n_hits) - math.log((n + 1) / n_raw) for n, g in zip(raw, hits)], "float")


def judge(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, counts, base_failed, ratio, kept) of every row of ``docs``."""
    table_ = ratios(docs.select("doc_id", "text"), labels)
    spelled = docs.select("doc_id", "text", words(F.col("text")).alias("words"))
    single, pair = features(F.col("words"))
    sums = lambda r: let(F.concat(single, pair), lambda cells: F.aggregate(cells, F.lit(0.0), lambda s, b: s + F.get(r, b)))
    counted = spelled.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        let(F.col("words"), repeat_words).cast("long").alias("n_repeat_words"),
        (let(table_, sums) / F.greatest(F.lit(1), 2 * F.size("words") - 1)).alias("ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio of every document."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
