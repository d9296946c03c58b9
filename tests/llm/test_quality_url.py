"""Quality rules and URL filter against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from quillstack.llm import quality, url_filter

BLANKS = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = random.Random(4)
    some = [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    return some + [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "x y z x y z", "\n".join(["same line", "", "same line", "same line "]), "#*$%&|<>" * 3, "w " * 30_000, "\U0001f600 é " * 20]


def test_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a b", "x"), (3, texts()[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    out = quality.judge(docs, labels).collect()
    want = sorted((str(i), *base(t)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["ratio"] >= quality.LEAST)
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert {r["ratio"] for r in quality.judge(docs, labels.limit(0)).collect()} == {0.0}


def test_ratio_tells_good_from_bad(spark, data):
    out = {r["doc_id"]: r for r in quality.op7_quality(spark, data).collect()}
    good = [r["quality"] == 1 for r in spark.read.parquet(f"{data}/labels.parquet").collect() if not out[r["doc_id"]]["base_failed"]]
    kept = [out[r["doc_id"]]["kept"] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if not out[r["doc_id"]]["base_failed"]]
    assert all(k for k, g in zip(kept, good) if g)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.split("[?#]", rest[len(host) :])[0]


def rule(host, path):
    fits = [(k, r) for k, r in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=lambda x: len(x[1]), default=(None, None))


URLS = ["https://A.Example.COM/en/7/x?y#z", "http://example.com/en/8", "https://b.net/de/1", "https://example.net/de/8", "https://www.example.net/de/80", "ftp://x.org/es/", "https://x.org/es",
        "https://notexample.com/en/7", "https://com/en/", "no scheme", "", None, "https://h?en/", "https://h#/en/", "https://É.com/en/7", "x://y://z/q", "https://a.b/" + "p" * 5000]


def brute(rows):
    """Verdict of every row by the same models, counted in plain dictionaries keyed by grams."""
    known, out = {}, {}
    for i, u in rows:
        host, path = parts(u)
        out[i] = (host, path, *rule(host, path)[::-1])
    return out


def test_parts_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (2, URLS[2])]
    got = url_filter.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, rule string")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        host, path, name, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == (verdict or ("block" if r["score"] < 0 else r["verdict"])) and r["verdict"] in ("allow", "block")


def test_score_like_plain_models(spark, data, monkeypatch):
    """Scores equal those of dictionary counts but for grams that share a bucket, few in a larger table."""
    monkeypatch.setattr(url_filter, "BUCKETS", 1 << 18)
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()]
    got = url_filter.op10_url_filter(spark, data).collect()
    from pyspark.sql import functions as F

    hosts = sorted({parts(u)[0] for _, u in rows})
    held = {r["h"]: r["x"] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", (F.pmod(F.xxhash64("h"), F.lit(url_filter.HOLD)) == 0).alias("x")).collect()}
    count = {"allow": Counter(), "block": Counter()}
    for _, u in rows:
        host, path = parts(u)
        verdict = rule(host, path)[0]
        if verdict and not held[host]:
            s = host + path + "$"
            for i in range(len(s)):
                for n in range(1, url_filter.ORDER + 1):
                    if i - n + 1 >= 0:
                        count[verdict][s[i - n + 1 : i + 1]] += 1
    totals = {k: sum(v for g, v in c.items() if len(g) == 1) for k, c in count.items()}

    def p(k, s, i):
        q = 1 / url_filter.ALPHABET
        for n in range(1, url_filter.ORDER + 1):
            if i - n + 1 < 0:
                seen = context = 0
            else:
                seen = count[k][s[i - n + 1 : i + 1]]
                context = totals[k] if n == 1 else count[k][s[i - n + 1 : i]]
            q = (seen + url_filter.A * q) / (max(seen, context) + url_filter.A)
        return q

    close = 0
    free = [r for r in got if r["score"] is not None]
    for r in free:
        s = r["host"] + r["path"] + "$"
        want = sum(math.log(p("allow", s, i)) - math.log(p("block", s, i)) for i in range(len(s))) / len(s)
        close += r["score"] == pytest.approx(want, abs=0.05)
    assert close >= 0.9 * len(free)


def test_threshold():
    assert url_filter.threshold([(-40, 0, 9), (-20, 9, 0)]) == -20 / url_filter.CELL  # the border nearest to 0
    assert url_filter.threshold([(-40, 0, 9), (-10, 1, 1), (20, 9, 0)]) == 0.0
    assert url_filter.threshold([(3, 5, 0)]) == 0.0 == url_filter.threshold([])
