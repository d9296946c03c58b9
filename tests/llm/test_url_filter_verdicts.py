"""URL filter at its own number of buckets: verdicts of the undecided URLs against models counted in dictionaries; odd tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_quality_url import parts, rule

from quillstack.llm import url_filter as m


def counted(rows):
    count = {"allow": Counter(), "block": Counter()}
    for s, verdict in rows:
        for i in range(len(s)):
            for n in range(1, m.ORDER + 1):
                if i - n + 1 >= 0:
                    count[verdict][s[i - n + 1 : i + 1]] += 1
    return count


def score(count, s):
    total = {k: sum(v for g, v in c.items() if len(g) == 1) for k, c in count.items()}
    out = 0.0
    for i in range(len(s)):
        p = {}
        for k in count:
            p[k] = 1 / m.ALPHABET
            for n in range(1, m.ORDER + 1):
                seen = count[k][s[i - n + 1 : i + 1]] if i >= n - 1 else 0
                context = (total[k] if n == 1 else count[k][s[i - n + 1 : i]]) if i >= n - 1 else 0
                p[k] = (seen + m.A * p[k]) / (max(seen, context) + m.A)
        out += math.log(p["allow"]) - math.log(p["block"])
    return out / len(s)


def test_verdicts_at_production_size(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()}
    hosts = sorted({parts(u)[0] for u in urls.values()})
    held = {r["h"]: r["x"] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", (F.pmod(F.xxhash64("h"), F.lit(m.HOLD)) == 0).alias("x")).collect()}
    known = [(h, h + p + "$", v) for h, p, v in ((*parts(u), rule(*parts(u))[0]) for u in urls.values()) if v]
    count = counted((s, v) for h, s, v in known if not held[h])
    cells = Counter()
    for h, s, v in known:
        if held[h]:
            cells[max(-m.SPAN, min(m.SPAN, math.floor(score(count, s) * m.CELL))), v] += 1
    border = m.threshold([(c, cells[c, "allow"], cells[c, "block"]) for c in {c for c, _ in cells}])
    free = [r for r in m.op10_url_filter(spark, folder).collect() if r["rule"] is None]
    want = {r["page_id"]: score(count, r["host"] + r["path"] + "$") for r in free}
    assert len(free) > 100
    assert sum((r["verdict"] == "allow") == (want[r["page_id"]] >= border) for r in free) >= 0.98 * len(free)
    assert sum(abs(r["score"] - want[r["page_id"]]) < 0.02 for r in free) >= 0.95 * len(free)
    assert {r["verdict"] for r in free} <= {"allow", "block"}


def test_models_tell_accepted_from_rejected(spark):
    """URLs of unseen hosts go with the paths that the rules accept or reject."""
    rules = (("allow", "good.org/"), ("block", "bad.org/"))
    rows = [f"http://h{i}.good.org/article/{i}/reading" for i in range(300)] + [f"http://h{i}.bad.org/xxx/?{i}#casino-{i}".replace("?", "win-") for i in range(300)]
    new = [(f"http://other{i}.net/article/{i * 7}/reading", "allow") for i in range(40)] + [(f"http://other{i}.net/xxx/win-{i * 7}", "block") for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(rows + [u for u, _ in new])), "page_id long, url string")
    out = {r["page_id"]: r for r in m.judge(pages, rules).collect()}
    assert all(out[600 + i]["verdict"] == v and out[600 + i]["rule"] is None for i, (_, v) in enumerate(new))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (None, "no scheme"), (1, "")], [(1, "x://y"), (1, "x://y"), (2, "http://a.com/en/1"), (2, "http://a.com/en/1")], [(3, "http://" + "é" * 50 + ".com/en/" + "p" * 100_000)]])
def test_odd_tables(spark, rows):
    """Without accepted and rejected URLs the border is 0 and the empty models tell nothing."""
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    out = m.judge(frame).collect()
    assert len(out) == len(rows)
    assert all(r["rule"] == "com/en/" and r["verdict"] == "block" and r["score"] is None if "/en/" in r["path"] else r["rule"] is None and r["score"] is not None for r in out)
    if not any(r["rule"] for r in out):
        assert all(r["verdict"] == "allow" and r["score"] == 0 for r in out)
