"""URL filter: rules first, then a ratio of two character language models.

URLs that a rule decides train two variable-order Markov models, one of
accepted and one of rejected URLs, over host, path and an end mark.  A
character after a context of up to ``ORDER - 1`` characters has the probability

    P_n(c | h) = (count(h c) + A * P_{n-1}(c | shorter h)) / (count(h) + A)

down to a uniform distribution.  Counts live in ``BUCKETS`` hash buckets per
order, so the models have a fixed size at any input.  A URL is judged by its
log-likelihood difference per character; the threshold is calibrated on the
rule-decided URLs whose host hash is 0 mod ``HOLD`` and which the models have
not seen: the histogram cell border with the least balanced error.

All of it is DataFrame work: counts are one aggregation over exploded
characters; to score, the characters meet the counts in broadcast tables of at
most ``BUCKETS`` rows and are added up by URL before anything is exchanged.

Defined cases: a null URL or one without ``://`` has empty host and path and no
rule.  If no rule accepts or none rejects a URL, undecided URLs are allowed.
Longest rule wins; equal rules are one.  Repeated rows are judged alike.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, lower_az, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 4
BUCKETS = 1 << 16
A = 4.0
ALPHABET = 128.0
HOLD = 5
#: Score histogram cells of 1/32 nat per character, from -8 to 8.
CELL = 32.0
SPAN = 256


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.coalesce(lower_az(host), F.lit("")), F.coalesce(F.substring_index(F.substring_index(after, "?", 1), "#", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(set(rules), key=lambda r: (len(r[1]), r)):  # later ones win
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _codes(host: Column, path: Column) -> Column:
    return F.transform(F.split(F.concat(host, path, F.lit("$")), ""), F.ascii)


def _bucket(codes: str, i: Column, n: int) -> Column:
    """Bucket of the ``n`` characters that end at place ``i``; places before the start add nothing."""
    return F.pmod(F.xxhash64(F.lit(n), *[F.get(codes, i - k) for k in range(n)]), F.lit(BUCKETS)).cast("int")


def _places(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` once for each place ``i`` of their ``codes``: with the buckets of its grams, g1 to gORDER, and of their contexts, from h1."""
    of = lambda i: [i.alias("i"), *[_bucket("codes", i, n).alias(f"g{n}") for n in range(1, ORDER + 1)], *[_bucket("codes", i - 1, n).alias(f"h{n}") for n in range(1, ORDER)]]
    return rows.select(*columns, F.inline(F.transform("codes", lambda _, i: F.struct(*of(i)))))


def _model(known: DataFrame) -> DataFrame:
    """(n, bucket, a, b): counts of the accepted and the rejected URLs' grams by order and bucket, ORDER * BUCKETS rows at most."""
    grams = _places(known, ["accepted"]).select("accepted", F.posexplode(F.array(*[f"g{n}" for n in range(1, ORDER + 1)])).alias("n", "bucket"))
    return cut(grams.groupBy((F.col("n") + 1).alias("n"), "bucket").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("b")))


def _scored(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and score of ``rows`` (keys, codes): log P(accepted) - log P(rejected), divided by the number of characters.

    Every character meets the counts of its grams and their contexts in tables of
    at most BUCKETS rows, which are broadcast; a URL's characters are added up in
    the task that reads it.
    """
    total = model.filter("n = 1").agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("double") for k in "ab"]).first()
    i = F.col("i")
    # rows are told apart by an id, for keys may repeat
    out = _places(rows.withColumn("row", F.monotonically_increasing_id()), ["row", *keys])
    for name, n in [(f"g{n}", n) for n in range(1, ORDER + 1)] + [(f"h{n}", n) for n in range(1, ORDER)]:
        held = model.filter(F.col("n") == n).select(F.col("bucket").alias(name), F.col("a").alias(f"{name}a"), F.col("b").alias(f"{name}b"))
        out = out.join(F.broadcast(held), name, "left")  # BUCKETS rows of 20 bytes at most
    logs = {}
    for k, whole in zip("ab", total):
        p = F.lit(1.0 / ALPHABET)
        for n in range(1, ORDER + 1):
            seen = F.coalesce(F.col(f"g{n}{k}"), F.lit(0)).cast("double")
            before = F.lit(whole) if n == 1 else F.coalesce(F.col(f"h{n - 1}{k}"), F.lit(0)).cast("double")
            if n > 1:
                seen, before = F.when(i >= n - 1, seen).otherwise(0.0), F.when(i >= n - 1, before).otherwise(0.0)
            p = (seen + F.lit(A) * p) / (F.greatest(before, seen) + F.lit(A))
        logs[k] = F.log(p)
    return out.groupBy("row", *keys).agg((F.sum(logs["a"] - logs["b"]) / F.count("*")).alias("score")).drop("row")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    codes = _codes(F.col("host"), F.col("path")).alias("codes")
    known = ruled.filter("ruled IS NOT NULL").select(codes, (F.col("ruled") == "allow").alias("accepted"), (F.pmod(F.xxhash64("host"), F.lit(HOLD)) == 0).alias("held"))
    model = _model(known.filter("NOT held"))
    cell = F.least(F.greatest(F.floor(F.col("score") * CELL), F.lit(-SPAN)), F.lit(SPAN))
    scores = _scored(known.filter("held").select("accepted", "codes"), model, ["accepted"])
    cells = scores.groupBy(cell.alias("cell")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("b")).collect()  # 2 * SPAN + 1 rows at most
    border = threshold([(r["cell"], r["a"], r["b"]) for r in cells])
    free = _scored(ruled.filter("ruled IS NULL").select("page_id", "host", "path", codes), model, ["page_id", "host", "path"])
    method = F.when(F.col("score") < border, "block").otherwise("allow")
    decided = ruled.filter("ruled IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return decided.unionByName(free.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), method.alias("verdict"), "score"))


def threshold(cells: list[tuple[int, int, int]]) -> float:
    """Border of least balanced error: accepted below it plus rejected from it on; 0 without both kinds, nearest to 0 on ties."""
    accepted, rejected = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not accepted or not rejected:
        return 0.0
    error = lambda t: sum(a for c, a, _ in cells if c < t) / accepted + sum(b for c, _, b in cells if c >= t) / rejected
    return min(range(-SPAN, SPAN + 2), key=lambda t: (round(error(t), 9), abs(t))) / CELL


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
