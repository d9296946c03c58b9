"""Chat formatting: quotation linking.

A line's quote level is the number of ``>`` marks it begins with.  Runs of lines
of one level are passages.  Passages and their lines are normalised (A-Z
lower-cased, white space runs to one space), hashed and linked, inside a
conversation, to the latest earlier message whose own text, paragraphs or lines
have the same hash.  A message replies to the original of its shallowest linked passage;
among several originals whole passages beat lines, then the latest turn wins.
Threads follow replies up to a message that replies to none, by pointer
doubling, each round cut by checkpoint().

Rows are never gathered by conversation: work runs by (conversation, hash, run of
turns) and (conversation, turn), so a hot conversation spreads out, and so does a
line that many of its messages hold and quote; no pairs of them are made.  Reply order is
(conv_id, thread, turn): a reply comes after what it answers, threads in order
of their first message.

Defined cases: null text is empty; messages without conversation or turn are
not linked and are threads of their own turn; repeated rows of one turn get the
same link; an introduction like "On Monday X wrote:" right before a quotation
goes with it.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, let, lower_az, table

_MARK = r"^[ \t]*(>[> \t]*)"
_INTRO = r"wrote:[ \t]*$"
#: Turns of a conversation that are sorted together.
SPAN = 1024


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def level(line: Column) -> Column:
    mark = F.regexp_extract(line, _MARK, 1)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def content(line: Column) -> Column:
    return F.regexp_replace(line, _MARK, "")


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(lower_az(text), r"[ \t\n\x0B\f\r]+", " "))


def body(text: Column) -> Column:
    """The text without quotations; a text without any stays as it is."""

    def kept(lines):
        quoted = lambda i: F.coalesce(level(F.get(lines, i)) > 0, F.lit(False))
        return F.filter(lines, lambda x, i: (level(x) == 0) & ~(x.rlike(_INTRO) & quoted(i + 1)))

    return F.when(F.coalesce(text, F.lit("")).rlike("(?m)" + _MARK), F.btrim(F.array_join(let(_lines(text), kept), "\n"), F.lit("\n"))).otherwise(F.coalesce(text, F.lit("")))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, origin, h1, h2): each message's own text, paragraphs and lines."""
    own = messages.select("conv_id", "turn", body(F.col("text")).alias("body"))
    units = F.array_distinct(F.transform(F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")), lambda u: normal(u)))
    return own.select("conv_id", F.col("turn").alias("origin"), F.explode(units).alias("unit")).filter("unit <> ''").select("conv_id", "origin", *_hashes(F.col("unit")))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, run, level, whole, h1, h2): quoted passages (whole) and their lines."""
    quoted = messages.filter(F.col("text").rlike("(?m)" + _MARK)).select("conv_id", "turn", F.xxhash64("text").alias("row"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    message = Window.partitionBy("conv_id", "turn", "row").orderBy("pos")
    levels = quoted.withColumn("level", level(F.col("line")))
    runs = levels.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(message)).cast("int")).withColumn("run", F.sum("new").over(message)).filter("level > 0")
    kept = runs.select("conv_id", "turn", "row", "run", "level", "pos", content(F.col("line")).alias("line")).distinct()
    whole = kept.groupBy("conv_id", "turn", "row", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), " ").alias("line")).withColumn("whole", F.lit(True))
    units = whole.unionByName(kept.drop("pos").withColumn("whole", F.lit(False))).withColumn("line", normal(F.col("line"))).filter("line <> ''")
    return units.select("conv_id", "turn", "row", "run", "level", "whole", *_hashes(F.col("line")))


def latest(quotes: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, h1, h2, turn, origin) of the ``quotes`` (conv_id, h1, h2, turn) that an earlier turn of ``known`` (conv_id, origin, h1, h2) has: the last one before.

    Quotes and originals are sorted as one and the last original is carried
    along, so no quote meets all originals.  A hash's turns are cut into runs of
    ``SPAN``; what a run's beginning needs comes from one row per run before it.
    """
    key = ["conv_id", "h1", "h2"]
    asked = quotes.distinct().withColumn("origin", F.lit(None).cast(known.schema["origin"].dataType))
    both = asked.unionByName(known.withColumn("turn", F.col("origin"))).withColumn("part", F.floor(F.col("turn") / SPAN))
    before = Window.partitionBy(*key, "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("origin", ignorenulls=True).over(before)).filter("origin IS NULL").drop("origin")
    runs = both.groupBy(*key, "part").agg(F.max("origin").alias("top"), F.bool_or(F.col("origin").isNull()).alias("asked"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    far = runs.withColumn("far", F.max("top").over(earlier)).filter("asked AND far IS NOT NULL").select(*key, "part", "far")
    return near.join(far, [*key, "part"], "left").withColumn("origin", F.coalesce("near", "far")).filter("origin IS NOT NULL").select(*key, "turn", "origin")


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_quotes, n_linked) of the messages with quotations."""
    units = cut(passages(messages))
    origin = latest(units.select("conv_id", "h1", "h2", "turn"), originals(messages))
    best = units.join(origin, ["conv_id", "h1", "h2", "turn"]).groupBy("conv_id", "turn", "row", "run", "level").agg(F.max(F.struct("whole", "origin")).alias("best"))
    linked = best.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (~F.col("best.whole")).alias("part"), (-F.col("best.origin")).alias("back"))).alias("top"), F.count("*").alias("n_linked"))
    quotes = units.filter("whole").groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    return quotes.join(linked, ["conv_id", "turn"], "left").select("conv_id", "turn", (-F.col("top.back")).alias("reply_to"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): first message of the thread, for messages that reply."""
    now = cut(links.filter("reply_to IS NOT NULL").select("conv_id", "turn", F.col("reply_to").alias("thread")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        step = cut(now.join(up, ["conv_id", "thread"], "left"))
        if not step.filter("above IS NOT NULL").limit(1).count():
            return now
        now = step.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"))


def link(messages: DataFrame) -> DataFrame:
    """Rows of ``messages`` (conv_id, turn, role, text) with reply_to, thread, n_quotes, n_linked and ``body``."""
    messages = messages.select("conv_id", "turn", "role", "text")
    links = cut(replies(messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")))
    found = links.join(threads(links), ["conv_id", "turn"], "left").withColumnsRenamed({"conv_id": "__conv", "turn": "__turn"})
    out = messages.join(found, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    none = F.lit(0).cast("long")
    return out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("n_quotes", none).alias("n_quotes"), F.coalesce("n_linked", none).alias("n_linked"), body(F.col("text")).alias("body"),
    )


def op6_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, n_quotes, n_linked, body_sha256 of every message."""
    out = link(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "turn", "role", "reply_to", "thread", "n_quotes", "n_linked", F.sha2("body", 256).alias("body_sha256"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = "trim(regexp_replace(" + _LOW + r", '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_BARE = "list_filter(ls, lambda x, i: v[i] = 0 AND NOT (regexp_matches(x, 'wrote:[ \\t]*$') AND coalesce(v[i + 1] > 0, false)))"
SQL = rf"""
WITH RECURSIVE m AS (
  SELECT *, string_split(t, chr(10)) AS ls, list_transform(string_split(t, chr(10)), lambda x: length(regexp_replace(regexp_extract(x, '^[ \t]*(>[> \t]*)', 1), '[^>]', '', 'g'))) AS v
  FROM (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations)),
b AS (SELECT *, CASE WHEN list_max(v) > 0 THEN trim(array_to_string({_BARE}, chr(10)), chr(10)) ELSE t END AS body FROM m),
known AS (SELECT * FROM b WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
own AS (SELECT DISTINCT conv_id, turn AS origin, {_NORMAL.format("u")} AS unit FROM (
  SELECT conv_id, turn, unnest(list_concat(list_concat([body], regexp_split_to_array(body, '\n[ \t]*\n')), string_split(body, chr(10)))) AS u FROM known)),
l AS (SELECT DISTINCT conv_id, turn, t, pos, v[pos] AS level, regexp_replace(ls[pos], '^[ \t]*(>[> \t]*)', '') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS pos FROM known WHERE list_max(v) > 0)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, t ORDER BY pos) AS run FROM (
  SELECT *, CASE WHEN level <> lag(level, 1, -1) OVER (PARTITION BY conv_id, turn, t ORDER BY pos) THEN 1 ELSE 0 END AS new FROM l)),
units AS (SELECT conv_id, turn, t, run, level, whole, {_NORMAL.format("line")} AS unit FROM (
  SELECT conv_id, turn, t, run, level, true AS whole, string_agg(line, ' ' ORDER BY pos) AS line FROM r WHERE level > 0 GROUP BY conv_id, turn, t, run, level
  UNION ALL SELECT conv_id, turn, t, run, level, false, line FROM r WHERE level > 0)),
best AS (SELECT conv_id, turn, t, run, level, max(whole) AS whole, max(origin) FILTER (WHERE whole) AS o1, max(origin) AS o2 FROM units JOIN own USING (conv_id, unit) WHERE unit <> '' AND origin < turn GROUP BY conv_id, turn, t, run, level),
linked AS (SELECT conv_id, turn, arg_min(coalesce(o1, o2), (level, NOT whole, -coalesce(o1, o2))) AS reply_to, count(*) AS n_linked FROM best GROUP BY conv_id, turn),
quotes AS (SELECT conv_id, turn, count(*) AS n_quotes FROM units WHERE whole AND unit <> '' GROUP BY conv_id, turn),
up AS (SELECT conv_id, turn, reply_to AS thread FROM linked UNION ALL SELECT up.conv_id, up.turn, linked.reply_to FROM up JOIN linked ON linked.conv_id = up.conv_id AND linked.turn = up.thread),
threads AS (SELECT conv_id, turn, min(thread) AS thread FROM up GROUP BY conv_id, turn)
SELECT b.conv_id, b.turn, role, reply_to, coalesce(thread, b.turn) AS thread, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, sha256(body) AS body_sha256
FROM b LEFT JOIN linked ON b.conv_id = linked.conv_id AND b.turn = linked.turn LEFT JOIN quotes ON b.conv_id = quotes.conv_id AND b.turn = quotes.turn
LEFT JOIN threads ON b.conv_id = threads.conv_id AND b.turn = threads.turn
"""
