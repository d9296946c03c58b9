"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Each source gets a word target from its weight, at most ``EPOCHS`` times its
   size; the excess goes to the others by weight (water filling in closed form).
2. The mix is cut into blocks of ``BLOCK`` words.  Blocks go to sources, and a
   source's blocks to its shards, by the highest quotients target / (2 k + 1).
   Seats that any solution gives away come from a divisor bound; only the few
   quotients around the cut-off are ranked.  A source of fewer than ``FEW`` blocks
   takes its target to the word.  What a shard cannot hold, at ``EPOCHS`` times its
   words, goes to the source's next shards that can.
3. A shard's documents, in a seeded order, are one run of words, cut into blocks.
   The quota is taken as whole passes over the run, then as blocks by a seeded
   order of the blocks, the last of them in part.

A hot source is many shards, of about ``SHARD`` documents and ``SHARD_WORDS`` words
at most, so no window holds more than a shard's documents or blocks, or a summary
row per shard.  Nothing of the size of the data is broadcast.

Defined cases: null text has size 0 and takes nothing; a null source is a
source of its own, last; repeated rows are mixed each for itself; ties in the
order fall to the smaller id; sources without words get target 0; other columns
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import WORD, cut, table

WEIGHTS = (1, 2, 3)
EPOCHS = 3
BLOCK = 128
SHARD = 2048
SHARD_WORDS = 2 << 20
FEW = 16
SEED = 17
#: Source summaries up to this many rows (about 100 bytes each) may be broadcast.
SMALL = 20_000


def apportion(parts: DataFrame, by: list[str], key: list[Column], weight: str, seats: str, to: str) -> DataFrame:
    """``parts`` with the Sainte-Lague share ``to`` of ``seats`` per group ``by``; equal quotients fall by ``key``."""
    group = Window.partitionBy(*by)
    w, n, total = F.col(weight), F.count("*").over(group), F.sum(weight).over(group)
    s = F.col(seats)
    sure = F.when((s > n / 2) & (total > 0), F.greatest(F.lit(0), F.floor(w * (s - n / 2) / total + 0.5) - 1)).otherwise(0).cast("long")
    most = F.when(total > 0, F.floor(w * (s + n / 2) / total + 0.5) + 1).otherwise(0).cast("long")
    bounds = parts.withColumn("__sure", sure).withColumn("__most", F.when(w > 0, most).otherwise(F.lit(0).cast("long")))
    bounds = bounds.withColumn("__left", s - F.sum("__sure").over(group))
    steps = F.when(F.col("__most") > F.col("__sure"), F.sequence(F.col("__sure") + 1, F.col("__most")))
    offers = bounds.withColumn("__k", F.explode_outer(steps))
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(w / (F.col("__k") - 0.5)), *key, "__k")
    won = F.col("__k").isNotNull() & (F.row_number().over(order) <= F.col("__left"))
    return offers.withColumn("__won", won.cast("long")).groupBy(*parts.columns, "__sure").agg(F.sum("__won").alias("__more")).withColumn(to, F.col("__sure") + F.col("__more")).drop("__sure", "__more")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target) of rows (source, size); one row per source."""
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    # one row per source from here on: a window over all sources is a window over a summary
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weighed = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    everything = Window.partitionBy()
    cap = F.col("source_size") * float(epochs)
    by_cap = Window.orderBy(cap / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(by_cap), F.lit(0.0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levelled.select("source", "source_size", "n_docs", F.least(cap, F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``."""
    sized = cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    targets = source_targets(sized, weights, epochs)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    targets = apportion(targets.withColumn("__all", F.lit(0)).withColumn("__seats", seats), ["__all"], [F.asc_nulls_last("source")], "target", "__seats", "blocks")
    few = F.col("blocks") < FEW
    words = F.when(few, F.round("target")).otherwise(F.col("blocks") * block).cast("long")
    shards = F.greatest(F.ceil(F.col("n_docs") / SHARD), F.ceil(F.col("source_size") / SHARD_WORDS))
    whole = F.when(few, F.floor(F.col("target") / block)).otherwise(F.col("blocks")).cast("long")
    targets = cut(targets.select("source", "source_size", "target", whole.alias("blocks"), words.alias("source_words"), shards.alias("n_shards")))
    small = targets.count() <= SMALL
    held = targets.withColumnRenamed("source", "__source")
    placed = sized.join(F.broadcast(held) if small else held, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    seeded = lambda n, *c: F.md5(F.concat_ws(":", F.lit(str(n)), *[F.col(x).cast("string") for x in c]).cast("binary"))
    shard = F.conv(F.substring(seeded(seed + 1, "doc_id", "size"), 1, 8), 16, 10).cast("long") % F.col("n_shards")
    placed = placed.withColumn("shard", shard).withColumn("order", seeded(seed, "doc_id", "size"))
    quotas = cut(_quotas(placed, block, epochs))
    in_shard = Window.partitionBy("source", "shard")
    earlier = lambda *by: in_shard.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, *by: F.coalesce(F.sum(c).over(earlier(*by)), F.lit(0))
    cells = quotas.select("source", "shard", "shard_size", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("shard_size") / block) - 1)).alias("block"))
    cells = cells.withColumn("length", F.least(F.lit(block).cast("long"), F.col("shard_size") - F.col("block") * block)).withColumn("key", seeded(seed + 2, "source", "shard", "block"))
    cells = cells.withColumn("won", F.least(F.col("length"), F.greatest(F.lit(0), F.col("rest") - sum_before("length", "key", "block"))))
    cells = cells.withColumn("before", sum_before("won", "block")).select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "block", "won", "before")
    held = quotas.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "passes", "rest")
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard"))
    rows = placed.join(held, same, "left").drop("__source", "__shard").withColumn("start", sum_before("size", "order", "doc_id")).withColumn("at", F.floor(F.col("start") / block))
    rows = rows.join(cells, same & (F.col("at") == F.col("block")), "left")
    taken = F.coalesce(F.col("before") + F.least(F.col("start") - F.col("block") * block, F.col("won")), F.col("rest"))  # of the words before the document
    rows = rows.withColumn("held", taken).withColumn("next", F.coalesce(F.lead("held").over(in_shard.orderBy("start", F.col("start") + F.col("size"))), F.col("rest")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.col("passes") * F.col("size") + F.col("next") - F.col("held"), F.lit(0)).cast("long").alias("taken"))


def _quotas(placed: DataFrame, block: int, epochs: int) -> DataFrame:
    """(source, shard, shard_size, passes, rest): whole passes and further words of each shard that has words."""
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first("source_words").alias("source_words"))
    weighed = shards.filter("shard_size > 0").withColumn("weight", F.col("shard_size").cast("double"))
    seats = apportion(weighed, ["source"], [F.col("shard")], "weight", "blocks", "quota")
    room = F.col("shard_size") * epochs
    first = seats.withColumn("words", F.least(F.col("quota") * block, room)).withColumn("room", room - F.col("words"))
    of_source = Window.partitionBy("source")
    missing = F.col("source_words") - F.sum("words").over(of_source)
    before = F.coalesce(F.sum("room").over(of_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = first.withColumn("words", F.col("words") + F.least(F.col("room"), F.greatest(F.lit(0), missing - before)))
    passes = F.floor(F.col("words") / F.col("shard_size"))
    return full.select("source", "shard", "shard_size", passes.alias("passes"), (F.col("words") - passes * F.col("shard_size")).alias("rest"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
weighed AS (SELECT *, {list(map(float, WEIGHTS))}[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM sums),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * {EPOCHS}) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size * {EPOCHS} / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, greatest(CAST(ceil(n_docs / {SHARD}) AS BIGINT), CAST(ceil(source_size / {SHARD_WORDS}) AS BIGINT)) AS n_shards, least(source_size * {EPOCHS}.0::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
seats AS (SELECT source, row_number() OVER (ORDER BY target / (k - 0.5::DOUBLE) DESC, encode(source) NULLS LAST, k) AS place
  FROM (SELECT source, target, unnest(range(1, CAST(target // {BLOCK} AS BIGINT) + 3)) AS k FROM targets WHERE target > 0)),
won AS (SELECT source, count(*) AS blocks FROM seats WHERE place <= (SELECT CAST(round(sum(target) / {BLOCK}) AS BIGINT) FROM targets) GROUP BY source),
shares AS (SELECT t.*, CASE WHEN coalesce(blocks, 0) < {FEW} THEN CAST(floor(target / {BLOCK}) AS BIGINT) ELSE blocks END AS blocks,
    CAST(CASE WHEN coalesce(blocks, 0) < {FEW} THEN round(target) ELSE blocks * {BLOCK} END AS BIGINT) AS source_words
  FROM targets t LEFT JOIN won w ON t.source IS NOT DISTINCT FROM w.source),
placed AS (SELECT s.*, t.source_size, t.target, t.blocks, t.source_words, md5(concat_ws(':', '{SEED}', doc_id, size)) AS key,
    CAST('0x' || substr(md5(concat_ws(':', '{SEED + 1}', doc_id, size)), 1, 8) AS BIGINT) % t.n_shards AS shard
  FROM sized s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source),
shards AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(blocks) AS blocks, any_value(source_words) AS source_words, sum(sum(size)) OVER (PARTITION BY source) AS total
  FROM placed GROUP BY source, shard),
offers AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size / (k - 0.5::DOUBLE) DESC, shard, k) AS place
  FROM (SELECT *, unnest(range(1, CAST(blocks * shard_size / total AS BIGINT) + 3)) AS k FROM shards WHERE shard_size > 0)),
first AS (SELECT source, shard, any_value(shard_size) AS shard_size, any_value(source_words) AS source_words, least(count(*) FILTER (WHERE place <= blocks) * {BLOCK}, any_value(shard_size) * {EPOCHS}) AS words
  FROM offers GROUP BY source, shard),
rooms AS (SELECT *, shard_size * {EPOCHS} - words AS room, source_words - sum(words) OVER (PARTITION BY source) AS missing FROM first),
quotas AS (SELECT source, shard, shard_size, CAST(words + least(room, greatest(0, missing - coalesce(sum(room) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS words FROM rooms),
cells AS (SELECT *, least({BLOCK}, shard_size - block * {BLOCK}) AS length
  FROM (SELECT source, shard, shard_size, words % shard_size AS rest, unnest(range(0, CAST(ceil(shard_size / {BLOCK}) AS BIGINT))) AS block FROM quotas)),
drawn AS (SELECT *, least(length, greatest(0, rest - coalesce(sum(length) OVER (PARTITION BY source, shard ORDER BY md5(concat_ws(':', '{SEED + 2}', source, shard, block)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS won FROM cells),
prefix AS (SELECT source, shard, block, won, coalesce(sum(won) OVER (PARTITION BY source, shard ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn),
runs AS (SELECT p.*, q.words // q.shard_size AS passes, q.words % q.shard_size AS rest, coalesce(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM placed p LEFT JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard),
held AS (SELECT r.*, coalesce(s.before + least(r.start - s.block * {BLOCK}, s.won), r.rest) AS held
  FROM runs r LEFT JOIN prefix s ON r.source IS NOT DISTINCT FROM s.source AND r.shard = s.shard AND r.start // {BLOCK} = s.block)
SELECT doc_id, size, source_size, target, source, CAST(coalesce(passes * size + coalesce(lead(held) OVER following, rest) - held, 0) AS BIGINT) AS taken
FROM held WINDOW following AS (PARTITION BY source, shard ORDER BY start, start + size)
"""
