"""Line dedup: lines that many documents repeat stay in one document only.

Line hashes are range-partitioned by (hash, document), so a hot line spreads over
as many partitions as its documents fill, and sorted inside each partition by
hash, document and position.  A window streams over that order and lets a line's
first occurrence in each document through; the first occurrences are counted per
partition and hash (documents seen, last document), and a second, small
aggregation joins the parts.  The lines of frequent keys meet their keeper in a
broadcast join of checked size, or a salted one beyond it.  What leaves the
operator is a compressed keep bitmap per document: a set bit for each line that
stays, 64 lines a word, without the words whose bits are all set; no text.

Texts are read twice, once for their hashes and once for the result.  The
documents that lose lines meet their bitmaps in a broadcast of checked size;
beyond it a filter of fixed size (``attach``) lets all others pass unmoved.

Defined cases: a null or empty text is one empty line.  Repeated rows of one
id are one document; ids that are null count as no document and never keep a
frequent line.  A document that loses all lines stays, with an empty text.
An empty table gives an empty result.  Extra columns pass through; an input
column named ``n_lines`` or ``n_dropped`` is replaced by the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import BLANK, attach, cut, lower_az, table

MIN_CHARS = 40
MIN_DOCS = 5
SMALL = 500_000
SALT = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, keeps map<word, bits>) of the documents that lose lines; words that are not there have all bits set."""
    lines = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    trimmed = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).filter(F.char_length("line") >= min_chars)
    keyed = trimmed.select("doc_id", "text_hash", "pos", lower_az(F.col("line")).alias("key"))
    # cut: the range borders and both passes over the hashes read these rows, not the texts
    hashed = cut(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "pos", "text_hash"))
    drops = _join(hashed, cut(keepers(hashed, min_docs))).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bits = drops.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos & 63)"))).alias("bits"))
    return bits.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keeps"))


def keepers(hashed: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper) of the hashes that ``min_docs`` documents hold; ``hashed`` has (h1, h2, doc_id, pos)."""
    ranged = hashed.select("h1", "h2", "doc_id", "pos").repartitionByRange("h1", "h2", "doc_id")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    first = ranged.withColumn("place", place).filter("place = 1")
    held = first.groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return held.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def _join(lines: DataFrame, keepers: DataFrame) -> DataFrame:
    """``lines`` with their keeper.  Up to SMALL keepers (24 bytes each) are broadcast; more are joined, a line's rows dealt over SALT keys."""
    if keepers.count() <= SMALL:
        return lines.join(F.broadcast(keepers), ["h1", "h2"])
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    return salted.join(keepers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1)))), ["h1", "h2", "salt"]).drop("salt")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with text replaced by its kept lines, plus n_lines and n_dropped."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    # packed, so that no name of the input meets one of the operator
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in others]).alias("others"))
    joined = attach(packed, keep_bitmaps(docs, min_chars, min_docs), "keeps", "keeps")
    n_words = F.shiftright(F.size("lines") - 1, 6)
    dense = F.when(F.col("keeps").isNotNull(), F.transform(F.sequence(F.lit(0), n_words), lambda w: F.coalesce(F.element_at("keeps", w), F.lit(-1).cast("long"))))
    kept = F.filter("lines", lambda _, i: F.getbit(F.get("dense", F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))) == 1)
    out = joined.withColumn("lines", _lines(F.col("text"))).withColumn("dense", dense).withColumn("kept", F.when(F.col("keeps").isNull(), F.col("lines")).otherwise(kept))
    text = F.when(F.col("keeps").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return out.select(
        *[text.alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.col("others")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
