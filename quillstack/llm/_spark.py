"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: ``\x20 \x09-\x0D``.
BLANK = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset (tests) a temporary one is set.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Let shuffle files go as soon as their query has ended, and hand Python few rows at once: rows may hold whole texts or sets.
_TIDY = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, queries drop their shuffle files when they end, as rounds that ``cut`` their results need them no longer, and hand Python small batches.  The session's settings come back after it."""
    held = {k: spark.conf.get(k, None) for k in _TIDY}
    try:
        for k, v in _TIDY.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: ``attach`` broadcasts up to so many rows and bytes; its filter has MARKS bitmaps of 4 KB.
ATTACH_ROWS = 100_000
ATTACH_BYTES = 16 << 20
MARKS = 2048


def attach(docs: DataFrame, few: DataFrame, value: str, to: str) -> DataFrame:
    """``docs`` with column ``to``: ``value`` of the row of ``few`` (doc_id, text_hash, value) that has its id and text, else null.

    ``few`` has one row for each key and concerns few documents.  A small one is
    broadcast.  Of a larger one a bitmap of its keys' hashes is, 8 MB at any
    size, and only the documents that it marks are exchanged for the join.
    """
    few = cut(few.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col(value).alias(to)))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash == F.col("__hash"))
    columns = [*[F.col(f"`{c}`") for c in docs.columns if c != to], F.col(to)]
    size = F.octet_length(F.to_json(F.struct(to)))
    rows, held = few.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if not rows:
        return docs.select(*columns[:-1], F.lit(None).cast(few.schema[to].dataType).alias(to))
    if rows <= ATTACH_ROWS and held <= ATTACH_BYTES:
        return docs.join(F.broadcast(few), same, "left").select(*columns)
    bit = lambda h: F.pmod(F.xxhash64(h, F.lit("mark")), F.lit(MARKS * 32768))
    marks = few.select(bit(F.col("__hash")).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("__marks"))
    at = docs.withColumn("__bit", bit(text_hash))
    tried = at.withColumn("__bucket", F.expr("bitmap_bucket_number(__bit + 1)")).join(F.broadcast(cut(marks)), "__bucket", "left")  # MARKS rows of 4 KB
    place = F.expr("bitmap_bit_position(__bit + 1)")
    byte = F.conv(F.hex(F.substring("__marks", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    marked = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    flagged = tried.withColumn("__marked", marked).drop("__bit", "__bucket", "__marks")
    other = flagged.filter("NOT __marked").withColumn(to, F.lit(None).cast(few.schema[to].dataType))
    return flagged.filter("__marked").join(few, same, "left").select(*columns).unionByName(other.select(*columns))


def sized(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """``df``, fresh from ``cut`` or ``packed`` and of ``rows`` rows, in no more partitions than its rows need."""
    return df.coalesce(max(1, -(-rows // per_task)))


def packed(df: DataFrame, per_task: int = 1 << 16) -> DataFrame:
    """``cut``, read in no more partitions than its bytes need: stages over few rows are then few tasks."""
    out = cut(df)
    rdd = out._jdf.queryExecution().analyzed().rdd()
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    held = path.getFileSystem(rdd.sparkContext().hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = max(1, -(-held // per_task))
    return out.coalesce(tasks) if tasks < rdd.getNumPartitions() else out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session, as in tests, may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="quillstack")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null or blank: empty)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where the optimizer would copy it into a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_literal(values, kind: str) -> Column:
    """Constant array of numbers; the optimizer folds it into one literal."""
    return F.split(F.lit(",".join(f"{v:.7g}" for v in values)), ",").cast(f"array<{kind}>")
