"""Content hashes: duplicate groups, keepers, changes, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import latest


def cross_source(versions: DataFrame, docs: DataFrame) -> DataFrame:
    """Newest hashes that several sources hold."""
    held = latest(versions, "content_hash").join(docs.select(F.col("id").alias("document_id"), "source_id"), "document_id")
    return (
        held.groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.countDistinct("source_id").alias("n_sources"), F.min("document_id").alias("first_id"))
        .filter("n_sources > 1").select(F.substring("content_hash", 1, 16).alias("prefix"), "n_docs", "n_sources", "first_id")
    )


def dedup_groups(versions: DataFrame) -> DataFrame:
    """Hashes of any version that more than one document has."""
    return versions.filter("content_hash <> ''").groupBy("content_hash").agg(F.countDistinct("document_id").alias("n_docs")).filter("n_docs > 1")


def completeness(text: Column, synopsis: Column, tags: Column) -> Column:
    """Bytes of text, plus 1000 for a synopsis and 500 for tags."""
    return F.coalesce(F.octet_length(text), F.lit(0)) + F.when(synopsis.isNotNull(), 1000).otherwise(0) + F.when(F.size(tags) > 0, 500).otherwise(0)


def keepers(docs: DataFrame, versions: DataFrame, strategy: str = "most_complete") -> DataFrame:
    """(document_id, keeper) for the documents of each duplicate group of newest hashes.

    The keeper is the oldest, the newest or the most complete; among equals the
    last id.  One aggregation finds it, so a large group needs no window.
    """
    score = {"oldest": -F.col("created"), "newest": F.col("created"), "most_complete": completeness(F.col("extracted_text"), F.col("synopsis"), F.col("tags")).cast("long")}[strategy]
    held = latest(versions, "content_hash").join(docs.select(F.col("id").alias("document_id"), score.alias("score")), "document_id")
    best = held.groupBy("content_hash").agg(F.max(F.struct("score", "document_id"))["document_id"].alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    return held.join(best, "content_hash").select("document_id", "keeper")


def changes(versions: DataFrame) -> DataFrame:
    """Versions whose hash differs from the one before, and first versions."""
    before = F.lag("content_hash").over(Window.partitionBy("document_id").orderBy("id"))
    return versions.withColumn("before", before).filter(~F.col("content_hash").eqNullSafe(F.col("before"))).drop("before")


def dedup_index(versions: DataFrame) -> DataFrame:
    """How many equal names with the same hash start came before, by version id."""
    name = Window.partitionBy("original_filename", F.substring("content_hash", 1, 8)).orderBy("id")
    return versions.withColumn("dedup_index", F.row_number().over(name) - 1)


def snapshots(frame: DataFrame) -> DataFrame:
    """Earliest snapshot of each digest; snapshots without digest all stay."""
    known = frame.filter("digest IS NOT NULL")
    first = known.groupBy("digest").agg(F.min(F.struct("captured", *[c for c in frame.columns if c not in ("digest", "captured")])).alias("s"))
    return first.select("digest", "s.*").select(*frame.columns).unionByName(frame.filter("digest IS NULL"))


def differing(frame: DataFrame, digest: str) -> DataFrame:
    return frame.filter(~F.col("digest").eqNullSafe(F.lit(digest)))


def newest(frame: DataFrame, keep: int, key: str = "id") -> DataFrame:
    """The ``keep`` newest rows."""
    return frame.orderBy(F.desc(key)).limit(keep)


def extreme(frame: DataFrame, last: bool = True) -> DataFrame:
    """The last (or first) captured snapshot of each URL."""
    fields = F.struct(*[c for c in frame.columns if c != "url"])
    return frame.groupBy("url").agg((F.max_by if last else F.min_by)(fields, F.col("captured")).alias("s")).select("url", "s.*")


def merged(services: dict[str, DataFrame]) -> DataFrame:
    """Snapshots of several archive services as one table, with the service's name."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [f.withColumn("service", F.lit(n)) for n, f in services.items()])


def existing_file(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (sha, blake, size) with the path of a stored file that agrees in all three, of several the least; null if there is none."""
    keys = ["sha", "blake", "size"]
    held = versions.select(F.col("content_hash").alias("sha"), F.col("content_hash_blake3").alias("blake"), F.col("file_size").alias("size"), F.col("file_path").alias("path"))
    return wanted.join(held.groupBy(*keys).agg(F.min("path").alias("path")), keys, "left")


def same_content(a: Column, b: Column) -> Column:
    """Equal only if both are known."""
    return F.coalesce(a == b, F.lit(False))
