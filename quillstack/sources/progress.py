"""Imports: progress of a source, counters, storage mode, request log; contracts of import and archive sources."""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTERS = ("scanned", "imported", "skipped", "filtered", "no_source", "errors", "missing_files")


@dataclass(frozen=True)
class Progress:
    """How far an import came."""

    position: int = 0
    done: bool = False
    error: str | None = None

    def text(self) -> str:
        return json.dumps(asdict(self))


def parsed(content: Column) -> Column:
    """struct(position, done, error) of a progress file: JSON, or a line ``done``, ``offset:N`` or ``error:message``; null for anything else."""
    text = F.btrim(content, F.lit(" \t\r\n"))
    made = lambda position, done, error: F.struct(position.cast("long").alias("position"), F.lit(done).alias("done"), error.cast("string").alias("error"))
    held = F.from_json(text, "position long, done boolean, error string")
    whole = F.when(held["position"].isNotNull() & held["done"].isNotNull(), F.struct(held["position"].alias("position"), held["done"].alias("done"), held["error"].alias("error")))
    return (
        F.when(text == "done", made(F.lit(0), True, F.lit(None)))
        .when(F.startswith(text, F.lit("error:")), made(F.lit(0), False, F.substring(text, 7, 1 << 30)))
        .when(text.rlike(r"^offset:\d{1,18}$"), made(F.substring(text, 8, 20), False, F.lit(None)))
        .otherwise(whole)
    )


def merged(stats: DataFrame, *keys: str) -> DataFrame:
    """Counters of several runs added up, and the imported URLs of all as a sorted list."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    return stats.groupBy(*keys).agg(*sums, F.sort_array(F.flatten(F.collect_list("imported_urls"))).alias("imported_urls"))


def storage_mode(source: str, target: str) -> str:
    """``hard_link`` if both paths are known and on one file system, else ``copy``."""
    try:
        return "hard_link" if os.stat(source).st_dev == os.stat(target).st_dev else "copy"
    except OSError:
        return "copy"


class ImportSource(ABC):
    """A reader of documents that may go on where it stopped; ``read`` gives the rows behind a position, all without one."""

    name = "source"
    resumes = False

    @abstractmethod
    def read(self, spark: SparkSession, position: int | None = None) -> DataFrame: ...

    def resume(self, spark: SparkSession, progress: Progress | None) -> DataFrame | None:
        """Rows that are left, none of a source that is done."""
        if progress and progress.done:
            return None
        return self.read(spark, progress.position if progress and self.resumes else None)


class TableSource(ImportSource):
    """Rows of a table by an increasing key, which is the position."""

    resumes = True

    def __init__(self, name: str, table: DataFrame, key: str):
        self.name, self.table, self.key = name, table, key

    def read(self, spark: SparkSession, position: int | None = None) -> DataFrame:
        return self.table if position is None else self.table.filter(F.col(self.key) > position)


class ArchiveSource(ABC):
    """Snapshots of URLs that an archive service holds: (url, captured, digest)."""

    service = "archive"

    @abstractmethod
    def snapshots(self, urls: DataFrame) -> DataFrame: ...


class TableArchive(ArchiveSource):
    """Snapshots out of a table, as a recorded answer or an index dump gives them."""

    def __init__(self, service: str, table: DataFrame):
        self.service, self.table = service, table

    def snapshots(self, urls: DataFrame) -> DataFrame:
        return self.table.join(urls.select("url").distinct(), "url", "left_semi").select("url", "captured", "digest")


def all_snapshots(sources: list[ArchiveSource], urls: DataFrame) -> DataFrame:
    """Snapshots of every source, with its service."""
    from ..operators.versions import merged as union

    return union({s.service: s.snapshots(urls) for s in sources})


def log_requests(log: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` appended to the request log: ids after the largest one, absent columns null."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = rows.withColumn("id", F.monotonically_increasing_id() + F.lit(top + 1))
    return log.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns]))
