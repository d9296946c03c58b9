"""Exports: document rows, annotation rows, tables, CSV quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import latest

DEFAULT, MOST = 10_000, 100_000


def limit(n: int | None = None) -> int:
    return min(DEFAULT if n is None else n, MOST)


def records(docs: DataFrame, versions: DataFrame, n: int | None = None, include_text: bool = False) -> DataFrame:
    """Newest documents with the type, size, pages and hash of their newest version, null without one; the text only if asked for."""
    fields = [c for c in ("mime_type", "file_size", "page_count", "content_hash") if c in versions.columns]
    rows = docs.orderBy(F.desc("updated"), "id").limit(limit(n)).drop("mime_type")
    last = latest(versions.join(rows.select(F.col("id").alias("document_id")), "document_id", "left_semi"), *fields).withColumnRenamed("document_id", "id")
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ssXXX").alias(f"{c}_at")
    text = [F.col("extracted_text")] if include_text else []
    return rows.join(last, "id", "left").select("id", "source_id", "title", "source_url", "status", "synopsis", "tags", stamp("created"), stamp("updated"), *fields, *text)


def csv(rows: DataFrame) -> DataFrame:
    """``records`` as CSV fields: no text, tags joined by semicolons, absent sizes and pages 0."""
    flat = {"synopsis": F.coalesce("synopsis", F.lit("")), "tags": F.array_join("tags", ";")} | {c: F.coalesce(c, F.lit(0)) for c in ("file_size", "page_count") if c in rows.columns}
    return rows.select(*[flat.get(c, F.col(c)).alias(c) for c in rows.columns if c != "extracted_text"])


def documents(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Newest rows without the text, tags joined by semicolons."""
    rows = docs.orderBy(F.desc("updated"), "id").limit(limit(n))
    return rows.select("id", "source_id", "title", "source_url", "status", "mime_type", F.coalesce("synopsis", F.lit("")).alias("synopsis"), F.array_join("tags", ";").alias("tags"))


def annotations(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Of the newest rows, those with a synopsis or tags: the limit comes first."""
    return docs.orderBy(F.desc("updated"), "id").limit(limit(n)).filter(F.col("synopsis").isNotNull() | (F.size("tags") > 0)).select("id", "synopsis", F.array_join("tags", ";").alias("tags"))


def quoted(value: Column) -> Column:
    """CSV field: quoted if it holds a comma, a quote or a line feed."""
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def write(frame: DataFrame, path: str, kind: str = "jsonl") -> None:
    """One output folder; ``json`` is one JSON array per part, ``jsonl`` one object per line."""
    if kind == "csv":
        frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "jsonl":
        frame.write.mode("overwrite").json(path)
    elif kind == "json":
        frame.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    elif kind == "parquet":
        frame.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def copy(source: DataFrame, target: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append to ``target``, and those it already has."""
    there = target.select(*keys)
    return source.join(there, keys, "left_anti"), source.join(there, keys, "left_semi")
