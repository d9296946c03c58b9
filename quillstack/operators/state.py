"""Small state tables: services, configurations, sources; and document saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime
from .work import change, delete, insert_new, upsert

KEEP_CONFIGS = 16


def config_changed(stored: Column, current: Column) -> Column:
    return ~stored.eqNullSafe(current)


def store_config(configs: DataFrame, source: str, digest: str) -> DataFrame:
    row = configs.sparkSession.createDataFrame([(source, digest)], "source_id string, config_hash string")
    return upsert(configs, row, ["source_id"])


def add_config(history: DataFrame, config: DataFrame, keep: int = KEEP_CONFIGS) -> DataFrame:
    """History with the configuration if its hash is new, cut to the newest ``keep``."""
    return insert_new(history, config, ["hash"]).orderBy(F.desc("created"), F.desc("hash")).limit(keep)


def services(states: DataFrame, kind: str | None = None) -> DataFrame:
    return (states if kind is None else states.filter(F.col("service_type") == kind)).orderBy("id")


def save(docs: DataFrame, delta: DataFrame) -> DataFrame:
    """Documents upserted by id, every column of ``delta``, with the category of their type."""
    if "mime_type" in delta.columns:
        delta = delta.withColumn("category_id", mime.category(F.col("mime_type")))
    return upsert(docs, delta, ["id"])


def save_by_url(docs: DataFrame, versions: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New documents, and new versions of known ones whose content changed; ``found`` has (source_url, content_hash)."""
    known = docs.select(F.col("id").alias("document_id"), "source_url")
    last = versions.groupBy("document_id").agg(F.max_by("content_hash", "id").alias("before"))
    both = found.join(known, "source_url", "left").join(last, "document_id", "left")
    return both.filter("document_id IS NULL").drop("document_id", "before"), both.filter("document_id IS NOT NULL").filter(~F.col("content_hash").eqNullSafe(F.col("before"))).drop("before")


def add_versions(versions: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` appended with ids after the largest one, unique but not dense."""
    top = versions.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return versions.unionByName(rows.withColumn("id", F.monotonically_increasing_id() + F.lit(top + 1)), allowMissingColumns=True)


def update(docs: DataFrame, ids: list[str], **values: Column) -> DataFrame:
    """Columns set for some documents."""
    return change(docs, F.col("id").isin(*ids), **values)


def summarised(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """Synopsis and tags of ``notes`` (id, synopsis, tags) written, the documents indexed."""
    new = notes.select(F.col("id"), F.col("synopsis").alias("__s"), F.col("tags").alias("__t"), F.lit(True).alias("__hit"))
    joined = docs.join(new, "id", "left")
    pick = {"synopsis": F.col("__s"), "tags": F.col("__t"), "status": F.lit("indexed")}
    return joined.select(*[F.when(F.col("__hit"), pick[c]).otherwise(F.col(c)).alias(c) if c in pick else F.col(c) for c in docs.columns])


def rename_source(tables: dict[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    return {n: change(t, F.col("source_id") == old, source_id=F.lit(new)) for n, t in tables.items()}


def repoint(results: DataFrame, keepers: DataFrame) -> DataFrame:
    """Analysis rows of duplicates moved to their keepers: (document_id, keeper)."""
    moved = results.join(keepers, "document_id", "left").withColumn("document_id", F.coalesce("keeper", "document_id")).drop("keeper")
    return moved.dropDuplicates(["document_id", "version_id", "analysis_type"]) if "analysis_type" in results.columns else moved


def drop_duplicates(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """Documents without those that a keeper stands for."""
    return delete(docs, keepers.filter("document_id <> keeper").select(F.col("document_id").alias("id")))


def set_annotation(docs: DataFrame, kind: str, version: int, data: Column) -> DataFrame:
    """``metadata`` (JSON object of strings) with an annotation record of ``kind``."""
    held = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(held, lambda k, _: k != f"annotation.{kind}")
    return docs.withColumn("metadata", F.to_json(F.map_concat(kept, F.create_map(F.lit(f"annotation.{kind}"), F.to_json(F.struct(F.lit(version).alias("version"), data.alias("data")))))))


def needing_annotation(docs: DataFrame, kind: str, version: int) -> DataFrame:
    """Documents without an annotation of ``kind``, or with an older version of it."""
    held = F.from_json(F.element_at(F.from_json("metadata", "map<string,string>"), f"annotation.{kind}"), "struct<version:int>")["version"]
    return docs.filter(held.isNull() | (held < version))


def copy_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet below ``path``."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def annotate(docs: DataFrame, records: DataFrame, now: int) -> DataFrame:
    """``metadata`` (JSON) with the annotation ``records`` (id, kind, version, data, error) of each document under ``annotations``; the update time is set."""
    entry = F.struct("kind", F.struct("version", "data", "error", F.lit(now).alias("at")).alias("record"))
    held = records.groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("__new"))
    one = "struct<version:int,data:string,error:string,at:bigint>"
    before = F.coalesce(F.from_json(F.get_json_object("metadata", "$.annotations"), f"map<string,{one}>"), F.create_map().cast(f"map<string,{one}>"))
    merged = F.map_concat(F.map_filter(before, lambda k, _: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False))), F.col("__new").cast(f"map<string,{one}>"))
    others = F.map_filter(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != "annotations")
    whole = F.to_json(F.struct(F.to_json(merged).alias("annotations"), others.alias("rest")))
    joined = docs.join(held, "id", "left")
    hit = F.col("__new").isNotNull()
    return joined.withColumn("metadata", F.when(hit, whole).otherwise(F.col("metadata"))).withColumn("updated", F.when(hit, F.lit(now)).otherwise(F.col("updated")).cast(docs.schema["updated"].dataType)).drop("__new")


def dated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with estimated_date, date_confidence and date_source set where ``found`` (id, date, confidence, source) has them."""
    new = found.select("id", F.col("date").alias("__d"), F.col("confidence").alias("__c"), F.col("source").alias("__s"))
    hit = F.col("__d").isNotNull()
    values = {"estimated_date": F.col("__d"), "date_confidence": F.col("__c"), "date_source": F.concat(F.lit("detected:"), "__s")}
    joined = docs.join(new, "id", "left")
    return joined.select(*[F.when(hit, v).otherwise(F.col(c) if c in docs.columns else F.lit(None)).alias(c) for c, v in values.items()], *[c for c in docs.columns if c not in values])


def add_pages(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages saved over those of the same document, version and number."""
    return upsert(pages, rows, ["document_id", "version_id", "page_number"])


def add_entities(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """Entity rows that are new by type, normalised text and document, appended."""
    return insert_new(entities, rows, ["entity_type", "normalized_text", "document_id"])


def migrated_paths(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored paths of ``ids`` (id, dedup_index) cleared, their dedup index set."""
    new = ids.select("id", F.col("dedup_index").alias("__i"), F.lit(True).alias("__hit"))
    path = F.when(F.col("__hit"), F.lit(None).cast("string")).otherwise(F.col("file_path")).alias("file_path")
    index = F.when(F.col("__hit"), F.col("__i")).otherwise(F.col("dedup_index") if "dedup_index" in versions.columns else F.lit(None)).alias("dedup_index")
    return versions.join(new, "id", "left").select(*[c for c in versions.columns if c not in ("file_path", "dedup_index")], path, index)


def tables(known: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of named tables."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in known.items()])
