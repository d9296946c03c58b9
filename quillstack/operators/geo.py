"""Entities on the map and searches over entities."""

from __future__ import annotations

from functools import reduce
from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Points of a region that are sent to all tasks at most.
MOST_POINTS = 2_000_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; up to 0.5 % off the spheroid."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def near(entities: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Documents with an entity in the radius; a latitude band and, away from the poles, a longitude band come first."""
    dlat = km / 111.0
    box = F.col("latitude").between(lat - dlat, lat + dlat)
    if abs(lat) + dlat < 85 and (dlon := dlat / cos(radians(abs(lat) + dlat))) < 180 - abs(lon):
        box &= F.col("longitude").between(lon - dlon, lon + dlon)
    inside = haversine(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) <= km
    return entities.filter(box & inside).select("document_id").distinct()


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Point in polygon by ray casting; ``ring`` is an array of [lon, lat] with the first point repeated at the end."""

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, i + 1)
        ax, ay, bx, by = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
        return ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / (by - ay) + ax)

    edges = F.sequence(F.lit(0), F.size(ring) - 2)
    return F.aggregate(edges, F.lit(False), lambda s, i: s != F.coalesce(crosses(i), F.lit(False)))


def in_region(entities: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """Documents with an entity inside the region: in an odd number of its rings, so holes count out."""
    shape = regions.filter(F.lower("name") == name.lower()).select(F.col("rings").alias("__rings"))
    points = entities.filter("latitude IS NOT NULL").join(F.broadcast(_one(shape)))  # one row of a checked size
    inside = F.aggregate("__rings", F.lit(False), lambda s, r: s != in_ring(F.col("latitude"), F.col("longitude"), r))
    return points.filter(inside).select("document_id").distinct()


def _one(shapes: DataFrame) -> DataFrame:
    """One row with the rings of all ``shapes``: regions of one name and several types count together."""
    out = shapes.agg(F.flatten(F.collect_list("__rings")).alias("__rings")).filter(F.size("__rings") > 0)
    points = out.agg(F.coalesce(F.sum(F.aggregate("__rings", F.lit(0), lambda s, r: s + F.size(r))), F.lit(0))).first()[0]
    if points > MOST_POINTS:
        raise ValueError(f"a region of {points} points; simplify it to {MOST_POINTS}")
    return out


def segment_km(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """Distance to the segment a-b of [lon, lat] points, in a plane around the point."""
    scale = F.cos(F.radians(lat)) * 111.32
    x = lambda p: (F.get(p, F.lit(0)) - lon) * scale
    y = lambda p: (F.get(p, F.lit(1)) - lat) * 111.32
    dx, dy = x(b) - x(a), y(b) - y(a)
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x(a) * dx + y(a) * dy) / length))).otherwise(0.0)
    return F.hypot(x(a) + t * dx, y(a) + t * dy)


def near_region(entities: DataFrame, regions: DataFrame, name: str, km: float) -> DataFrame:
    """Documents with an entity inside the region or within ``km`` of its border."""
    shape = regions.filter(F.lower("name") == name.lower()).select(F.col("rings").alias("__rings"))
    points = entities.filter("latitude IS NOT NULL").join(F.broadcast(_one(shape)))  # one row of a checked size
    lat, lon = F.col("latitude"), F.col("longitude")
    inside = F.aggregate("__rings", F.lit(False), lambda s, r: s != in_ring(lat, lon, r))
    close = F.exists("__rings", lambda r: F.exists(F.sequence(F.lit(0), F.size(r) - 2), lambda i: segment_km(lat, lon, F.get(r, i), F.get(r, i + 1)) <= km))
    return points.filter(inside | close).select("document_id").distinct()


def matching(entities: DataFrame, text: str, kind: str | None = None, exact: bool = True) -> DataFrame:
    """Documents with an entity whose normalised text equals or holds ``text``."""
    low = F.lit(text.lower())
    test = F.col("normalized_text") == low if exact else F.contains("normalized_text", low)
    if kind:
        test &= F.col("entity_type") == kind
    return entities.filter(test).select("document_id").distinct()


def all_of(entities: DataFrame, filters: list[tuple]) -> DataFrame:
    """Documents that fulfil every (text, type, exact) filter, in one pass; none without filters."""
    if not filters:
        return entities.select("document_id").limit(0)

    def test(text, kind, exact):
        low = F.lit(text.lower())
        hit = F.col("normalized_text") == low if exact else F.contains("normalized_text", low)
        return hit & (F.col("entity_type") == kind) if kind else hit

    tests = [test(*f) for f in filters]
    wanted = entities.filter(reduce(lambda a, b: a | b, tests))
    hits = wanted.groupBy("document_id").agg(*[F.bool_or(t).alias(f"f{i}") for i, t in enumerate(tests)])
    return hits.filter(reduce(lambda a, b: a & b, [F.col(f"f{i}") for i in range(len(tests))])).select("document_id")


def top(entities: DataFrame, kind: str, n: int) -> DataFrame:
    """Entities of a type in most documents; equal ones by text."""
    counts = entities.filter(F.col("entity_type") == kind).groupBy("entity_text").agg(F.countDistinct("document_id").alias("n_docs"))
    return counts.orderBy(F.desc("n_docs"), "entity_text").limit(n)


def materialise(found: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(document_id, entities array) as unique entity rows, locations with the coordinates of ``places`` (name, latitude, longitude)."""
    rows = found.select("document_id", F.explode("entities").alias("e")).select("document_id", F.col("e.type").alias("entity_type"), F.col("e.text").alias("entity_text"), F.lower("e.text").alias("normalized_text"))
    rows = rows.dropDuplicates(["entity_type", "normalized_text", "document_id"])
    if places is None:
        return rows
    known = places.groupBy(F.lower("name").alias("normalized_text")).agg(F.max_by(F.struct("latitude", "longitude"), F.col("population")).alias("at"), F.lit("location").alias("entity_type"))
    return rows.join(known, ["normalized_text", "entity_type"], "left").select(*rows.columns, "at.latitude", "at.longitude")


def cities(table: DataFrame) -> DataFrame:
    """Place names from (name, ascii_name, latitude, longitude, population): the most populous of a name."""
    both = table.select(F.lower("name").alias("name"), "latitude", "longitude", "population").unionByName(table.select(F.lower("ascii_name").alias("name"), "latitude", "longitude", "population"))
    return both.groupBy("name").agg(F.max_by(F.struct("latitude", "longitude", "population"), F.col("population")).alias("p")).select("name", "p.*")


def regions(geojson: DataFrame) -> DataFrame:
    """(name, type, iso, rings) of GeoJSON feature collections in column ``value``; the last of a name and type wins, by ``file`` (if there is one) and place in it."""
    schema = "struct<features:array<struct<properties:struct<name:string,type:string,iso:string>,geometry:struct<type:string,coordinates:string>>>>"
    file = F.col("file") if "file" in geojson.columns else F.lit("")
    feature = geojson.select(file.alias("file"), F.posexplode(F.from_json("value", schema)["features"]).alias("pos", "f"))
    ring = "array<array<array<double>>>"
    shape = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json("f.geometry.coordinates", f"array<{ring}>"))).otherwise(F.from_json("f.geometry.coordinates", ring))
    rows = feature.select("f.properties.name", "f.properties.type", "f.properties.iso", shape.alias("rings"), "file", "pos")
    last = rows.groupBy("name", "type").agg(F.max_by(F.struct("iso", "rings"), F.struct("file", "pos")).alias("r"))
    return last.select("name", "type", "r.iso", "r.rings")


def located(entities: DataFrame, notable: DataFrame, towns: DataFrame) -> DataFrame:
    """``entities`` (normalized_text) with coordinates: those of the notable place of that name, else of the most populous town."""
    first = notable.groupBy(F.lower("name").alias("normalized_text")).agg(F.min(F.struct("latitude", "longitude")).alias("__a"))
    then = cities(towns).select(F.col("name").alias("normalized_text"), F.struct("latitude", "longitude").alias("__b"))
    at = F.coalesce("__a", "__b")
    joined = entities.drop("latitude", "longitude").join(first, "normalized_text", "left").join(then, "normalized_text", "left")
    return joined.withColumn("latitude", at["latitude"]).withColumn("longitude", at["longitude"]).drop("__a", "__b")


def kinds(entities: DataFrame) -> DataFrame:
    """Number of entities by kind, named without underscores."""
    return entities.groupBy(F.replace("entity_type", F.lit("_"), F.lit("")).alias("kind")).agg(F.count("*").alias("n"))
