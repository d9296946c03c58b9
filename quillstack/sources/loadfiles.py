"""E-discovery load files: DAT records, OPT page lists, and their import."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The field delimiter as one byte and in UTF-8, the separator, and header names.
QUOTES = (b"\xc3\xbe", b"\xfe")
SEPARATOR = b"\x14"
BEGIN, END = ("begin bates", "begbates", "begdoc"), ("end bates", "endbates", "enddoc")


def fields(line: bytes, keep_empty: bool = False) -> list[str]:
    """Values between delimiters; empty ones are dropped, which shifts later columns, unless ``keep_empty``."""
    line = line.replace(b"\r", b"").replace(b"\n", b"")
    quote = next((q for q in QUOTES if q in line), None)
    if quote is None:
        parts = line.split(SEPARATOR)
    elif keep_empty:
        parts = [p.removeprefix(quote).removesuffix(quote) for p in line.split(SEPARATOR)]
    else:
        parts = line.replace(SEPARATOR, b"").split(quote)
    values = [p.decode("utf-8", "replace") for p in parts]
    return values if keep_empty else [v for v in values if v]


def _place(header: list[str], names: tuple[str, ...]) -> int | None:
    low = [h.strip().lower() for h in header]
    return next((i for n in names for i, h in enumerate(low) if h.replace(" ", "") == n.replace(" ", "")), None)


def record(header: list[str], line: bytes, keep_empty: bool = False) -> dict | None:
    """begin, end and the values of a line; None without a begin, end defaults to begin."""
    begin, end = _place(header, BEGIN), _place(header, END)
    begin = 0 if begin is None else begin
    values = fields(line, keep_empty)
    first = values[begin].strip() if begin < len(values) else ""
    if not first:
        return None
    last = values[end].strip() if end is not None and end < len(values) else ""
    return {"begin_bates": first, "end_bates": last or first, "values": dict(zip(header, values))}


def records(content: bytes, keep_empty: bool = False) -> Iterator[dict]:
    """The records of a file's content, with their line."""
    lines = [x for x in content.split(b"\n") if x.strip()]
    header = fields(lines[0], keep_empty) if lines else []
    for number, line in enumerate(lines[1:], 1):
        if found := record(header, line, keep_empty):
            yield {"line": number, **found}


_DAT = "path string, line long, begin_bates string, end_bates string, values map<string,string>"
#: Files whose headers travel with the tasks.
MOST_FILES = 100_000


def read_dat(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """(path, line, begin_bates, end_bates, values map) of DAT files.  Files are read in splits; ``line`` grows along a file but is not dense."""
    meta = F.col("_metadata")
    raw = F.col("value").cast("binary")  # lines keep their bytes, whatever their encoding
    lines = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("line"), raw.alias("raw"))
    lines = lines.filter(~F.col("raw").cast("string").rlike(r"^\s*$"))
    heads = lines.filter("start = 0").groupBy("path").agg(F.min_by("raw", "line").alias("raw"), F.min("line").alias("line")).limit(MOST_FILES + 1).collect()
    if len(heads) > MOST_FILES:
        return dat_records(spark.read.format("binaryFile").load(path).select("path", "content"), keep_empty)
    first = {r["path"]: (int(r["line"]), fields(bytes(r["raw"]), keep_empty)) for r in heads}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, start, line, data in zip(b["path"], b["start"], b["line"], b["raw"]):
                at, header = first[p]
                if (start or line > at) and (found := record(header, bytes(data), keep_empty)):
                    rows.append({"path": p, "line": line, **found})
            yield pd.DataFrame(rows, columns=["path", "line", "begin_bates", "end_bates", "values"])

    return lines.mapInPandas(parse, _DAT)


def dat_records(files: DataFrame, keep_empty: bool = False) -> DataFrame:
    """``read_dat`` of (path, content) rows, a file at a time; ``line`` counts its records."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                rows = [{"path": p, **r} for r in records(content, keep_empty)]
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(parse, _DAT)


def read_opt(lines: DataFrame) -> DataFrame:
    """(bates, volume, file, first_page) of OPT lines in column ``value``; later duplicates of an id win.  ``line`` orders them."""
    parts = F.split("value", ",", -1)
    rows = lines.select("line", F.transform(parts, lambda x: F.btrim(x)).alias("p")).filter(F.size("p") >= 3)
    cell = lambda i: F.get("p", F.lit(i))
    named = rows.select("line", cell(0).alias("bates"), cell(1).alias("volume"), cell(2).alias("file"), (F.coalesce(cell(3), F.lit("")) == "Y").alias("first_page"))
    return named.groupBy("bates").agg(F.max_by(F.struct("volume", "file", "first_page"), F.col("line")).alias("v")).select("bates", "v.*")


def url(prefix: str | None, file: Column, begin: Column, end: Column) -> Column:
    """Prefix and file name where both are known, else a name of the Bates range."""
    plain = F.concat(F.lit("concordance://"), begin, F.lit(".."), end)
    if not prefix:
        return plain
    last = F.element_at(F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(file.isNotNull(), F.concat(F.lit(prefix.rstrip("/") + "/"), last)).otherwise(plain)


def load(dat: DataFrame, opt: DataFrame, known_urls: DataFrame, prefix: str | None = None) -> DataFrame:
    """New documents of a load file: DAT records with their first page's file, without known URLs."""
    pages = opt.select(F.col("bates").alias("begin_bates"), "file")
    rows = dat.join(pages, "begin_bates", "left").withColumn("url", url(prefix, F.col("file"), F.col("begin_bates"), F.col("end_bates")))
    return rows.join(known_urls.select("url"), "url", "left_anti").withColumn("metadata", F.to_json(F.struct("begin_bates", "end_bates", "values")))


def candidates(file: Column, root: str, volume: Column) -> Column:
    """Places where a page's file may be, first choice first."""
    path = F.ltrim(F.replace(file, F.lit("\\"), F.lit("/")), F.lit("/"))
    name = F.element_at(F.split(path, "/"), -1)
    base = F.lit(root.rstrip("/") + "/")
    return F.array(F.concat(base, path), F.concat(base, volume, F.lit("/"), path), F.concat(base, F.lit("IMAGES/"), name), F.concat(base, name))


def resolve(pages: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """``pages`` with ``found``: the first candidate in ``listing`` (path), else the first candidate."""
    each = pages.select("*", F.posexplode(candidates(F.col("file"), root, F.col("volume"))).alias("choice", "path"))
    there = listing.select("path", F.lit(True).alias("exists"))
    best = F.min(F.struct(F.when(F.col("exists"), F.col("choice")).otherwise(F.col("choice") + 100).alias("rank"), "path"))
    return each.join(there, "path", "left").groupBy(*pages.columns).agg(best.alias("b")).select(*pages.columns, F.col("b.path").alias("found"))
