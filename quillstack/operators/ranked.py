"""Ranked text search: stemmed words, all of which must occur; approximate, as a light stemmer stands for a full one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import STOP_WORDS

FRAGMENT = 12


def stem(word: Column) -> Column:
    """Word without a common English ending; four letters at least stay."""
    out = F.regexp_replace(word, r"^(\w{2,})ies$", "$1y")
    out = F.regexp_replace(out, r"^(\w{2,}[^s])s$", "$1")
    out = F.regexp_replace(out, r"^(\w{3,}?)(?:ing|edly|ed|ly)$", "$1")
    return F.regexp_replace(out, r"^(\w{3,})e$", "$1")


def lexemes(text: Column) -> Column:
    """Stemmed words of the text without stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.transform(words, stem)


def search(pages: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(document_id, page_number, rank, headline): pages with every word of the query, best first.

    Rank is the words' share of the page, damped by its length; the headline
    is the passage around the first hit, hits in angle brackets.
    """
    best = F.coalesce("final_text", "ocr_text", "pdf_text", F.lit(""))
    wanted = pages.sparkSession.range(1).select(F.array_distinct(lexemes(F.lit(query))).alias("w")).first()["w"]
    if not wanted:
        return pages.limit(0).select("document_id", "page_number", F.lit(0.0).alias("rank"), F.lit("").alias("headline"))
    terms = F.array(*[F.lit(w) for w in wanted])
    rows = pages.withColumn("text", best).withColumn("lex", lexemes(F.col("text")))
    hits = F.size(F.filter("lex", lambda w: F.array_contains(terms, w)))
    ranked = rows.filter(F.size(F.array_intersect("lex", terms)) == len(wanted)).withColumn("rank", hits / (1 + F.log(1.0 + F.size("lex"))))
    top = ranked.orderBy(F.desc("rank"), "document_id", "page_number").limit(limit)
    plain = F.split("text", r"\s+")
    is_hit = lambda w: F.array_contains(terms, stem(F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")))
    first = F.array_position(F.transform(plain, is_hit), True)
    shown = F.transform(F.slice(plain, F.greatest(F.lit(1), first.cast("int") - FRAGMENT // 2), F.lit(FRAGMENT)), lambda w: F.when(is_hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    return top.select("document_id", "page_number", "rank", F.array_join(shown, " ").alias("headline"))
