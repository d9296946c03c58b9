"""Terms of a text: tokens without stop words, short words and numbers; tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may "
    "might must shall can this that these those it its they their we our you your he she him her his all each every both few more most other "
    "some such no not only same so than too very just also now here there when where why how what which who whom about after before between "
    "into through during above below up down out off over under again further then once home contact about us menu search site page click "
    "here more read view see skip main content navigation footer header sidebar"
).split()
LEAST_BYTES = 3


def tokens(text: Column) -> Column:
    """Lower-case words split at blanks, commas, semicolons, pipes and slashes, outer punctuation cut."""
    split = F.split(F.coalesce(text, F.lit("")), r"[\s,;|/]+")
    cut = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$", ""))
    return F.filter(F.transform(split, cut), lambda w: w != "")


def terms(text: Column) -> Column:
    keep = lambda w: (F.octet_length(w) >= LEAST_BYTES) & ~w.isin(*STOP_WORDS) & ~w.rlike(r"^\p{N}+$")
    return F.filter(tokens(text), keep)


def tags(response: Column, most: int = 10, longest: int = 50) -> Column:
    """Tags of a model's comma list: brackets and outer punctuation cut, lower case."""
    bare = F.regexp_replace(F.regexp_replace(response, r"(?i)^\s*tags:\s*", ""), r"[\[\]]", "")
    each = F.transform(F.split(bare, ","), lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.slice(F.filter(each, lambda t: (t != "") & (F.octet_length(t) <= longest)), 1, most)
