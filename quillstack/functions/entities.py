"""Entities of a text by dictionaries and patterns: organisations, persons, file numbers, locations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dictionaries.
AGENCIES = (
    "CIA", "FBI", "NSA", "NSC", "DOD", "DOJ", "DOS", "DOE", "DIA", "NRO", "NGA", "DEA", "ATF",
    "ICE", "CBP", "TSA", "FEMA", "ODNI", "DNI", "DARPA", "IARPA", "USAID", "EPA", "IRS", "SEC",
    "FTC", "FCC", "FAA", "NASA", "NIST", "NIH", "CDC", "FDA", "USDA", "HHS", "DHS", "CISA",
    "ONI", "OSS", "KGB", "MI5", "MI6", "GCHQ", "BND", "DGSE", "MOSSAD", "ASIS", "CSIS", "ISI",
    "NATO", "INTERPOL", "GAO", "CBO", "OMB",
)
AGENCY_NAMES = (
    "Central Intelligence Agency", "Federal Bureau of Investigation", "National Security Agency", "National Security Council",
    "Department of Defense", "Department of Justice", "Department of State", "Department of Energy", "Defense Intelligence Agency",
    "National Reconnaissance Office", "Drug Enforcement Administration", "Bureau of Alcohol, Tobacco, Firearms and Explosives",
    "Department of Homeland Security", "Office of the Director of National Intelligence", "Office of Strategic Services",
    "Government Accountability Office", "Congressional Budget Office", "Office of Management and Budget", "Joint Chiefs of Staff",
    "White House", "State Department", "Pentagon", "Secret Service", "U.S. Army", "U.S. Navy", "U.S. Air Force", "U.S. Marines",
    "U.S. Coast Guard", "National Guard",
)
STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii",
    "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan",
    "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York",
    "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota",
    "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
)
PLACES = (
    "Washington D.C.", "Langley", "Fort Meade", "Quantico", "Camp David", "Area 51", "Guantanamo", "Berlin", "Moscow", "London", "Tokyo",
    "Beijing", "Saigon", "Havana", "Baghdad", "Kabul", "Tehran", "Pyongyang", "Islamabad",
)
NOT_NAMES = (
    "The United", "United States", "New York", "New Jersey", "New Mexico", "New Hampshire", "North Carolina", "North Dakota",
    "South Carolina", "South Dakota", "West Virginia", "Top Secret", "No Foreign", "National Security", "Foreign Affairs",
    "Central Intelligence", "Federal Bureau",
)
# Patterns.
TITLED = (
    r"(?:(?:President|Vice President|Secretary|Director|General|Admiral|Colonel|Major|Captain|Lieutenant|Sergeant|Agent|Ambassador|Senator|"
    r"Representative|Congressman|Congresswoman|Governor|Mayor|Judge|Justice|Attorney General|Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.)\s+)"
    r"([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)"
)
CAPITALISED = r"(?U)\b([A-Z][a-z]{2,}(?:\s+[A-Z]\.?\s+|\s+)[A-Z][a-z]{2,})\b"
FILE_NUMBERS = (
    r"\b([A-Z]{2,5}-[A-Z]{2,5}\d{2,}-\d{4,}[A-Z]?\d*(?:-\d+)?)\b",
    r"\b(FOIA-\d{4}-\d{3,})\b",
    r"\b((?:DOC|REF|MEMO|CABLE|REPORT)\s*(?:#|No\.?|Number)?\s*\d[\d\-/]{3,})\b",
    r"\b((?:TOP SECRET|SECRET|CONFIDENTIAL)(?://[A-Z]+(?:/[A-Z]+)*)?)\b",
)


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: F.btrim(x))


def _named(text: Column, names: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def _bounded(names: tuple[str, ...]) -> str:
    return r"(?U)\b(" + "|".join(re.escape(n).replace(r"\ ", " ") for n in sorted(names, key=len, reverse=True)) + r")\b"


def organizations(text: Column) -> Column:
    return F.array_distinct(F.concat(_all(text, _bounded(AGENCIES)), _named(text, AGENCY_NAMES)))


def plausible(name: Column) -> Column:
    """Two to four words, each with a capital first letter and two bytes at least."""
    parts = F.split(name, r"\s+")
    return F.size(parts).between(2, 4) & F.forall(parts, lambda p: p.rlike(r"^\p{Lu}") & (F.octet_length(p) >= 2))


def persons(text: Column) -> Column:
    titled = F.filter(_all(text, TITLED), plausible)
    plain = F.filter(_all(text, CAPITALISED), lambda n: plausible(n) & ~n.isin(*NOT_NAMES))
    return F.array_distinct(F.concat(titled, plain))


def file_numbers(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_all(text, p) for p in FILE_NUMBERS]))


def locations(text: Column) -> Column:
    """States as whole words (also inside longer state names) and notable places."""
    found = _all(text, _bounded(STATES))
    inner = F.when(F.array_contains(found, "West Virginia"), F.array(F.lit("Virginia"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, inner, _named(text, PLACES)))


def entities(text: Column) -> Column:
    """Distinct struct(type, text), sorted."""
    typed = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text")))
    each = (("organization", organizations(text)), ("person", persons(text)), ("file_number", file_numbers(text)), ("location", locations(text)))
    return F.array_sort(F.array_distinct(F.concat(*[typed(k, f) for k, f in each])))
