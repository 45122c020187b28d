"""Licence detection, zones and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Patterns of open and closed licences, tried in this order.
OPEN_PATTERNS = (r"(?i)apache\s+license\s+2\.0", r"(?i)apache-2\.0", r"(?i)creative\s+commons", r"(?i)cc-by", r"(?i)(?<![A-Za-z0-9_])cc0(?![A-Za-z0-9_])")
CLOSED_PATTERNS = ("©", r"(?i)copyright", r"(?i)all\s+rights\s+reserved")
#: Words in lower case of which one is in every text that a pattern matches.
OPEN_WORDS, CLOSED_WORDS = ("apache", "creative", "cc-by", "cc0"), ("©", "copyright", "reserved")


def detect(text: Column) -> Column:
    """OSS, CSS or UNKNOWN by the text; open patterns win, blank or null is UNKNOWN.

    Patterns are tried only on texts that hold one of their words, which is a plain search of bytes.
    """
    low = F.lower(text)

    def any_of(patterns: tuple[str, ...], words: tuple[str, ...]) -> Column:
        some = low.contains(words[0])
        for word in words[1:]:
            some = some | low.contains(word)
        return some & text.rlike("|".join(f"(?:{p})" for p in patterns))

    return F.when(text.isNull() | is_blank(text), "UNKNOWN").when(any_of(OPEN_PATTERNS, OPEN_WORDS), "OSS").when(any_of(CLOSED_PATTERNS, CLOSED_WORDS), "CSS").otherwise("UNKNOWN")


def zone_of_path(path: Column) -> Column:
    """The zone by the folder of a path; back slashes count as slashes."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.contains("/foundry/public/"), "OSS").when(p.contains("/foundry/private/"), "CSS").otherwise("UNKNOWN")


def licence_name(zone: Column) -> Column:
    return F.when(zone == "OSS", "Apache-2.0").when(zone == "CSS", "PROPRIETARY").otherwise("UNKNOWN")


def route(zone: Column) -> Column:
    """Closed by default: only OSS goes to the open folder."""
    return F.when(zone == "OSS", "OSS").otherwise("office")


def effective_zone(detected: Column, fallback: Column) -> Column:
    return F.when(detected.isNull() | (detected == "UNKNOWN"), fallback).otherwise(detected)
