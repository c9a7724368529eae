"""Cleaning of wiki and web text, and the reasons for which a text is rejected."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import let
from granary.operators.checks import most_alike

# Phrases that mark boilerplate, limits of the quality filter, patterns of markup (in order).
BOILERPLATE = ("all rights reserved", "click here to subscribe", "enable javascript", "404 not found", "this page requires cookies")
LIMITS = {"min_chars": 120, "max_chars": 100_000, "min_alnum": 0.35, "max_line": 0.55, "max_url": 0.15, "max_symbol": 0.35}
MARKUP = (
    (r"(?is)<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", " "),
    (r"(?i)</?(?:ref|p|br|div|span|table|tr|td|th|ul|ol|li|h[1-6]|center|small|sup|sub|nowiki|source)\b[^>]*>", " "),
    (r"\{\{[^{}]{0,400}?\}\}", " "),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"\[([^\]]{0,120})\]\([^)]*\)", "$1"),
    (r"(?i)\[(?:citation needed|update|when|who|cn|dubious)\]", " "),
    (r"(?i)(?:https?://|www\.)[^\t-\r \x{85}\p{Z}]+", " "),
    (r"(?i)\b(?:File|Image|Category|Wikidata):[\t-\r ]*[^\t-\r \x{85}\p{Z}]+", " "),
    (r"(?m)^[\t-\r ]*={2,}[\t-\r ]*[^=]*[\t-\r ]*={2,}[\t-\r ]*$", "\n"),
)


MOJIBAKE, DEVANAGARI = r"[ÂÃàáâã][\x{80}-\x{bf}]", r"[\x{900}-\x{97f}]"
LINK = r"(?i)[^ ]*(?:http|www\.|\.com|\.org|\.gov)[^ ]*"
STRUCTURE = r"[.!?।|:;,\"'()॥\-–—\t-\r \x{85}\p{Z}]"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def clean_text(c: Column, compose: bool = True) -> Column:
    """Composed, without zero-width and control characters and markup, white space in order. Null stays null."""
    t = nfc(c) if compose else c
    t = F.regexp_replace(t, r"[\x{200b}-\x{200f}\x{2060}\x{feff}]", "")
    t = mojibake_repaired(F.regexp_replace(t, r"\r\n|\r", "\n"))
    for pattern, to in MARKUP:
        t = F.regexp_replace(t, pattern, to)
    t = F.regexp_replace(t, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]", "")
    t = F.regexp_replace(F.regexp_replace(t, "\t", " "), r"[ \x{a0}]{2,}", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?m)^[ \x{a0}]+|[ \x{a0}]+$", "")
    return F.regexp_replace(t, r"^\n+|\n+$", "")


def mojibake_repaired(c: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1 read rightly, if that gives more Devanagari letters; else the text."""

    def read(t: Column) -> Column:
        maybe = t.rlike(MOJIBAKE) & ~t.rlike(r"[^\x{0}-\x{ff}]")
        r = F.try_validate_utf8(F.when(maybe, F.encode(t, "ISO-8859-1")).cast("binary").cast("string"))
        return F.when(maybe & (F.regexp_count(r, F.lit(DEVANAGARI)) > F.regexp_count(t, F.lit(DEVANAGARI))), r).otherwise(t)

    return let(c, read)


def reject_reasons(c: Column, **limits: float) -> Column:
    """All reasons, in order, for which a text is rejected; none for a good one. Null counts as empty."""
    p = {**LIMITS, **limits}
    return let(F.coalesce(c, F.lit("")), lambda t: _reasons(t, p))


def _reasons(t: Column, p: dict) -> Column:
    n = F.length(t)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\t-\r \x{85}\p{Z}]"))
    repeated = let(lines, lambda x: (F.size(x) > 2) & (most_alike(x) / F.size(x) > p["max_line"]))
    urls = F.when(t.rlike(r"(?i)http|www\.|\.com|\.org|\.gov"), F.regexp_count(t, F.lit(LINK))).otherwise(F.lit(0))
    words = F.greatest(F.regexp_count(t, F.lit(r"[^\t-\r \x{85}\p{Z}]+")), F.lit(1))
    low = F.lower(t)
    tests = [
        (n < p["min_chars"], "too_short"),
        (n > p["max_chars"], "too_long"),
        ((n > 0) & (F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) / n < p["min_alnum"]), "low_alnum_ratio"),
        (repeated, "line_repetition"),
        (urls / words > p["max_url"], "link_farm"),
        ((n > 0) & (F.regexp_count(t, F.lit(r"\p{S}")) / n > p["max_symbol"]), "symbol_soup"),
        (~t.rlike(STRUCTURE), "no_punctuation_structure"),
        (F.greatest(*[low.contains(b) for b in BOILERPLATE]), "boilerplate"),
    ]
    return F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in tests]), lambda x: x.isNotNull())


def cleaned(df: DataFrame, text: str = "text", compose: bool = True) -> DataFrame:
    """df with clean and reasons; rows are kept or rejected by whether reasons is empty."""
    return df.withColumn("clean", clean_text(F.col(text), compose)).withColumn("reasons", reject_reasons(F.col("clean")))
