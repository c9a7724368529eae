"""Documents from markup, JSON and text: plain text of each, blocks between blank lines, packing of blocks into chunks."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is no running text; elements that HTML renders as blocks of their own (and cells).
UNREAD = ("footer", "head", "nav", "script", "style")
BLOCKS = (
    "article", "blockquote", "br", "div", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "section", "table",
    "td", "th", "tr",
)
#: Rewriting of markup, in order: comments, unread elements with their content (to the end of the text if they aren't closed),
#: blocks to line ends, all other tags, declarations and instructions.
HTML = (
    (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<{t}(?:[ \t\n/][^>]*)?>.*?</{t}[ \t\n]*>", "") for t in UNREAD),
    *((rf"(?is)<{t}(?:[ \t\n/][^>]*)?>.*", "") for t in UNREAD),
    (rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[ \t\n/][^>]*)?>", "\n"),
    (r"</?[A-Za-z][^>]*>|<[!?][^>]*>", ""),
)


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Character references resolved by the table of the HTML standard, which Spark has no function for, those that were
    escaped twice included. Null stays null."""
    return s.map(lambda t: html.unescape(html.unescape(t)) if "&" in t else t, na_action="ignore")


def without_tags(c: Column) -> Column:
    """Markup taken out, a line end for each edge of a block; character references stay."""
    for pattern, to in HTML:
        c = F.regexp_replace(c, pattern, to)
    return c


def html_to_text(c: Column) -> Column:
    """Text of HTML or XHTML: no comments, scripts, styles, heads, navigation or footers; blocks and table cells on lines of
    their own; character references resolved; ends stripped. Malformed markup gives what can be read. Null stays null."""
    return F.regexp_replace(unescaped(without_tags(c)), r"^[\t-\r ]+|[\t-\r ]+$", "")


def _strings(value: object) -> Iterator[str]:
    """The strings in a JSON value, depth first; the fields of an object in order of the length of their names, then by name."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)
    elif isinstance(value, dict):
        for k in sorted(value, key=lambda name: (len(name), name)):
            yield from _strings(value[k])


@F.pandas_udf(T.StringType())
def json_to_text(s: pd.Series) -> pd.Series:
    """The strings of a JSON text at any depth, a line each. Null and what isn't JSON give null; a value without strings is empty."""

    def text(t: str) -> str | None:
        try:
            return "\n".join(_strings(json.loads(t)))
        except (ValueError, RecursionError):
            return None

    return s.map(text, na_action="ignore")


def _pieces(text: Column) -> Column:
    """The blocks of a text: runs of lines that aren't blank, ends stripped; null and blank texts have none."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    strip = lambda b: F.regexp_replace(F.regexp_replace(b, r"(?m)[ \t]+$", ""), r"^[ \t\n]+|[ \t\n]+$", "")
    return F.filter(F.transform(F.split(t, r"\n[ \t]*\n\s*"), strip), lambda b: F.length(b) > 0)


def _chunks(parts: Column, most: int, least: int) -> Column:
    """Blocks joined by blank lines while they fit ``most`` characters; longer blocks are cut hard, short chunks left out."""
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.length(b) - 1, F.lit(0)), F.lit(most)), lambda i: F.substring(b, i + 1, F.lit(most)))
    start = F.array().cast("array<string>")

    def add(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 2 + F.length(b) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws("\n\n", last, b)))).otherwise(F.concat(acc, F.array(b)))

    return F.filter(F.aggregate(F.flatten(F.transform(parts, cut)), start, add), lambda c: F.length(c) >= least)


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, block): runs of non-blank lines, ends stripped, numbered from 0. Blank texts have none."""
    return df.select(F.col(key), F.posexplode(_pieces(F.col(text))).alias("block_no", "block"))


def packed_blocks(df: DataFrame, key: str, text: str, most: int = 4000, least: int = 200) -> DataFrame:
    """(key, chunk_no, chunk): blocks joined by blank lines while they fit ``most`` characters; longer blocks are cut hard,
    chunks under ``least`` characters left out. The fold runs over each document's own blocks."""
    return df.select(F.col(key), F.posexplode(_chunks(_pieces(F.col(text)), most, least)).alias("chunk_no", "chunk"))


def packed_by_language(df: DataFrame, key: str, order: str, language: str, text: str, most: int = 4000, least: int = 200) -> DataFrame:
    """(key, run_no, language, chunk_no, chunk): the texts of a key packed in order, never two languages in one chunk.

    A run is as many texts in order as have one language (null is one too); each run is packed on its own. A key is an
    artifact, whose records come in its own order; order should be unique within it, and not null.
    """
    w = Window.partitionBy(key).orderBy(order)
    switch = F.coalesce((~F.col(language).eqNullSafe(F.lag(language).over(w))).cast("int"), F.lit(0))
    x = df.select(key, order, language, text).withColumn("_s", F.when(F.row_number().over(w) == 1, 0).otherwise(switch))
    x = x.withColumn("run_no", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(key, "run_no").agg(F.first(language, ignorenulls=True).alias(language), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_r"))
    parts = F.flatten(F.transform("_r", lambda r: F.coalesce(_pieces(r["t"]), F.array().cast("array<string>"))))
    return runs.select(key, "run_no", language, F.posexplode(_chunks(parts, most, least)).alias("chunk_no", "chunk"))
