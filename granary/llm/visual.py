"""Problem 1: records whose texts look the same but are stored with different characters."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrowmap import map_rows
from granary.llm.fold import fold, skeleton


def consistent_text(df: DataFrame, text: str = "text", out: str = "text_form") -> DataFrame:
    """df with one more column, the consistent form of text; all other columns as they are.

    Null gives null, an empty text an empty text; the result has as many rows as df. A column named like out is replaced.
    """

    @F.pandas_udf("string")
    def form(s):  # noqa: ANN001, ANN202
        return s.map(fold, na_action="ignore")

    return df.withColumn(out, form(F.col(text).cast("string")))


def form_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, form (128-bit hash of the skeleton, which texts that look the same share) and raw (of the text itself), one row per key, blank texts left out.

    Rows with a null key are left out. Of several rows with one key, which should be copies, the smallest hashes count.
    """

    def start():  # noqa: ANN202
        def f(k, t):  # noqa: ANN001, ANN202
            if k is not None and t is not None and not t.isspace() and t:
                c = skeleton(t)
                if c and not c.isspace():
                    raw = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
                    yield k, raw if c == t else xxhash.xxh3_128_digest(c.encode("utf-8", "surrogatepass")), raw

        return f

    kind = df.schema[key].dataType.simpleString()
    keys = map_rows(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), f"key {kind}, form binary, raw binary", start)
    return keys.groupBy("key").agg(F.min(F.struct("form", "raw")).alias("x")).select("key", "x.form", "x.raw")


def same_look_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a, b), a < b, of records whose texts have one skeleton but aren't the same string.

    Only hashes are shuffled. Forms that occur in one spelling (however many copies) drop out before any pair is made:
    first pairs of spellings of a form, then each spelling's records are joined to them, so no two copies are ever
    compared. Hot spellings are split by adaptive skew joins. Nulls, empty and blank texts are no records here.
    """
    keys = form_keys(df, key, text)
    spelt = keys.select("form", "raw").distinct()
    several = spelt.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    spelt = spelt.join(several, "form")
    two = spelt.withColumnRenamed("raw", "raw_a").join(spelt.withColumnRenamed("raw", "raw_b"), "form").where("raw_a < raw_b")
    a = keys.select(F.col("form"), F.col("raw").alias("raw_a"), F.col("key").alias("ka"))
    b = keys.select(F.col("form"), F.col("raw").alias("raw_b"), F.col("key").alias("kb"))
    got = two.join(a, ["form", "raw_a"]).join(b, ["form", "raw_b"])
    return got.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
