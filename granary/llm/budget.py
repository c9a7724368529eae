"""Problem 3: tokens of every record under an existing tokenizer, with totals by source, language and domain."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.arrowmap import map_rows
from granary.llm.bpe import encoder

LANGUAGES = ("hi", "en", "hinc-latn", "hinc-deva", "mr", "sa", "bn", "te", "gu", "pa")
# Other spellings of the codes (three letters as in ISO 639, names).
SPELLINGS = {
    "hin": "hi", "hindi": "hi", "eng": "en", "english": "en", "mar": "mr", "marathi": "mr", "san": "sa", "sanskrit": "sa",
    "ben": "bn", "bengali": "bn", "bangla": "bn", "tel": "te", "telugu": "te", "guj": "gu", "gujarati": "gu", "pan": "pa",
    "punjabi": "pa", "panjabi": "pa", "hinglish": "hinc-latn",
}


def language_code(label: Column) -> Column:
    """The code that a label names, in whatever spelling; null where it names no language."""
    x = F.regexp_replace(F.lower(F.regexp_replace(label, r"[\s\x{a0}]+", "")), "_", "-")
    spell = F.create_map(*[F.lit(v) for kv in SPELLINGS.items() for v in kv])
    head = F.element_at(F.split(x, "-"), 1)
    return F.when(x.isin(*LANGUAGES), x).when(head.isin(*LANGUAGES), head).otherwise(F.coalesce(spell[x], spell[head]))


def source_name(label: Column) -> Column:
    """A source in its one spelling: no blanks at the ends, small letters, underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")), r"[-\s]+", "_")


def record_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """df without text, one row per key, with n_tokens.

    Whole texts are hashed and deduplicated and each distinct text is tokenized once: a task hands on a text only the
    first time it sees it (so a text that a third of all rows hold is shuffled once a task), the distinct texts are
    then spread by hash and counted, and the counts joined back by hash. Deliveries of one key in several rows count
    once, the smallest hash and row standing for it. Null keys are left out; null and empty texts have 0 tokens.
    Columns of df named like the results are replaced by them.
    """
    rest = [c for c in df.columns if c not in (key, text, "_h", "_r", "n_tokens", "has_text")]
    h = F.when(F.length(text) > 0, F.md5(F.col(text).cast("binary")))
    row = F.struct(h.alias("_h"), *rest)
    rows = df.where(F.col(key).isNotNull()).select(key, row.alias("_r")).groupBy(key).agg(F.min("_r").alias("_r")).select(key, "_r.*")

    def first_here():  # noqa: ANN202
        seen: set[bytes] = set()

        def f(t):  # noqa: ANN001
            k = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
            if k not in seen:
                if len(seen) < 2_000_000:
                    seen.add(k)
                yield (t,)

        return f

    def count():  # noqa: ANN202
        seen: set[str] = set()
        enc = encoder(tokenizer)

        def f(k, t):  # noqa: ANN001
            if k not in seen:
                seen.add(k)
                yield k, enc.count(t)

        return f

    texts = map_rows(df.where(F.length(text) > 0).select(F.col(text).cast("string").alias("text")), "text string", first_here)
    spread = texts.select(F.md5(F.col("text").cast("binary")).alias("_h"), "text").repartition("_h")
    counts = map_rows(spread, "_h string, n_tokens bigint", count)
    return rows.join(counts, "_h", "left").select(key, *rest, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.col("_h").isNotNull().alias("has_text"))


def with_slices(records: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """records with source (the front of the key), language (the label's code or "und") and domain (or "unknown")."""
    domains = manifest.select(source_name(F.col("id")).alias("source"), F.nullif(F.lower(F.trim("domain")), F.lit("")).alias("domain"))
    domains = domains.groupBy("source").agg(F.max("domain").alias("domain"))
    x = records.withColumn("source", source_name(F.split(key, ":")[0])).withColumn("language", F.coalesce(language_code(F.col("language")), F.lit("und")))
    return x.join(domains, "source", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown")))


def totals(records: DataFrame, *by: str) -> DataFrame:
    """Records, records with text and tokens of each slice: every grouping of the columns by, none to all."""
    x = records.cube(*by).agg(
        F.count("*").alias("records"), F.count_if("has_text").alias("records_with_text"), F.sum("n_tokens").alias("tokens"), *[F.grouping(c).alias(f"_{c}") for c in by]
    )
    for c in by:
        x = x.withColumn(c, F.when(F.col(f"_{c}") == 1, "*").otherwise(F.col(c))).drop(f"_{c}")
    return x


def against_shards(records: DataFrame, dataset: DataFrame) -> DataFrame:
    """Per shard, split and source: documents with text as counted here and as the shard's table has them.

    A source that only one side knows has null on the other; a null table count stays null.
    """
    here = records.groupBy("shard", "split", "source").agg(F.count_if("has_text").alias("docs"), F.sum("n_tokens").alias("tokens"))
    at = F.split("path", "/")
    there = dataset.select(F.element_at(at, -2).alias("shard"), F.element_at(at, -1).alias("split"), F.explode("source_id_counts").alias("source", "listed_docs"))
    there = there.withColumn("source", source_name(F.col("source"))).groupBy("shard", "split", "source").agg(F.sum("listed_docs").alias("listed_docs"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("shard", "split", "source")]
    x = here.alias("a").join(there.alias("b"), on, "full")
    return x.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("shard", "split", "source")], "docs", "tokens", "listed_docs")
