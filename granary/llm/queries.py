"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that look the same but are stored differently."""
    from granary.llm.visual import same_look_pairs

    return same_look_pairs(table(spark, sf_dir, "split_stream")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


@query
def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered row's text in its consistent form."""
    from granary.llm.visual import consistent_text

    return consistent_text(table(spark, sf_dir, "split_stream").select("doc_id", "text")).select("doc_id", "text_form")


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    from granary.llm.bpe import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k")


@query
def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document's token ids, as a digest: the same as the document's, but for null, which has none."""
    from granary.llm.bpe import decode_corpus, encode_corpus

    x = decode_corpus(encode_corpus(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k"), tokenizer="byte_bpe_50k")
    return x.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query
def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every record, with its source, language and domain."""
    from granary.llm.budget import record_tokens, with_slices

    x = record_tokens(table(spark, sf_dir, "split_stream").select("doc_id", "text", "language", "split", "shard"))
    return with_slices(x, table(spark, sf_dir, "source_manifest"))


@query
def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and domain, and by every grouping of them; "*" stands for all."""
    from granary.llm.budget import totals

    return totals(p3_records(spark, sf_dir), "source", "language", "domain")


@query
def p3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per shard, split and source beside dataset.source_id_counts."""
    from granary.llm.budget import against_shards

    return against_shards(p3_records(spark, sf_dir), table(spark, sf_dir, "dataset"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in a group of two or more, with the group's smallest doc_id."""
    from granary.llm.related import related_groups

    return related_groups(table(spark, sf_dir, "split_stream")).where("records > 1").select("doc_id", "group_id")


@query
def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's split by split_plan, whole groups together."""
    from granary.llm.related import grouped_split, related_groups

    return grouped_split(related_groups(table(spark, sf_dir, "split_stream")), table(spark, sf_dir, "split_plan")).select("doc_id", "group_id", "split")


def _items(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    from granary.llm.leaks import item_words

    return item_words(table(spark, sf_dir, "m1_probe_v0"), "id", "prompt") | item_words(table(spark, sf_dir, "dev_smoke_suite"), "case_id", "prompt")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold a passage of a held-out prompt, with the prompt's id."""
    from granary.llm.leaks import find_leaks

    return find_leaks(table(spark, sf_dir, "split_stream"), _items(spark, sf_dir)).select("doc_id", "item_id")


@query
def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered row's text with the leaked spans taken out."""
    from granary.llm.leaks import without_leaks

    return without_leaks(table(spark, sf_dir, "split_stream").select("doc_id", "text"), _items(spark, sf_dir)).select("doc_id", "clean")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train record and a val or test record that are the same or almost."""
    from granary.llm.overlap import cross_split_overlaps

    x = cross_split_overlaps(table(spark, sf_dir, "split_stream"))
    return x.select(F.least("train_key", "held_key").alias("doc_id_a"), F.greatest("train_key", "held_key").alias("doc_id_b"))


@query
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and source, named as corpus_report.measured names them."""
    from granary.llm.budget import source_name
    from granary.llm.overlap import numbered, overlaps, shared_ngrams
    from granary.session import cut

    s = table(spark, sf_dir, "split_stream").where("split IN ('train', 'val', 'test')")
    ids = cut(numbered(s.select("doc_id", "text", "split", source_name(F.split("doc_id", ":")[0]).alias("source")), "doc_id", "text", "split", "source"))
    held = ids.where("split <> 'train'")
    pairs = overlaps(held, ids.where("split = 'train'").select("key", "ids"))
    near = pairs.join(held.select(F.col("key").alias("held_key"), "split", "source").distinct(), "held_key")
    near = near.groupBy("split", "source").agg(F.count("*").alias("cross_split_near_duplicate_pairs"), F.count_distinct("held_key").alias("records"))
    x = shared_ngrams(ids).join(near, ["split", "source"], "full")
    return x.select("split", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unique_overlapping_ngrams", "overlapping_ngram_occurrences_train", "cross_split_near_duplicate_pairs", "records")])


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.language import fit, labelled_sample, record_languages

    s = table(spark, sf_dir, "split_stream")
    return record_languages(s, fit(*labelled_sample(s, "language", "text", "doc_id")))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and wrong labels, put right; each line of the records in several languages."""
    x = _languages(spark, sf_dir)
    return x.where("segment > 0 OR label IS NULL OR label <> language").select("doc_id", "segment", "language")


@query
def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every record, or of each line of a mixed one."""
    return _languages(spark, sf_dir).select("doc_id", "segment", "language", F.round("confidence", 4).alias("confidence"))


def _severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.severity import REVIEWED, background_sample, fit, rated

    d = table(spark, sf_dir, "documents")
    reviewed = table(spark, sf_dir, "moderation_samples").where("text IS NOT NULL AND label IS NOT NULL").orderBy("sample_id").select("text", "label").limit(REVIEWED).collect()
    model = fit([r.text for r in reviewed], [r.label for r in reviewed], background_sample(d, "text", "lang"))
    return rated(d.select("doc_id", "source", "text"), model)


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a passage is abusive, hateful or sexually explicit."""
    from granary.llm.severity import REPORTED

    return _severity(spark, sf_dir).where(F.col("chance") > REPORTED).select("doc_id")


@query
def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity and chance of every document."""
    return _severity(spark, sf_dir).select("doc_id", "source", F.round("severity", 4).alias("severity"), F.round("chance", 4).alias("chance"))


@query
def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, offensive ones, their share and the mean severity per source."""
    from granary.llm.budget import source_name
    from granary.llm.severity import REPORTED

    x = _severity(spark, sf_dir).withColumn("source", source_name(F.col("source")))
    x = x.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("chance") > REPORTED).alias("offensive"), F.round(F.avg("severity"), 4).alias("mean_severity"))
    return x.withColumn("rate", F.round(F.col("offensive") / F.col("documents"), 4))


@query
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every document, for every container of pack_plan."""
    from granary.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_plan"))


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, tokens, the least bins that could hold them and the share of space in use, per container."""
    x = p8_packed(spark, sf_dir).where("bin IS NOT NULL").groupBy("container").agg(F.count_distinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    x = x.join(table(spark, sf_dir, "pack_plan").select("container", "capacity_tokens"), "container")
    return x.select("container", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"))
