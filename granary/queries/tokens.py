"""Queries on statistics, token counts and windows."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import WS
from granary.operators.running import running_total
from granary.queries import query, table
from granary.queries import sql as S

_N = f"coalesce(len(regexp_extract_all(text, {S.q('[^' + WS[1:])})), 0)"


def _count() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit("[^" + WS[1:])), F.lit(0))


@query(f"SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS level, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source END AS value, count(*) AS documents, sum(coalesce(length(text), 0))::BIGINT AS chars, sum(coalesce(strlen(text), 0))::BIGINT AS bytes, sum({_N})::BIGINT AS tokens, count(*) FILTER (license IS NULL) AS without_license FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters, bytes and words by label, by source and in all, in one scan."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "license", F.length("text").alias("c"), F.octet_length("text").alias("b"), _count().alias("n"))
    d.createOrReplaceTempView("_stats_documents")
    return spark.sql("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS level,
      CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source END AS value, count(*) AS documents, sum(coalesce(c, 0)) AS chars,
      sum(coalesce(b, 0)) AS bytes, sum(n) AS tokens, count_if(license IS NULL) AS without_license FROM _stats_documents GROUP BY GROUPING SETS ((lang), (source), ())""")


@query(f"SELECT source, count(*) AS documents, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS document_share, round(sum({_N}) / (sum(sum({_N})) OVER ())::DOUBLE, 6) AS token_share FROM documents GROUP BY source")
def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's share of documents and words."""
    x = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(_count()).alias("n"))
    w = Window.partitionBy()
    return x.select("source", "documents", F.round(F.col("documents") / F.sum("documents").over(w), 6).alias("document_share"), F.round(F.col("n") / F.sum("n").over(w), 6).alias("token_share"))


@query(f"SELECT source, lang, sum({_N})::BIGINT AS tokens, sum({_N})::BIGINT // 64 AS contexts FROM documents GROUP BY 1, 2")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per source and label, and contexts of 64 words that they fill."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(_count()).alias("tokens")).withColumn("contexts", F.floor(F.col("tokens") / 64))


_OFF = f"SELECT doc_id, source, {_N} AS n, (sum({_N} + 1) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS stop FROM documents"


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", _count().alias("n"))
    return running_total(d.withColumn("m", F.col("n") + 1), "source", "doc_id", "m", "stop").drop("m")


@query(f"SELECT doc_id, source, stop - n - 1 AS start, stop FROM ({_OFF})")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's words lie in its source's stream, one separator after each document."""
    return _offsets(spark, sf_dir).select("doc_id", "source", (F.col("stop") - F.col("n") - 1).alias("start"), "stop")


@query(f"SELECT doc_id, unnest(range(stop - n - 1, stop - 65, 32)) AS start FROM ({_OFF}) WHERE n + 1 >= 65")
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of windows of 64 words and their next, every 32 words, within each document."""
    x = _offsets(spark, sf_dir).where("n + 1 >= 65")
    starts = F.sequence(F.col("stop") - F.col("n") - 1, F.col("stop") - 65, F.lit(32).cast("bigint"))
    return x.select("doc_id", F.explode(F.filter(starts, lambda s: s < F.col("stop") - 65)).alias("start"))


@query(f"SELECT doc_id, source FROM (SELECT *, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000")
def training_text_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of each source until 20,000 characters are reached, the crossing one included."""
    x = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("c"))
    return running_total(x, "source", "doc_id", "c", "upto").where("upto - c < 20000").select("doc_id", "source")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 60")
def label_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 documents of each label."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 60").select("doc_id", "lang")


@query(f"SELECT lang, round(sum(length(text)) / sum({_N})::DOUBLE, 6) AS chars_per_word, round(sum(strlen(text)) / sum({_N})::DOUBLE, 6) AS bytes_per_word, round(median({_N}), 3) AS median_words FROM documents WHERE {_N} > 0 GROUP BY lang")
def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and bytes a word, and the median length, per label."""
    x = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("c"), F.octet_length("text").alias("b"), _count().alias("n")).where("n > 0")
    return x.groupBy("lang").agg(F.round(F.sum("c") / F.sum("n"), 6).alias("chars_per_word"), F.round(F.sum("b") / F.sum("n"), 6).alias("bytes_per_word"), F.round(F.median("n"), 3).alias("median_words"))


@query("WITH r AS (SELECT source, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE lang IN ('hi', 'en')) SELECT a.n AS place, md5(a.text || chr(10) || b.text) AS digest FROM r a JOIN r b ON a.n = b.n AND a.lang = 'hi' AND b.lang = 'en' WHERE a.text IS NOT NULL AND b.text IS NOT NULL")
def interleaved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th Hindi document beside the n-th English one: places are numbered by ids alone, texts joined to them after."""
    d = table(spark, sf_dir, "documents").where("lang IN ('hi', 'en')").select("doc_id", "lang", "text")
    r = running_total(d.select("doc_id", "lang", F.lit(1).cast("bigint").alias("one")), "lang", "doc_id", "one", "place")
    places = r.groupBy("place").agg(F.max(F.when(F.col("lang") == "hi", F.col("doc_id"))).alias("a"), F.max(F.when(F.col("lang") == "en", F.col("doc_id"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    x = places.join(d.select(F.col("doc_id").alias("a"), "text"), "a").join(d.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b").where("text IS NOT NULL AND other IS NOT NULL")
    return x.select("place", F.md5(F.encode(F.concat("text", F.lit("\n"), "other"), "UTF-8")).alias("digest"))


@query(f"SELECT source, count(*) FILTER (n + 1 < 65) AS short, count(*) AS documents, coalesce(sum(CASE WHEN n + 1 >= 65 THEN (n + 1 - 65) // 32 + CASE WHEN (n + 1 - 65) % 32 > 0 THEN 1 ELSE 0 END END), 0)::BIGINT AS windows, coalesce(sum(CASE WHEN n + 1 >= 65 THEN (n + 1 - 65) // 32 + CASE WHEN (n + 1 - 65) % 32 > 0 THEN 1 ELSE 0 END END), 0) < 8 AS starved FROM ({_OFF}) GROUP BY source")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 words per source, documents too short for one, and whether a batch of eight can't be filled."""
    n = _count() + 1
    w = F.when(n >= 65, F.ceil((n - 65) / 32)).otherwise(0)
    x = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(n < 65).alias("short"), F.count("*").alias("documents"), F.sum(w).cast("bigint").alias("windows"))
    return x.withColumn("starved", F.col("windows") < 8)


@query("SELECT path, n_tokens, ceil(n_tokens / (seq_len * 8.0))::BIGINT AS steps FROM (SELECT DISTINCT path, n_tokens, seq_len FROM dataset) WHERE n_tokens IS NOT NULL AND seq_len > 0")
def steps_per_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of eight sequences that each shard's tokens fill."""
    x = table(spark, sf_dir, "dataset").where("n_tokens IS NOT NULL AND seq_len > 0").select("path", "n_tokens", "seq_len").distinct()
    return x.select("path", "n_tokens", F.ceil(F.col("n_tokens") / (F.col("seq_len") * 8.0)).alias("steps"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS place FROM documents")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in a seeded shuffle of all of them: ids are ordered by hash in ranges, not in one task."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string"))).alias("h"), F.lit(1).cast("bigint").alias("one"), F.lit("all").alias("all"))
    return running_total(x.withColumn("o", F.concat_ws(":", "h", F.format_string("%020d", F.col("doc_id")))), "all", "o", "one", "place").select("doc_id", "place")


_MARGIN = "SELECT lang, sum(strlen(text))::DOUBLE AS bytes, sum(length(text))::DOUBLE AS chars FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1"


@query(f"SELECT lang, round(1 - chars / bytes, 6) AS fewer, CASE WHEN 1 - chars / bytes >= CASE WHEN lang = 'hi' THEN 0.15 ELSE 0.10 END THEN 'pass' ELSE 'fail' END AS verdict, rank() OVER (ORDER BY round(1 - chars / bytes, 6) DESC) AS rank FROM ({_MARGIN})")
def tokenizer_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fewer tokens one unit of text needs than another (characters and bytes), by label, against a share asked for, ranked."""
    x = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.length("text")).alias("c")).withColumn("f", 1 - F.col("c") / F.col("b"))
    ok = F.col("f") >= F.when(F.col("lang") == "hi", 0.15).otherwise(0.10)
    return x.select("lang", F.round("f", 6).alias("fewer"), F.when(ok, "pass").otherwise("fail").alias("verdict")).withColumn("rank", F.rank().over(Window.orderBy(F.col("fewer").desc())))


_W = f"string_split({S.collapse('text')}, ' ')"


@query(f"SELECT doc_id, round(len(list_distinct(g)) / len(g)::DOUBLE, 6) AS distinct_4grams, len(list_distinct(g)) / len(g)::DOUBLE < 0.5 AS degenerate FROM (SELECT doc_id, {S.ngrams('w', 4)} AS g FROM (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL)) WHERE len(g) > 0")
def degenerate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows of four words that are distinct; under a half a text repeats itself."""
    from granary.functions.text import collapse, let, ngrams

    share = let(ngrams(F.split(collapse(F.col("text")), " "), 4), lambda g: F.try_divide(F.size(F.array_distinct(g)), F.size(g)))
    x = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", share.alias("share")).where("share IS NOT NULL")
    return x.select("doc_id", F.round("share", 6).alias("distinct_4grams"), (F.col("share") < 0.5).alias("degenerate"))
