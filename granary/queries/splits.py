"""Queries on components, splits and leakage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.dedup import connected
from granary.operators.membership import exploded, key_filter
from granary.operators.splitting import assign_split, component_edges, content_components, gram_rows, leaking, leaking_pairs, repair_leaks
from granary.queries import query, table
from granary.queries import sql as S
from granary.queries.duplicates import _CC
from granary.session import cut

_SENT = f"WITH RECURSIVE s AS (SELECT doc_id, unnest({S.sentences('text')}) AS s FROM documents), f AS (SELECT s, min(doc_id) AS a FROM s GROUP BY s), edges AS (SELECT DISTINCT f.a, s.doc_id AS b FROM s JOIN f USING (s) WHERE s.doc_id > f.a)" + _CC + ", p AS (SELECT d.doc_id, d.lang, coalesce(c.root, d.doc_id) AS component FROM documents d LEFT JOIN c ON c.node = d.doc_id) "
_SPLIT = _SENT + """, v AS (SELECT component, lang, count(*) AS n FROM p GROUP BY 1, 2), e2 AS (SELECT component, sum(n) AS docs, arg_min(coalesce(lang, chr(0)), {'n': -n, 'l': coalesce(lang, chr(0))}) AS l FROM v GROUP BY 1),
 k AS (SELECT component, nullif(l, chr(0)) AS lang, docs, sha256('20260105:' || coalesce(nullif(l, chr(0)), '') || ':' || component) AS key, sum(docs) OVER (PARTITION BY l) AS total FROM e2),
 a AS (SELECT component, lang, docs::BIGINT AS docs, CASE WHEN coalesce(sum(docs) OVER (PARTITION BY lang ORDER BY key, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < greatest(round(total * 0.1), 1) THEN 'val' ELSE 'train' END AS split FROM k) """


@query(_SENT + "SELECT doc_id, component FROM p")
def sentence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share sentences, by component."""
    return content_components(table(spark, sf_dir, "documents"), "doc_id", "text")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    parts = content_components(d, "doc_id", "text").join(d.select("doc_id", "lang"), "doc_id")
    return assign_split(parts, "lang", 0.1, 20260105)


@query(_SPLIT + "SELECT component, lang, docs, split FROM a")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component's split, in the order of a seeded hash."""
    return _assigned(spark, sf_dir)


@query(_SPLIT + "SELECT lang, sum(docs)::BIGINT AS docs, sum(CASE WHEN split = 'val' THEN docs ELSE 0 END)::BIGINT AS val_docs, count(*) AS components FROM a GROUP BY lang")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and components of each split per language."""
    return _assigned(spark, sf_dir).groupBy("lang").agg(F.sum("docs").alias("docs"), F.sum(F.when(F.col("split") == "val", F.col("docs")).otherwise(0)).alias("val_docs"), F.count("*").alias("components"))


_ONCE = "WITH d AS (SELECT DISTINCT doc_id, split, text, source_id, component_id FROM split_stream), "
_GRAM = f"f AS MATERIALIZED (SELECT doc_id, split, {S.compare_form('text')} AS f FROM d WHERE split IN ('train', 'val', 'test')), w AS MATERIALIZED (SELECT doc_id, split, string_split(f, ' ') AS w FROM f WHERE length(f) > 0), g AS (SELECT doc_id, split, unnest({S.ngrams('w', 8)}) AS g FROM w) "


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, however often it was delivered: grouped by its id, not by its text."""
    x = table(spark, sf_dir, "split_stream").where("split IN ('train', 'val', 'test')")
    return x.groupBy("doc_id").agg(F.min(F.struct("split", "text", "source_id", "component_id")).alias("r")).select("doc_id", "r.*")


@query(_ONCE + _GRAM + "SELECT doc_id, count(*) AS hits, count(DISTINCT g) AS distinct_hits FROM g WHERE split <> 'train' AND g IN (SELECT g FROM g WHERE split = 'train') GROUP BY 1")
def leaking_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out records with eight words in a row that train holds."""
    return leaking(_records(spark, sf_dir), "doc_id", "text", "split", 8, F.col("split") != "train")


@query(_ONCE + _GRAM + ", t AS (SELECT g, min(doc_id) AS train_key FROM g WHERE split = 'train' GROUP BY g) SELECT h.doc_id AS held_key, train_key, count(*) AS rows FROM (SELECT DISTINCT doc_id, g FROM g WHERE split <> 'train') h JOIN t USING (g) GROUP BY 1, 2")
def leaking_record_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out records and the first train records that hold their shared rows of eight words."""
    return leaking_pairs(_records(spark, sf_dir), "doc_id", "text", "split", 8, F.col("split") != "train")


@query(_ONCE + _GRAM + ", t AS (SELECT g, count(*) AS n FROM g WHERE split = 'train' GROUP BY g), h AS (SELECT DISTINCT split, g FROM g WHERE split <> 'train') SELECT h.split, count(*) AS ngrams, count(t.g) AS unique_overlapping_ngrams, coalesce(sum(t.n), 0)::BIGINT AS train_occurrences, round(count(t.g) / count(*)::DOUBLE, 6) AS overlap_rate FROM h LEFT JOIN t USING (g) GROUP BY 1")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of eight words that a held-out split shares with train, and how often train holds them."""
    d = _records(spark, sf_dir)
    g = cut(gram_rows(d.where("split <> 'train'"), "doc_id", "text", 8, "split").select("split", F.explode("g").alias("g")).distinct())
    want = g.select("g").distinct()
    t = exploded(gram_rows(d.where("split = 'train'"), "doc_id", "text", 8).select("g"), "g", key_filter(want)).groupBy("g").agg(F.count("*").alias("n")).join(want, "g", "left_semi")
    x = g.join(t, "g", "left").groupBy("split").agg(F.count("*").alias("ngrams"), F.count("n").alias("unique_overlapping_ngrams"), F.coalesce(F.sum("n"), F.lit(0)).alias("train_occurrences"))
    return x.withColumn("overlap_rate", F.round(F.col("unique_overlapping_ngrams") / F.col("ngrams"), 6))


def _repair(unit: str) -> str:
    """Rounds of repair as a search from train: a unit moves one round after a unit that shares a row of words with it."""
    return (
        _ONCE.replace("WITH", "WITH RECURSIVE", 1) + _GRAM + f""", h AS MATERIALIZED (SELECT DISTINCT g.doc_id, g.g, d.{unit} AS u FROM g JOIN d USING (doc_id) WHERE g.split <> 'train'),
 tr AS MATERIALIZED (SELECT DISTINCT g FROM g WHERE split = 'train' AND g IN (SELECT g FROM h)),
 m(u, i) USING KEY (u) AS (SELECT DISTINCT u, 1 FROM h WHERE g IN (SELECT g FROM tr)
  UNION (SELECT b.u, min(m.i) + 1 FROM m JOIN h a ON a.u = m.u JOIN h b ON b.g = a.g WHERE b.u NOT IN (SELECT u FROM recurring.m) GROUP BY b.u))
 SELECT doc_id, 'train' AS split, i AS moved_in FROM d JOIN m ON m.u = d.{unit} WHERE split IN ('val', 'test')"""
    )


@query(_repair("doc_id"))
def leak_repair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits after leaking records have been moved to train, record by record."""
    return repair_leaks(_records(spark, sf_dir), "doc_id", "text", "split", "doc_id").where("moved_in > 0")


@query(_repair("component_id"))
def leak_repair_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits after leaking records have been moved to train with their components."""
    return repair_leaks(_records(spark, sf_dir), "doc_id", "text", "split", "component_id").where("moved_in > 0")


_GRAM_CC = f"WITH RECURSIVE w AS (SELECT doc_id, {S.tokens(S.compare_form('text'))} AS w FROM documents WHERE text IS NOT NULL), s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({S.ngrams('w', 13)})) AS s FROM w), f AS (SELECT s, min(doc_id) AS a FROM s GROUP BY s), edges AS (SELECT DISTINCT f.a, s.doc_id AS b FROM s JOIN f USING (s) WHERE s.doc_id > f.a)"


@query(_GRAM_CC + _CC + "SELECT root, count(*) AS members, max(node) AS last_doc FROM c GROUP BY root")
def ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share thirteen words in a row, directly or through others."""
    x = connected(component_edges(table(spark, sf_dir, "documents"), "doc_id", "text", 13))
    return x.groupBy("root").agg(F.count("*").alias("members"), F.max("node").alias("last_doc"))


_PROBE = f"""WITH d AS (SELECT DISTINCT doc_id AS k, text, 0 AS held FROM split_stream UNION ALL SELECT id, prompt, 1 FROM m1_probe_v0 UNION ALL SELECT case_id, prompt, 1 FROM dev_smoke_suite),
 f AS MATERIALIZED (SELECT k, held, {S.compare_form('text')} AS f FROM d), w AS MATERIALIZED (SELECT k, held, string_split(f, ' ') AS w FROM f WHERE length(f) > 0), g AS (SELECT k, held, unnest({S.ngrams('w', 8)}) AS g FROM w)
 SELECT p.k AS item, count(DISTINCT t.k) AS records, count(DISTINCT g) AS ngrams FROM (SELECT * FROM g WHERE held = 1) p JOIN (SELECT * FROM g WHERE held = 0) t USING (g) GROUP BY 1"""


@query(_PROBE)
def probe_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out prompts of which eight words in a row occur in records, as they are."""
    items = table(spark, sf_dir, "m1_probe_v0").select(F.col("id").alias("item"), "prompt").unionByName(table(spark, sf_dir, "dev_smoke_suite").select(F.col("case_id").alias("item"), "prompt"))
    p = cut(gram_rows(items, "item", "prompt", 8).select("item", F.explode(F.array_distinct("g")).alias("g")))
    records = table(spark, sf_dir, "split_stream").select("doc_id", "text")
    t = exploded(gram_rows(records, "doc_id", "text", 8).withColumn("g", F.array_distinct("g")), "g", key_filter(p.select("g").distinct()))
    return t.join(p, "g").groupBy("item").agg(F.count_distinct("doc_id").alias("records"), F.count_distinct("g").alias("ngrams"))


_WORK = "split_part(doc_id, ':', 2)"


@query(f"SELECT {_WORK} AS work, count(DISTINCT split) AS splits, count(DISTINCT doc_id) AS records FROM split_stream WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that lie in more than one split."""
    x = table(spark, sf_dir, "split_stream").where("split IS NOT NULL").groupBy(F.split("doc_id", ":")[1].alias("work"))
    return x.agg(F.count_distinct("split").alias("splits"), F.count_distinct("doc_id").alias("records")).where("splits > 1")


@query(_SENT.replace("documents", "(SELECT DISTINCT doc_id, text, language AS lang FROM split_stream WHERE split IS NOT NULL)") + "SELECT component, count(DISTINCT s.doc_id) AS records, string_agg(DISTINCT s.split, ',' ORDER BY s.split) AS splits FROM p JOIN (SELECT DISTINCT doc_id, split FROM split_stream WHERE split IS NOT NULL) s ON s.doc_id = p.doc_id GROUP BY 1 HAVING count(DISTINCT s.split) > 1")
def straddling_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of records that share sentences and that the older split put into more than one split."""
    s = table(spark, sf_dir, "split_stream").where("split IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("split", "text")).alias("r")).select("doc_id", "r.*")
    x = content_components(s, "doc_id", "text").join(s.select("doc_id", "split"), "doc_id").groupBy("component").agg(F.count("*").alias("records"), F.array_sort(F.collect_set("split")).alias("s"))
    return x.where(F.size("s") > 1).select("component", "records", F.array_join("s", ",").alias("splits"))


@query("SELECT language FROM (SELECT DISTINCT language FROM split_stream WHERE split = 'train' AND language IS NOT NULL) WHERE language NOT IN (SELECT language FROM split_stream WHERE split = 'val' AND language IS NOT NULL)")
def languages_without_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that train holds and val doesn't (anti-join)."""
    s = table(spark, sf_dir, "split_stream").where("language IS NOT NULL")
    return s.where("split = 'train'").select("language").distinct().join(s.where("split = 'val'").select("language").distinct(), "language", "left_anti")
