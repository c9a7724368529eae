"""Queries on exact and near duplicates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import compare_form, fingerprint, tokens
from granary.operators.dedup import band_keys, band_links, connected, exact_winners, jaccard_pairs, merge_components, near_duplicates
from granary.operators.membership import gram_hashes
from granary.queries import query, table
from granary.queries import sql as S
from granary.session import cut

_FP = f"WITH f AS (SELECT doc_id, source, CASE WHEN length({S.collapse('text')}) > 0 THEN sha256({S.collapse('text')}) END AS fp FROM documents), w AS (SELECT *, min(doc_id) OVER (PARTITION BY fp) AS winner, count(*) OVER (PARTITION BY fp) AS copies FROM f) "
_LINKS = "(SELECT k.doc_id AS b, f.a FROM k JOIN (SELECT band, min(doc_id) AS a FROM k GROUP BY band) f USING (band) WHERE k.doc_id > f.a)"
_BANDS = f"WITH t AS MATERIALIZED (SELECT doc_id, {S.compare_form('text')} AS t FROM documents), g AS MATERIALIZED (SELECT doc_id, {S.shingles('t')} AS g FROM t WHERE length(t) > 0), h AS MATERIALIZED (SELECT doc_id, list_transform(g, lambda s: ('0x' || substr(md5(s), 1, 7))::BIGINT) AS h FROM g WHERE len(g) > 0), s AS MATERIALIZED (SELECT doc_id, {S.signature('h')} AS sig FROM h), k AS (SELECT doc_id, unnest({S.bands('sig')}) AS band FROM s) "


@query(_FP + "SELECT doc_id FROM w WHERE fp IS NOT NULL AND winner = doc_id")
def exact_dedup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept: the first of each text."""
    return exact_winners(table(spark, sf_dir, "documents"), "doc_id", "text").where("winner = doc_id").select("doc_id")


@query(_FP + "SELECT w.doc_id, w.source, CASE WHEN fp IS NULL THEN 'empty_text' ELSE 'exact_duplicate' END AS reason, CASE WHEN fp IS NOT NULL THEN winner END AS kept_doc_id, k.source AS kept_source, fp AS normalized_sha256 FROM w LEFT JOIN documents k ON fp IS NOT NULL AND k.doc_id = winner WHERE fp IS NULL OR winner <> w.doc_id")
def exact_dedup_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of what was removed, and in favour of what."""
    d = table(spark, sf_dir, "documents")
    x = exact_winners(d, "doc_id", "text").where("fp IS NULL OR winner <> doc_id").join(d.select("doc_id", "source"), "doc_id")
    x = x.join(d.select(F.col("doc_id").alias("winner"), F.col("source").alias("kept_source")), "winner", "left")
    return x.select("doc_id", "source", F.when(F.col("fp").isNull(), "empty_text").otherwise("exact_duplicate").alias("reason"), F.col("winner").alias("kept_doc_id"), "kept_source", F.col("fp").alias("normalized_sha256"))


@query(_FP + "SELECT fp, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM f WHERE fp IS NOT NULL GROUP BY fp HAVING count(*) > 1")
def exact_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents hold."""
    x = table(spark, sf_dir, "documents").withColumn("fp", fingerprint(F.col("text"))).where(F.length(F.regexp_replace("text", r"[\t-\r \x{85}\p{Z}]", "")) > 0)
    return x.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources")).where("copies > 1")


@query(_FP + "SELECT count(*) AS read, count(*) FILTER (fp IS NOT NULL AND winner = doc_id) AS kept, count(*) FILTER (fp IS NULL) AS empty_text, count(*) FILTER (fp IS NOT NULL AND winner <> doc_id) AS exact_duplicate FROM w")
def exact_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read, kept and removed by reason."""
    x = exact_winners(table(spark, sf_dir, "documents"), "doc_id", "text")
    return x.agg(F.count("*").alias("read"), F.count_if(F.col("winner") == F.col("doc_id")).alias("kept"), F.count_if(F.col("fp").isNull()).alias("empty_text"), F.count_if(F.col("winner") != F.col("doc_id")).alias("exact_duplicate"))


_JACCARD = f"""WITH t AS (SELECT {S.compare_form('text')} AS t, min(doc_id) AS k FROM split_stream WHERE length({S.compare_form('text')}) > 0 GROUP BY 1),
 g AS (SELECT k, {S.shingles('t')} AS g FROM t), u AS (SELECT k, len(g) AS n, unnest(g) AS s FROM g), o AS (SELECT s FROM u GROUP BY s HAVING count(*) > 1),
 v AS (SELECT u.* FROM u JOIN o USING (s)),
 p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM v a JOIN v b USING (s) WHERE a.k < b.k GROUP BY 1, 2)
 SELECT a, b, round(m / (na + nb - m)::DOUBLE, 6) AS jaccard FROM p WHERE m / (na + nb - m)::DOUBLE >= 0.8"""


@query(_JACCARD)
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct texts with four fifths of their character shingles in common."""
    return jaccard_pairs(table(spark, sf_dir, "split_stream"), "doc_id", "text").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(_BANDS + "SELECT doc_id, band FROM k")
def minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band keys of each document's MinHash signature."""
    return band_keys(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("k").alias("doc_id"), "band")


@query(_BANDS + f"SELECT DISTINCT a, b FROM {_LINKS}")
def minhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band's first document tied to the others with the band."""
    return band_links(table(spark, sf_dir, "documents"), "doc_id", "text")


_CC = """, e AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
 r(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b), c AS (SELECT node, min(label) AS root FROM r GROUP BY node) """


_CLUSTERS = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {S.compare_form('text')} AS t FROM documents), t AS (SELECT t, min(doc_id) AS k FROM d WHERE length(t) > 0 GROUP BY 1),
 g AS (SELECT k, {S.shingles('t')} AS g FROM t), u AS (SELECT k, len(g) AS n, unnest(g) AS s FROM g), o AS (SELECT s FROM u GROUP BY s HAVING count(*) > 1), v AS (SELECT u.* FROM u JOIN o USING (s)),
 p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM v a JOIN v b USING (s) WHERE a.k < b.k GROUP BY 1, 2),
 edges AS MATERIALIZED (SELECT a, b, m / (na + nb - m)::DOUBLE AS jaccard FROM p WHERE m / (na + nb - m)::DOUBLE >= 0.8 UNION ALL SELECT t.k, d.doc_id, 1.0 FROM d JOIN t USING (t) WHERE d.doc_id > t.k)""" + _CC.replace("e AS", "e AS MATERIALIZED", 1)
_LEAST = ", m AS (SELECT root, min(jaccard) AS least FROM edges JOIN c ON c.node = edges.a GROUP BY root) "


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_CLUSTERS + _LEAST + "SELECT root, count(*) AS members, max(node) AS last_doc, round(any_value(least), 6) AS least_similarity FROM c JOIN m USING (root) GROUP BY root")
def near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents tied by verified links, complete without banding, each under its first document."""
    return _near(spark, sf_dir).groupBy("root").agg(F.count("*").alias("members"), F.max("node").alias("last_doc"), F.round(F.first("least_similarity"), 6).alias("least_similarity"))


@query(_CLUSTERS + "SELECT node AS doc_id, root AS kept_doc_id, d.source, k.source AS kept_source, CASE WHEN d.t = k.t THEN 'exact_duplicate' ELSE 'near_duplicate' END AS reason FROM c JOIN d ON d.doc_id = node JOIN d k ON k.doc_id = root WHERE node <> root")
def near_duplicate_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of documents removed, and in favour of which: the first of their cluster."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(compare_form(F.col("text")), 256).alias("t"))
    x = _near(spark, sf_dir).where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id")).join(d, "doc_id")
    x = x.join(d.select(F.col("doc_id").alias("kept_doc_id"), F.col("source").alias("kept_source"), F.col("t").alias("kept_t")), "kept_doc_id")
    return x.select("doc_id", "kept_doc_id", "source", "kept_source", F.when(F.col("t") == F.col("kept_t"), "exact_duplicate").otherwise("near_duplicate").alias("reason"))


@query(_CLUSTERS + _LEAST + "SELECT (SELECT count(*) FROM documents) AS read, (SELECT count(*) FROM documents) - count(*) FILTER (node <> root) AS kept, count(*) FILTER (node <> root) AS removed, count(DISTINCT root) AS clusters, round(min(least), 6) AS least_similarity FROM c JOIN m USING (root)")
def near_duplicate_removal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read, kept and removed as near duplicates, clusters, and the least similarity of a link."""
    read = table(spark, sf_dir, "documents").agg(F.count("*").alias("read"))
    x = _near(spark, sf_dir).agg(F.count_if(F.col("node") != F.col("root")).alias("removed"), F.count_distinct("root").alias("clusters"), F.round(F.min("least_similarity"), 6).alias("least_similarity"))
    return read.join(x).select("read", (F.col("read") - F.col("removed")).alias("kept"), "removed", "clusters", "least_similarity")


@query(_FP + "SELECT source, kept_source, count(*) AS removed FROM (SELECT w.source, k.source AS kept_source FROM w JOIN documents k ON k.doc_id = winner WHERE fp IS NOT NULL AND winner <> w.doc_id) WHERE source IS DISTINCT FROM kept_source GROUP BY 1, 2")
def exact_dedup_across_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents removed in favour of one of another source."""
    x = exact_dedup_removed(spark, sf_dir).where("reason = 'exact_duplicate' AND NOT source <=> kept_source")
    return x.groupBy("source", "kept_source").agg(F.count("*").alias("removed"))


@query(_JACCARD.replace("SELECT a, b, round", "SELECT count(*) AS pairs, round(min(j), 6) AS least, round(max(j), 6) AS most FROM (SELECT a, b, round").replace(">= 0.8", ">= 0.8)").replace("AS jaccard FROM p", "AS j FROM p"))
def near_duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs and the range of their similarity."""
    return jaccard_pairs(table(spark, sf_dir, "split_stream"), "doc_id", "text").agg(F.count("*").alias("pairs"), F.round(F.min("jaccard"), 6).alias("least"), F.round(F.max("jaccard"), 6).alias("most"))


_B = "CASE WHEN n > 200 THEN 'over_200' WHEN n > 20 THEN 'over_20' WHEN n > 1 THEN 'shared' ELSE 'single' END"


@query(_BANDS + f"SELECT size, count(*) AS bands, sum(n)::BIGINT AS documents, max(n) AS largest FROM (SELECT *, {_B} AS size FROM (SELECT band, count(*) AS n FROM k GROUP BY 1)) GROUP BY 1")
def band_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents share a band: large bands are reported, never cut."""
    each = band_keys(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("band").agg(F.count("*").alias("n"))
    return each.groupBy(F.expr(_B).alias("size")).agg(F.count("*").alias("bands"), F.sum("n").alias("documents"), F.max("n").alias("largest"))


@query(_BANDS.replace("WITH t", "WITH RECURSIVE t", 1) + f", edges AS (SELECT DISTINCT a, b FROM {_LINKS})" + _CC + "SELECT node, root FROM c")
def merged_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of band links that come in two deliveries: those of the first, then merged with the links of the second."""
    links = cut(band_links(table(spark, sf_dir, "documents"), "doc_id", "text"))
    first = connected(links.where("b % 2 = 0"))
    return merge_components(first, links.where("b % 2 = 1"))


_HASHED = f"WITH d AS (SELECT doc_id, {S.tokens(S.compare_form('text'))} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest({S.ngrams('w', 5)}) AS g FROM d)"


@query(_HASHED + " SELECT doc_id, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM g GROUP BY 1")
def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of five words of each document, repeats kept and not, by their hashes."""
    x = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", gram_hashes(tokens(compare_form(F.col("text"))), 5).alias("g")).where(F.size("g") > 0)
    return x.select("doc_id", F.size("g").cast("bigint").alias("grams"), F.size(F.array_distinct("g")).cast("bigint").alias("distinct_grams"))
