"""Queries on ledgers, manifests, acquisition logs and reports."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.queries import query, table


@query("SELECT path, sha256, bytes, source_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(bytes, -1) DESC, coalesce(sha256, '') DESC, coalesce(source_id, '') DESC) AS n FROM artifact_ledger) WHERE n = 1")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a path of the ledger: the largest, where a path was fetched again."""
    best = F.max(F.struct(F.coalesce("bytes", F.lit(-1)).alias("b"), F.coalesce("sha256", F.lit("")).alias("h"), F.coalesce("source_id", F.lit("")).alias("s"), "sha256", "bytes", "source_id"))
    return table(spark, sf_dir, "artifact_ledger").groupBy("path").agg(best.alias("x")).select("path", "x.sha256", "x.bytes", "x.source_id")


@query("SELECT path, count(*) AS fetched, count(DISTINCT sha256) AS hashes FROM artifact_ledger GROUP BY path HAVING count(*) > 1")
def ledger_refetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths fetched more than once."""
    return table(spark, sf_dir, "artifact_ledger").groupBy("path").agg(F.count("*").alias("fetched"), F.count_distinct("sha256").alias("hashes")).where("fetched > 1")


@query("WITH l AS (SELECT DISTINCT path, sha256 FROM artifact_ledger), d AS (SELECT DISTINCT doc_id, provenance.artifact AS path, provenance.artifact_sha256 AS h FROM split_stream), j AS (SELECT d.doc_id, d.path, d.h, max(CASE WHEN l.sha256 = d.h THEN 1 ELSE 0 END) AS hit, count(l.path) AS n FROM d LEFT JOIN l USING (path) GROUP BY ALL) SELECT CASE WHEN path IS NULL THEN 'no_artifact' WHEN n = 0 THEN 'missing' WHEN hit = 1 THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS records FROM j GROUP BY 1")
def provenance_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose artifact the ledger has with the same hash, with another, or not at all."""
    d = table(spark, sf_dir, "split_stream").select("doc_id", F.col("provenance.artifact").alias("path"), F.col("provenance.artifact_sha256").alias("h")).distinct()
    led = table(spark, sf_dir, "artifact_ledger").select("path", "sha256").distinct().withColumn("in", F.lit(1))
    j = d.join(led, "path", "left").groupBy("doc_id", "path", "h").agg(F.max(F.when(F.col("sha256") == F.col("h"), 1).otherwise(0)).alias("hit"), F.count("in").alias("n"))
    return j.groupBy(F.when(F.col("path").isNull(), "no_artifact").when(F.col("n") == 0, "missing").when(F.col("hit") == 1, "ok").otherwise("mismatch").alias("status")).agg(F.count("*").alias("records"))


_PINNED = "coalesce(origin_revision = 'local' OR regexp_matches(origin_revision, '^[0-9a-f]{40}$'), false)"


@query(f"SELECT source_id, count(*) AS artifacts, count(*) FILTER ({_PINNED}) AS pinned, sum(bytes)::BIGINT AS bytes FROM artifact_ledger GROUP BY 1")
def pinned_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of a pinned revision per source."""
    pinned = F.coalesce((F.col("origin_revision") == "local") | F.col("origin_revision").rlike("^[0-9a-f]{40}$"), F.lit(False))
    return table(spark, sf_dir, "artifact_ledger").groupBy("source_id").agg(F.count("*").alias("artifacts"), F.count_if(pinned).alias("pinned"), F.sum("bytes").alias("bytes"))


@query("SELECT path FROM artifact_ledger WHERE NOT regexp_matches(path, '(^|/)(tmp|cache)/') AND regexp_matches(path, '\\.(txt|json|jsonl|html|md|xml)$') AND coalesce(NOT skipped, true) AND coalesce(NOT excluded_from_corpus, true) GROUP BY 1")
def included_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the ledger by patterns: exclusions first, then what is included."""
    x = table(spark, sf_dir, "artifact_ledger").where(~F.col("path").rlike("(^|/)(tmp|cache)/") & F.col("path").rlike(r"\.(txt|json|jsonl|html|md|xml)$"))
    return x.where(F.coalesce(~F.col("skipped"), F.lit(True)) & F.coalesce(~F.col("excluded_from_corpus"), F.lit(True))).select("path").distinct()


_ISSUES = [
    ("license IS NULL OR trim(license) = ''", "license_missing", "error"), ("license_url IS NULL OR trim(license_url) = ''", "license_url_missing", "warning"),
    ("NOT coalesce(license_verified, false)", "license_unverified", "warning"), ("domain IS NULL OR trim(domain) = ''", "domain_missing", "warning"),
    ("status NOT IN ('available', 'blocked', 'needs_review', 'rejected') OR status IS NULL", "status_unknown", "error"), ("synthetic AND natural", "synthetic_and_natural", "error"),
    ("coalesce(size_tokens, 0) <= 0", "size_unmeasured", "warning"), ("domain <> lower(trim(domain))", "domain_untidy", "warning"),
    ("id IS NULL OR NOT regexp_like(id, '^[a-z0-9_]+$')", "id_malformed", "error"), ("name IS NULL OR trim(name) = ''", "name_missing", "error"), ("provider IS NULL OR trim(provider) = ''", "provider_missing", "warning"),
    ("url IS NULL OR NOT regexp_like(url, '^https?://')", "url_malformed", "error"), ("languages IS NULL OR cardinality(languages) = 0", "languages_missing", "error"), ("cardinality(languages) > 5", "languages_many", "warning"),
    ("status = 'available' AND NOT coalesce(license_verified, false)", "available_unverified", "error"), ("model_training_allowed AND license IS NULL", "allowed_without_license", "error"),
    ("share_alike AND NOT coalesce(attribution_required, false)", "share_alike_without_attribution", "warning"), ("redistribution_allowed AND NOT coalesce(license_verified, false)", "redistribution_unverified", "warning"),
    ("NOT coalesce(synthetic, false) AND NOT coalesce(natural, false)", "neither_synthetic_nor_natural", "error"), ("status = 'rejected' AND notes IS NULL", "rejected_without_note", "warning"),
]


@query("SELECT id, issue.code AS code, issue.severity AS severity FROM (SELECT id, unnest([" + ", ".join(f"CASE WHEN {c} THEN {{'code': '{n}', 'severity': '{s}'}} END" for c, n, s in _ISSUES).replace("AND natural", "AND \"natural\"").replace("coalesce(natural,", "coalesce(\"natural\",").replace("regexp_like(", "regexp_matches(").replace("cardinality(", "len(") + "]) AS issue FROM source_manifest) WHERE issue IS NOT NULL")
def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with each source of the manifest, a row an issue."""
    tests = F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("code"), F.lit(s).alias("severity"))) for c, n, s in _ISSUES])
    return table(spark, sf_dir, "source_manifest").select("id", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("i")).select("id", "i.code", "i.severity")


@query("WITH a AS (SELECT source_id, max(CASE WHEN outcome = 'ok' OR outcome = 'success' THEN 1 ELSE 0 END) AS got FROM acquisition_log GROUP BY 1) SELECT m.id, CASE WHEN m.status <> 'available' THEN 'not_available' WHEN NOT coalesce(m.license_verified, false) THEN 'unverified' WHEN NOT coalesce(m.model_training_allowed, false) THEN 'not_allowed' WHEN a.source_id IS NULL THEN 'not_acquired' END AS refused FROM source_manifest m LEFT JOIN a ON a.source_id = m.id")
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason to refuse each source; null for usable ones."""
    a = table(spark, sf_dir, "acquisition_log").select(F.col("source_id").alias("id")).distinct().withColumn("got", F.lit(True))
    x = table(spark, sf_dir, "source_manifest").join(a, "id", "left")
    return x.select("id", F.when(F.col("status") != "available", "not_available").when(~F.coalesce("license_verified", F.lit(False)), "unverified").when(~F.coalesce("model_training_allowed", F.lit(False)), "not_allowed").when(F.col("got").isNull(), "not_acquired").alias("refused"))


@query("SELECT source_id, stage, outcome, count(DISTINCT log_id) AS events, max(attempts) AS most_attempts FROM acquisition_log GROUP BY 1, 2, 3")
def acquisition_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the acquisition log by source, stage and outcome; an event that arrived twice counts once."""
    return table(spark, sf_dir, "acquisition_log").groupBy("source_id", "stage", "outcome").agg(F.count_distinct("log_id").alias("events"), F.max("attempts").alias("most_attempts"))


@query("SELECT source_id, log_id, outcome, retry_status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts_utc DESC NULLS LAST, log_id DESC) AS n FROM (SELECT DISTINCT source_id, log_id, outcome, retry_status, ts_utc FROM acquisition_log)) WHERE n = 1")
def acquisition_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each source."""
    x = table(spark, sf_dir, "acquisition_log").select("source_id", "log_id", "outcome", "retry_status", "ts_utc").distinct()
    w = Window.partitionBy("source_id").orderBy(F.col("ts_utc").desc_nulls_last(), F.col("log_id").desc())
    return x.withColumn("n", F.row_number().over(w)).where("n = 1").select("source_id", "log_id", "outcome", "retry_status")


_LEAK = "measured.unique_overlapping_ngrams = 0 AND measured.overlapping_ngram_occurrences_train = 0 AND measured.cross_split_near_duplicate_pairs = 0"


@query(f"SELECT report_id, split, source_id, CASE WHEN coalesce({_LEAK}, false) THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS rows FROM corpus_report GROUP BY ALL")
def leakage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes only where all three counts were measured and are zero; missing counts fail."""
    ok = F.coalesce(F.expr(_LEAK), F.lit(False))
    return table(spark, sf_dir, "corpus_report").groupBy("report_id", "split", "source_id", F.when(ok, "pass").otherwise("fail").alias("verdict")).agg(F.count("*").alias("rows"))


@query("SELECT source_id, split, count(*) AS reports, sum(CASE WHEN measured.unique_overlapping_ngrams >= 0 THEN measured.unique_overlapping_ngrams END)::BIGINT AS unique_ngrams, count(*) FILTER (measured.unique_overlapping_ngrams < 0 OR measured.unique_overlapping_ngrams IS NULL) AS unmeasured FROM (SELECT DISTINCT report_id, source_id, split, gate, measured FROM corpus_report) GROUP BY 1, 2")
def leakage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What past builds measured, repeated rows once; unmeasured stays apart from zero."""
    x = table(spark, sf_dir, "corpus_report").select("report_id", "source_id", "split", "gate", "measured").distinct().withColumn("u", F.col("measured.unique_overlapping_ngrams"))
    return x.groupBy("source_id", "split").agg(F.count("*").alias("reports"), F.sum(F.when(F.col("u") >= 0, F.col("u"))).alias("unique_ngrams"), F.count_if((F.col("u") < 0) | F.col("u").isNull()).alias("unmeasured"))


@query("SELECT m.id AS source_id, s.split FROM source_manifest m CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split) WHERE NOT EXISTS (SELECT 1 FROM split_stream r WHERE split_part(r.doc_id, ':', 1) = m.id AND r.split = s.split)")
def unused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits in which no record has a source of the manifest (anti-join)."""
    used = table(spark, sf_dir, "split_stream").select(F.split("doc_id", ":")[0].alias("source_id"), "split").distinct()
    every = table(spark, sf_dir, "source_manifest").select(F.col("id").alias("source_id"), F.explode(F.array(*map(F.lit, ("train", "val", "test")))).alias("split"))
    return every.join(used, ["source_id", "split"], "left_anti")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_text' END, CASE WHEN language IS NULL OR trim(language) = '' THEN 'no_language' END, CASE WHEN source_id IS NULL THEN 'unattributed' END, CASE WHEN license IS NULL THEN 'no_license' END, CASE WHEN provenance.artifact IS NULL THEN 'no_provenance' END], lambda x: x IS NOT NULL), ',') AS issues FROM (SELECT DISTINCT doc_id, text, language, source_id, license, provenance FROM split_stream) WHERE text IS NULL OR trim(text) = '' OR language IS NULL OR trim(language) = '' OR source_id IS NULL OR license IS NULL OR provenance.artifact IS NULL")
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of each record that has any."""
    x = table(spark, sf_dir, "split_stream").groupBy("doc_id").agg(F.min(F.struct("text", "language", "source_id", "license", F.col("provenance.artifact").alias("a"))).alias("r")).select("doc_id", "r.*")
    blank = lambda c: F.col(c).isNull() | (F.regexp_replace(c, r"[ \x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", "") == "")
    tests = [(blank("text"), "empty_text"), (blank("language"), "no_language"), (F.col("source_id").isNull(), "unattributed"), (F.col("license").isNull(), "no_license"), (F.col("a").isNull(), "no_provenance")]
    return x.select("doc_id", F.filter(F.array(*[F.when(t, n) for t, n in tests]), lambda i: i.isNotNull()).alias("i")).where(F.size("i") > 0).select("doc_id", F.array_join("i", ",").alias("issues"))


@query("SELECT path, k AS source_id, v AS documents FROM (SELECT path, unnest(map_entries(source_id_counts)) AS e FROM dataset) t, LATERAL (SELECT e.key AS k, e.value AS v)")
def shard_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per shard and source, from the maps of dataset."""
    return table(spark, sf_dir, "dataset").select("path", F.explode("source_id_counts").alias("source_id", "documents"))


_FREE = ("", "unknown", "none", "proprietary")
_LICENSED = f"coalesce(lower(trim(license)), '') NOT IN ({', '.join(chr(39) + x + chr(39) for x in _FREE)})"


@query(f"SELECT id, {_LICENSED} AS license_ok, coalesce({_LICENSED} AND license_verified AND model_training_allowed, false) AS usable, coalesce({_LICENSED} AND redistribution_allowed, false) AS redistributable, coalesce(m.\"natural\" AND NOT synthetic, false) AS is_natural FROM source_manifest m")
def source_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source may be used for."""
    ok = ~F.coalesce(F.lower(F.trim("license")), F.lit("")).isin(*_FREE)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return table(spark, sf_dir, "source_manifest").select("id", ok.alias("license_ok"), yes(ok & F.col("license_verified") & F.col("model_training_allowed")).alias("usable"), yes(ok & F.col("redistribution_allowed")).alias("redistributable"), yes(F.col("natural") & ~F.col("synthetic")).alias("is_natural"))
