"""Queries on degenerate texts, critics, rules of records, record statistics, paths, expressions, sets and gates."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import collapse, compare_form, let, ngrams, tokens
from granary.operators.checks import DEGENERATE, PLACEHOLDERS, critics, degeneracy, evaluated, glob_pattern, language_by_path, most_alike, path_matches, violations, worst
from granary.operators.dedup import jaccard_pairs
from granary.operators.langid import EXPECTED
from granary.operators.learning import arithmetic_claims, bucketed_sample
from granary.queries import query, table
from granary.queries import sql as S
from granary.queries.storage import folder
from granary.sources.files import read_yaml_list
from granary.sources.sinks import write_routes

_D = DEGENERATE
_CYCLE = lambda k, r: f"(n >= ({r}) * {k} AND w[n - ({r}) * {k} + 1:n - {k}] = w[n - (({r}) - 1) * {k} + 1:n])"
_NEED = lambda k: f"greatest(3, floor(n * {_D['cycle']} / {k})::INT + 1)"
_MOST = lambda values: f"list_max(map_values(list_aggregate({values}, 'histogram')))"
_DEGENERATE = f"""WITH t AS (SELECT doc_id, text, coalesce({S.tokens('text')}, []) AS w FROM documents), m AS (SELECT *, len(w) AS n, {S.ngrams('w', 4)} AS g, regexp_replace(text, '[ \\n]', '', 'g') AS b FROM t),
 r AS (SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\\t-\\r \\x{{85}}\\p{{Z}}]') THEN ['empty'] ELSE list_filter([
  CASE WHEN n >= {_D['run']} AND {_CYCLE('1', str(_D['run']))} THEN 'run' END, CASE WHEN n >= {3 * _D['ngram']} AND {_CYCLE(str(_D['ngram']), '3')} THEN 'repeats' END,
  CASE WHEN n >= 6 AND ({' OR '.join(_CYCLE(str(k), _NEED(k)) for k in range(1, _D['period'] + 1))}) THEN 'cycle' END,
  CASE WHEN n >= 6 AND len(g) >= 6 AND len(list_distinct(g)) / len(g)::DOUBLE < {_D['distinct']} THEN 'looping' END,
  CASE WHEN length(b) >= 12 AND {_MOST("regexp_extract_all(b, '(?s).')")} / length(b)::DOUBLE > {_D['dominance']} THEN 'dominance' END], lambda x: x IS NOT NULL) END AS reasons FROM m) """


@query(_DEGENERATE + "SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0")
def degenerate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degenerate documents, with all reasons."""
    x = table(spark, sf_dir, "documents").select("doc_id", degeneracy(F.col("text"), tokens(F.col("text"))).alias("r")).where(F.size("r") > 0)
    return x.select("doc_id", F.array_join("r", ",").alias("reasons"))


@query(_DEGENERATE + "SELECT lang, count(*) AS texts, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS degenerate, round(avg(len(w)), 4) AS mean_tokens FROM r JOIN t USING (doc_id) JOIN documents d USING (doc_id) GROUP BY lang")
def acceptance_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, sound and degenerate ones, and mean tokens per label."""
    w = tokens(F.col("text"))
    x = table(spark, sf_dir, "documents").select("lang", F.size(degeneracy(F.col("text"), w)).alias("r"), F.coalesce(F.size(w), F.lit(0)).alias("n"))
    return x.groupBy("lang").agg(F.count("*").alias("texts"), F.count_if(F.col("r") == 0).alias("accepted"), F.count_if(F.col("r") > 0).alias("degenerate"), F.round(F.avg("n"), 4).alias("mean_tokens"))


_WS = r"[\t-\r \x{85}\p{Z}]"
_BLANK = lambda c: f"NOT regexp_matches({c}, {S.q('[^' + _WS[1:])})"
_FORM = lambda c: f"regexp_replace(lower(regexp_replace({c}, {S.q(_WS + '+')}, ' ', 'g')), '^ | $', '', 'g')"
_EDGES = "'^[\\t-\\r ]+|[\\t-\\r ]+$'"
_EXPECTED = "CASE " + " ".join(f"WHEN a = '{k}' THEN '{v}'" for k, v in EXPECTED.items()) + " END"
_SCRIPT = "CASE WHEN r <> '' THEN r ELSE t END"
_N = lambda p: f"len(regexp_extract_all({_SCRIPT}, {S.q(p)}))"
_DRAFTS = f"""WITH c AS (SELECT doc_id, coalesce(source, '') AS t, coalesce(text, '') AS r, coalesce(lang, '') AS a FROM documents),
 m AS (SELECT *, regexp_replace(t || ' ' || r || ' ' || a, {_EDGES}, '', 'g') AS body, {_N('[\\x{900}-\\x{97f}]')} AS dv, {_N('[A-Za-z]')} AS lt, {_EXPECTED} AS script,
  list_filter(list_transform(regexp_split_to_array(r, '[।.!?\\n]+'), lambda s: regexp_replace(s, {_EDGES}, '', 'g')), lambda s: length(s) > 8) AS said FROM c),
 f AS (SELECT doc_id, 'field_completeness' AS critic, CASE WHEN {_BLANK('t')} OR {_BLANK('r')} OR {_BLANK('a')} THEN 'reject' ELSE 'ok' END AS verdict, CASE WHEN {_BLANK('t')} OR {_BLANK('r')} OR {_BLANK('a')} THEN 'MISSING_FIELD' END AS code FROM m
  UNION ALL SELECT doc_id, 'substance', 'reject', 'TOO_SHORT' FROM m WHERE length(body) < 12
  UNION ALL SELECT doc_id, 'placeholder_scan', 'reject', 'PLACEHOLDER_TEXT' FROM m WHERE {' OR '.join(f'contains(lower(body), {S.q(p)})' for p in PLACEHOLDERS)}
  UNION ALL SELECT doc_id, 'prompt_echo', 'warn', 'ANSWER_ECHOES_PROMPT' FROM m WHERE length({_FORM('a')}) > 0 AND contains({_FORM('t')}, {_FORM('a')})
  UNION ALL SELECT doc_id, 'language_script', 'warn', 'LANGUAGE_SCRIPT_MISMATCH' FROM m WHERE script IS NOT NULL AND CASE WHEN dv + lt = 0 THEN 0.0 ELSE round(CASE WHEN script = 'latin' THEN lt ELSE dv END / (dv + lt)::DOUBLE, 3) END < 0.5
  UNION ALL SELECT doc_id, 'degeneracy', 'warn', 'DEGENERATE_REPETITION' FROM m WHERE len(said) > 2 AND {_MOST('said')} >= 3) """


def _findings() -> Column:
    c = F.col
    return critics(c("source"), c("text"), c("lang"), c("lang"), c("source"))


@query(_DRAFTS + "SELECT doc_id, critic, verdict, code FROM f WHERE verdict <> 'ok'")
def critic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the critics find in each document taken as a draft (task: source, answer: label)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(_findings()).alias("f")).where("f.verdict <> 'ok'").select("doc_id", "f.critic", "f.verdict", "f.code")


@query(_DRAFTS + "SELECT critic, verdict, code, count(*) AS findings FROM f GROUP BY ALL")
def critic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by critic, verdict and code."""
    return table(spark, sf_dir, "documents").select(F.explode(_findings()).alias("f")).groupBy("f.critic", "f.verdict", "f.code").agg(F.count("*").alias("findings"))


_ROUTE = "CASE max(CASE verdict WHEN 'reject' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'rejected' WHEN 1 THEN 'quarantined' ELSE 'accepted' END"


@query(_DRAFTS + f"SELECT route, lang, count(*) AS drafts FROM (SELECT doc_id, {_ROUTE} AS route FROM f GROUP BY doc_id) JOIN documents USING (doc_id) GROUP BY 1, 2")
def draft_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the worst finding sends each draft, per label."""
    v = worst(_findings())
    x = table(spark, sf_dir, "documents").select("lang", F.when(v == "reject", "rejected").when(v == "warn", "quarantined").otherwise("accepted").alias("route"))
    return x.groupBy("route", "lang").agg(F.count("*").alias("drafts"))


_LANGUAGES = ("hi", "en", "hinc-latn", "hinc-deva", "mr", "sa", "bn", "te", "gu", "pa")
_RULES = {
    "bad_id": "NOT regexp_matches(doc_id, '^[^:]+:[^:]+:[0-9]+$')",
    "unknown_language": f"language IS NULL OR language NOT IN ({', '.join(map(S.q, _LANGUAGES))})",
    "empty_text": f"text IS NULL OR {_BLANK('text')}",
    "synthetic_and_natural": "synthetic AND \"natural\"",
    "license_without_url": "license_verified AND license IS NOT NULL AND license_url IS NULL",
    "unverified_license": "license IS NOT NULL AND NOT license_verified",
    "no_license": "license IS NULL",
    "attribution_without_source": "attribution_required AND source_id IS NULL",
    "no_artifact": "provenance.artifact IS NULL",
    "no_revision": "provenance.origin_repo IS NOT NULL AND provenance.origin_revision IS NULL",
    "no_split": "split IS NULL",
    "wrong_length": "text IS NOT NULL AND chars <> length(text)",
}
_WARNINGS = {"unverified_license": "warning", "no_revision": "warning", "attribution_without_source": "warning"}
_ONE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shard, split) AS delivery FROM split_stream) WHERE delivery = 1)"


def _rules() -> dict[str, Column]:
    return {k: F.expr(v.replace('"', "").replace("regexp_matches", "regexp").replace("\\x{85}", "\\\\x{85}").replace("\\p{Z}", "\\\\p{Z}").replace("\\t-\\r", "\\\\t-\\\\r")) for k, v in _RULES.items()}


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once: copies are unchanged, so any of them will do."""
    s = table(spark, sf_dir, "split_stream")
    return s.groupBy("doc_id").agg(F.min(F.struct(*[c for c in s.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*")


@query(f"SELECT doc_id, unnest(list_filter([{', '.join(f'CASE WHEN {v} THEN {S.q(k)} END' for k, v in _RULES.items())}], lambda x: x IS NOT NULL)) AS code FROM {_ONE}".replace("SELECT doc_id, unnest", "SELECT doc_id, code, CASE WHEN code IN ('unverified_license', 'no_revision', 'attribution_without_source') THEN 'warning' ELSE 'error' END AS severity FROM (SELECT doc_id, unnest", 1) + ")")
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a record breaks, with its severity."""
    return violations(_deliveries(spark, sf_dir), "doc_id", _rules(), _WARNINGS)


@query(f"SELECT source, code, count(*) AS records FROM (SELECT split_part(doc_id, ':', 1) AS source, unnest(list_filter([{', '.join(f'CASE WHEN {v} THEN {S.q(k)} END' for k, v in _RULES.items())}], lambda x: x IS NOT NULL)) AS code FROM {_ONE}) GROUP BY 1, 2")
def record_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break a rule, per source and rule."""
    x = violations(_deliveries(spark, sf_dir), "doc_id", _rules(), _WARNINGS)
    return x.groupBy(F.split("doc_id", ":")[0].alias("source"), "code").agg(F.count("*").alias("records"))


_KEYS = {"split": "split", "language": "language", "source": "split_part(doc_id, ':', 1)", "license": "license", "format": "provenance.format", "natural": "\"natural\"::VARCHAR", "synthetic": "synthetic::VARCHAR"}


@query(f"SELECT key, coalesce(value, '(none)') AS value, count(*) AS records FROM (SELECT unnest([{', '.join(f'{{k: {S.q(k)}, v: {v}}}' for k, v in _KEYS.items())}], recursive := true) FROM {_ONE}) t(key, value) GROUP BY 1, 2")
def record_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by each of seven keys, in one scan."""
    keys = {**{k: F.col(v) if k != "source" else F.split("doc_id", ":")[0] for k, v in _KEYS.items() if "::" not in v}, "natural": F.col("natural").cast("string"), "synthetic": F.col("synthetic").cast("string")}
    x = _deliveries(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit("(none)")).alias("value")) for k, v in keys.items()])).alias("x"))
    return x.groupBy("x.key", "x.value").agg(F.count("*").alias("records"))


@query(f"SELECT count(*) AS records, count(DISTINCT sha256(text)) AS unique_content, sum(coalesce(length(text), 0))::BIGINT AS chars, count(*) FILTER (synthetic) AS synthetic, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) FILTER (provenance.artifact IS NULL) AS provenance_gaps, (SELECT count(*) FROM (SELECT sha256(text) FROM {_ONE} WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_content_groups FROM {_ONE}")
def record_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the records: contents, characters, splits, synthetic ones, gaps in provenance, contents that occur again."""
    x = _deliveries(spark, sf_dir).select(F.sha2("text", 256).alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("c"), "synthetic", "split", F.col("provenance.artifact").isNull().alias("gap"))
    sums = [F.count("*").alias("records"), F.sum("c").alias("chars"), F.count_if("synthetic").alias("synthetic"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")], F.count_if("gap").alias("gaps")]
    each = x.groupBy("h").agg(*sums)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return each.agg(total("records").alias("records"), F.count("h").alias("unique_content"), total("chars").alias("chars"), total("synthetic").alias("synthetic"), *[total(s).alias(s) for s in ("train", "val", "test")], total("gaps").alias("provenance_gaps"), F.count_if(F.col("h").isNotNull() & (F.col("records") > 1)).alias("duplicate_content_groups"))


@query(f"""SELECT split, issue, n, CASE WHEN issue IN ('empty_text', 'duplicate_id') THEN 'error' ELSE 'warning' END AS severity FROM (
 SELECT split, 'duplicate_id' AS issue, count(*) AS n FROM (SELECT split, doc_id FROM split_stream GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
 UNION ALL SELECT split, 'empty_text', count(*) FROM split_stream WHERE text IS NULL OR {_BLANK('text')} GROUP BY 1
 UNION ALL SELECT split, 'missing_language', count(*) FROM split_stream WHERE language IS NULL OR {_BLANK('language')} GROUP BY 1
 UNION ALL SELECT split, 'unattributed', count(*) FROM split_stream WHERE source_id IS NULL GROUP BY 1)""")
def dataset_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each split: ids that occur again, empty texts, missing languages, missing sources."""
    blank = lambda c: F.col(c).isNull() | ~F.col(c).rlike("[^" + _WS[1:])
    s = table(spark, sf_dir, "split_stream").select("split", "doc_id", blank("text").cast("int").alias("empty_text"), blank("language").cast("int").alias("missing_language"), F.col("source_id").isNull().cast("int").alias("unattributed"))
    each = s.groupBy("split", "doc_id").agg((F.count("*") > 1).cast("int").alias("duplicate_id"), *[F.sum(c).alias(c) for c in ("empty_text", "missing_language", "unattributed")])
    names = ("duplicate_id", "empty_text", "missing_language", "unattributed")
    x = each.groupBy("split").agg(*[F.sum(c).alias(c) for c in names])
    x = x.select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("issue"), F.col(c).alias("n"), F.lit("error" if c in names[:2] else "warning").alias("severity")) for c in names])).alias("x"))
    return x.where("x.n > 0").select("split", "x.issue", "x.n", "x.severity")


_CASES = {
    "no_expected": "verification IN ('exact', 'numeric', 'set') AND expected IS NULL", "not_a_number": "verification = 'numeric' AND expected IS NOT NULL AND NOT regexp_matches(expected, '[0-9]')", "unknown_verification": "verification NOT IN ('exact', 'numeric', 'set', 'manual', 'integrity_only')",
    "negative_tolerance": "tolerance < 0", "tolerance_unused": "tolerance > 0 AND verification <> 'numeric'", "no_node": "curriculum_node IS NULL", "no_tags": "tags IS NULL OR len(tags) = 0", "short_prompt": "length(prompt) < 20",
}


@query(f"SELECT case_id, unnest(list_filter([{', '.join(f'CASE WHEN {v} THEN {S.q(k)} END' for k, v in _CASES.items())}], lambda x: x IS NOT NULL)) AS code FROM dev_smoke_suite")
def suite_case_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a case of the suite breaks."""
    rules = {k: F.expr(v.replace("regexp_matches", "regexp").replace("len(tags)", "size(tags)")) for k, v in _CASES.items()}
    return violations(table(spark, sf_dir, "dev_smoke_suite"), "case_id", rules).drop("severity")


_GRID = [(k, x, d) for k in ("explain", "solve", "correct") for x in ("en", "hi") for d in ("beginner", "intermediate")]


@query(f"SELECT n AS node, t.kind, t.language, t.difficulty, n || ':' || t.kind || ':' || t.language || ':' || t.difficulty AS request_id FROM (SELECT DISTINCT curriculum_node AS n FROM dev_smoke_suite WHERE curriculum_node IS NOT NULL) CROSS JOIN (VALUES {', '.join(map(str, _GRID[:8]))}) t(kind, language, difficulty)")
def request_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each node: kinds by languages by difficulties in order, at most eight a node (the cap is the feature)."""
    grid = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("language"), F.lit(d).alias("difficulty")) for k, x, d in _GRID])
    nodes = table(spark, sf_dir, "dev_smoke_suite").where("curriculum_node IS NOT NULL").select(F.col("curriculum_node").alias("node")).distinct()
    x = nodes.select("node", F.explode(F.slice(grid, 1, 8)).alias("g")).select("node", "g.*")
    return x.withColumn("request_id", F.concat_ws(":", "node", "kind", "language", "difficulty"))


_INCLUDE, _EXCLUDE = ("data/raw/*_hi/**", "*.html", "data/raw/*_en/*"), ("*/letters-*", "data/raw/zira_news_hi/**")
_RE = lambda globs: " OR ".join(f"regexp_matches(path, {S.q(glob_pattern(g))})" for g in globs)


@query(f"SELECT DISTINCT path FROM artifact_ledger WHERE ({_RE(_INCLUDE)}) AND NOT ({_RE(_EXCLUDE)})")
def paths_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the ledger that the include patterns match and the exclude patterns don't."""
    return table(spark, sf_dir, "artifact_ledger").select("path").where(path_matches(F.col("path"), _INCLUDE, _EXCLUDE)).distinct()


_BY_PATH = [("data/raw/*_hi/**", "hi"), ("*_en/*", "en"), ("*hinclatn*", "hinc-latn"), ("data/raw/*_gu/", "gu")]


@query(f"SELECT DISTINCT path, CASE {' '.join(f'WHEN regexp_matches(path, {S.q(glob_pattern(g))}) THEN {S.q(x)}' for g, x in _BY_PATH)} ELSE coalesce(m.languages[1], 'unknown') END AS language FROM artifact_ledger l LEFT JOIN source_manifest m ON m.id = l.source_id WHERE path IS NOT NULL")
def languages_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each path by the first pattern that matches, else its source's first language."""
    m = table(spark, sf_dir, "source_manifest").select(F.col("id").alias("source_id"), F.get("languages", F.lit(0)).alias("declared"))
    x = table(spark, sf_dir, "artifact_ledger").where("path IS NOT NULL").select("path", "source_id").distinct().join(m, "source_id", "left")
    return x.select("path", language_by_path(F.col("path"), _BY_PATH, F.col("declared")).alias("language")).distinct()


@query("SELECT path, exclusion_reason FROM (SELECT DISTINCT path, exclusion_reason FROM artifact_ledger WHERE excluded_from_corpus)")
def corpus_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that the ledger keeps out of the corpus."""
    return table(spark, sf_dir, "artifact_ledger").where("excluded_from_corpus").select("path", "exclusion_reason").distinct()


@query("WITH l AS (SELECT path, max(bytes) AS bytes, list_sort(list_distinct(list(sha256))) AS hashes FROM artifact_ledger WHERE path IS NOT NULL GROUP BY 1), u AS (SELECT DISTINCT provenance.artifact AS path, provenance.artifact_sha256 AS h FROM split_stream WHERE provenance.artifact IS NOT NULL) SELECT path, h AS sha256, coalesce(bytes > 0, false) AND coalesce(list_contains(hashes, h), false) AS valid FROM u LEFT JOIN l USING (path)")
def artifacts_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ledger still vouches for each artifact that records cite: its size known, its hash the same."""
    ledger = table(spark, sf_dir, "artifact_ledger").where("path IS NOT NULL").groupBy("path").agg(F.max("bytes").alias("bytes"), F.collect_set("sha256").alias("hashes"))
    used = table(spark, sf_dir, "split_stream").select(F.col("provenance.artifact").alias("path"), F.col("provenance.artifact_sha256").alias("sha256")).where("path IS NOT NULL").distinct()
    ok = F.coalesce(F.col("bytes") > 0, F.lit(False)) & F.coalesce(F.array_contains("hashes", F.col("sha256")), F.lit(False))
    return used.join(ledger, "path", "left").select("path", "sha256", ok.alias("valid"))


@query("SELECT id, provider FROM source_manifest WHERE status = 'available' AND license_verified AND model_training_allowed AND license IS NOT NULL")
def fetchable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are available, of a verified licence that allows their use."""
    return table(spark, sf_dir, "source_manifest").where("status = 'available' AND license_verified AND model_training_allowed AND license IS NOT NULL").select("id", "provider")


@query("SELECT coalesce(status, '(none)') AS status, count(*) AS sources, sum(coalesce(size_tokens, 0))::BIGINT AS tokens FROM source_manifest GROUP BY 1")
def sources_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and stated tokens by status."""
    return table(spark, sf_dir, "source_manifest").groupBy(F.coalesce("status", F.lit("(none)")).alias("status")).agg(F.count("*").alias("sources"), F.sum(F.coalesce("size_tokens", F.lit(0))).alias("tokens"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN round((event_id % 7 + event_id % 5 + 1) * pow(2, event_id % 4) / (event_id % 3) - 1.5, 9) END AS value FROM events")
def evaluated_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact values of nested expressions with powers; none where one divides by zero."""
    i = F.col("event_id")
    e = F.concat(F.lit("("), (i % 7).cast("string"), F.lit(" + ("), (i % 5).cast("string"), F.lit(" + 1)) * 2 ** "), (i % 4).cast("string"), F.lit(" ÷ "), (i % 3).cast("string"), F.lit(" - 1.5"))
    return table(spark, sf_dir, "events").select("event_id", F.round(evaluated(e)["value"], 9).alias("value"))


_SUM = "event_id % 9 || ' + ' || event_id % 4 || ' = ' || (event_id % 9 + event_id % 4 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END)"
_PCT = "(event_id % 10 * 10) || '% of 50 is ' || (event_id % 10 * 5 + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END)"


@query(f"SELECT event_id, {_SUM} AS claim, event_id % 5 <> 0 AS holds FROM events UNION ALL SELECT event_id, {_PCT}, event_id % 6 <> 0 FROM events")
def arithmetic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic claims of a text and whether they hold, exactly."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(f"concat('It is said that ', {_SUM.replace('||', ',')}, ' and that ', {_PCT.replace('||', ',')}, '.')").alias("text"))
    return arithmetic_claims(e, "event_id", "text")


_SHARES = {"long": 0.45, "medium": 0.35, "short": 0.2}
_QUOTAS, _PREFER = {"long": 180, "medium": 140, "short": 80}, ("medium", "short", "long")
_BUCKET = "CASE WHEN coalesce(n_chars, 0) < 300 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END"


@query(f"""WITH b AS (SELECT doc_id, {_BUCKET} AS bucket, sha256('31:' || doc_id) AS o FROM documents), q(bucket, quota, pref) AS (VALUES {', '.join(f"('{k}', {v}, {_PREFER.index(k)})" for k, v in _QUOTAS.items())}),
 r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o, doc_id) AS n FROM b JOIN q USING (bucket)), c AS (SELECT doc_id, bucket, 'quota' AS how FROM r WHERE n <= quota),
 x AS (SELECT *, row_number() OVER (ORDER BY pref, o, doc_id) AS m FROM r WHERE n > quota) SELECT * FROM c UNION ALL SELECT doc_id, bucket, 'redistributed' FROM x WHERE m <= 400 - (SELECT count(*) FROM c)""")
def bucketed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 documents by quotas of length, what a bucket lacks dealt to the others in order of preference."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BUCKET).alias("bucket"))
    return bucketed_sample(d, "bucket", "doc_id", _SHARES, 400, 31, _PREFER)


_SET = lambda cond: f"(SELECT DISTINCT provenance.artifact AS a FROM split_stream WHERE provenance.artifact IS NOT NULL AND {cond})"


@query(f"SELECT CASE WHEN t.a IS NULL THEN 'only_held_out' WHEN h.a IS NULL THEN 'only_train' ELSE 'both' END AS side, count(*) AS artifacts, min(coalesce(t.a, h.a)) AS first, max(coalesce(t.a, h.a)) AS last FROM {_SET(chr(34) + 'split' + chr(34) + chr(61) + chr(39) + 'train' + chr(39))} t FULL JOIN {_SET('split IN (' + chr(39) + 'val' + chr(39) + ', ' + chr(39) + 'test' + chr(39) + ')')} h ON t.a = h.a GROUP BY 1")
def artifact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that train, the held-out splits, or both hold, with a first and a last one."""
    s = table(spark, sf_dir, "split_stream").where("provenance.artifact IS NOT NULL AND split IN ('train', 'val', 'test')")
    each = s.groupBy(F.col("provenance.artifact").alias("a")).agg(F.max((F.col("split") == "train").cast("int")).alias("t"), F.max((F.col("split") != "train").cast("int")).alias("h"))
    side = F.when(F.col("t") == 0, "only_held_out").when(F.col("h") == 0, "only_train").otherwise("both")
    return each.groupBy(side.alias("side")).agg(F.count("*").alias("artifacts"), F.min("a").alias("first"), F.max("a").alias("last"))


_NEAR = f"""WITH t AS (SELECT {S.compare_form('text')} AS t, min(doc_id) AS k, bool_or(split = 'train') AS train, bool_or(split <> 'train') AS held FROM split_stream WHERE split IN ('train', 'val', 'test') AND length({S.compare_form('text')}) > 0 GROUP BY 1),
 g AS (SELECT k, {S.shingles('t')} AS g FROM t), u AS (SELECT k, len(g) AS n, unnest(g) AS s FROM g), o AS (SELECT s FROM u GROUP BY s HAVING count(*) > 1), v AS (SELECT u.* FROM u JOIN o USING (s)),
 p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM v a JOIN v b USING (s) WHERE a.k < b.k GROUP BY 1, 2), j AS (SELECT a, b FROM p WHERE m / (na + nb - m)::DOUBLE >= 0.8)
 SELECT k AS first_doc, 'same' AS kind, NULL AS other FROM t WHERE train AND held UNION ALL SELECT a, 'near', b FROM j JOIN t x ON x.k = a JOIN t y ON y.k = b WHERE (x.train AND y.held) OR (x.held AND y.train)"""


@query(_NEAR)
def cross_split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that train and a held-out split both hold, and pairs of near texts across them; each text by its first record."""
    s = table(spark, sf_dir, "split_stream").where("split IN ('train', 'val', 'test')").select("doc_id", "text", (F.col("split") == "train").alias("train"))
    form = s.select("doc_id", "train", F.sha2(compare_form(F.col("text")), 256).alias("h")).where(F.length(compare_form(F.col("text"))) > 0)
    texts = form.groupBy("h").agg(F.min("doc_id").alias("k"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held")).drop("h")
    same = texts.where("train AND held").select(F.col("k").alias("first_doc"), F.lit("same").alias("kind"), F.lit(None).cast("string").alias("other"))
    a, b = (texts.select(F.col("k").alias(c), F.col("train").alias(f"t{c}"), F.col("held").alias(f"h{c}")) for c in "ab")
    near = jaccard_pairs(s, "doc_id", "text").select("a", "b").join(a, "a").join(b, "b").where("(ta AND hb) OR (ha AND tb)")
    return same.unionByName(near.select(F.col("a").alias("first_doc"), F.lit("near").alias("kind"), F.col("b").alias("other")))


_GATES = """SELECT 1 AS ord, 'license' AS gate, count(*) FILTER (license IS NULL) AS measured, 0 AS allowed FROM documents
 UNION ALL SELECT 2, 'provenance', count(*), 0 FROM (SELECT DISTINCT doc_id FROM split_stream WHERE provenance.artifact IS NULL OR provenance.origin_revision IS NULL)
 UNION ALL SELECT 3, 'size', (SELECT sum(coalesce(length(text), 0)) FROM documents)::BIGINT, 1000000
 UNION ALL SELECT 4, 'split_ids', count(*), 0 FROM (SELECT doc_id FROM split_stream WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 5, 'unmeasured_leakage', count(*), 0 FROM corpus_report WHERE measured.unique_overlapping_ngrams IS NULL OR measured.unique_overlapping_ngrams < 0"""
_PASSES = "CASE WHEN gate = 'size' THEN measured >= allowed ELSE measured <= allowed END"


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "split_stream").select("doc_id", "split", "provenance")
    row = lambda df, i, gate, n, allowed: df.agg(F.lit(i).alias("ord"), F.lit(gate).alias("gate"), n.cast("bigint").alias("measured"), F.lit(allowed).alias("allowed"))
    d = table(spark, sf_dir, "documents")
    gaps = s.where("provenance.artifact IS NULL OR provenance.origin_revision IS NULL").select("doc_id").distinct()
    twice = s.where("split IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    open_ = table(spark, sf_dir, "corpus_report").where("measured.unique_overlapping_ngrams IS NULL OR measured.unique_overlapping_ngrams < 0")
    rows = [row(d, 1, "license", F.count_if(F.col("license").isNull()), 0), row(gaps, 2, "provenance", F.count("*"), 0), row(d, 3, "size", F.coalesce(F.sum(F.length("text")), F.lit(0)), 1_000_000), row(twice, 4, "split_ids", F.count("*"), 0), row(open_, 5, "unmeasured_leakage", F.count("*"), 0)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("passes", F.when(F.col("gate") == "size", F.col("measured") >= F.col("allowed")).otherwise(F.col("measured") <= F.col("allowed")))


@query(f"SELECT ord, gate, measured, allowed, {_PASSES} AS passes FROM ({_GATES})")
def corpus_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of a corpus in order, with what was measured and whether they pass."""
    return _gates(spark, sf_dir)


@query(f"SELECT CASE WHEN bool_or(ord <= 2 AND NOT p) THEN 'BLOCKED' WHEN bool_or(NOT p) THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) FILTER (p) AS passed, string_agg(gate, ',' ORDER BY ord) FILTER (NOT p) AS failed FROM (SELECT *, {_PASSES} AS p FROM ({_GATES}))")
def corpus_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the gates: blocked by the first two, failed by the others."""
    g = _gates(spark, sf_dir)
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("passes"), F.struct("ord", "gate")))), lambda x: x["gate"]), ",")
    verdict = F.when(F.max((F.col("ord") <= 2) & ~F.col("passes")), "BLOCKED").when(F.max(~F.col("passes")), "FAIL").otherwise("PASS")
    return g.agg(verdict.alias("verdict"), F.count_if("passes").alias("passed"), failed.alias("failed"))


# The kind of mistake that a finding's code stands for.
CATEGORIES = {
    "CALCULATION_ERROR": "calculation_error", "ANSWER_MISMATCH": "factual_error", "FACT_FORMAT_ERROR": "factual_error", "LANGUAGE_SCRIPT_MISMATCH": "language_error",
    "FORMAT_MISMATCH": "misinterpretation", "MISSING_FIELD": "incomplete_reasoning", "TOO_SHORT": "incomplete_reasoning", "DEGENERATE_REPETITION": "incomplete_reasoning",
    "ANSWER_ECHOES_PROMPT": "misinterpretation", "PLACEHOLDER_TEXT": "hallucination", "MISSING_CITATION": "source_error", "CONTRADICTS_SOURCE": "source_error",
    "UNSUPPORTED_GENERALISATION": "overgeneralization", "CODE_TEST_FAILURE": "code_error", "MISSING_ASSUMPTION": "bad_assumption", "MISSING_CONTEXT": "missing_context",
    "LOGICAL_INVALIDITY": "logical_error",
}
_CATEGORY = "CASE code " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in CATEGORIES.items()) + " END"


def categories_of(codes: Column) -> Column:
    """The kinds of mistake of an array of codes, each once, in order; codes that are no mistakes have none."""
    kinds = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.element_at(kinds, c)), lambda c: c.isNotNull()))


@query(_DRAFTS + f"SELECT category, count(DISTINCT doc_id) AS drafts FROM (SELECT doc_id, {_CATEGORY} AS category FROM f) WHERE category IS NOT NULL GROUP BY 1")
def mistake_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts by the kinds of mistake that their findings stand for."""
    codes = F.transform(_findings(), lambda f: f["code"])
    return table(spark, sf_dir, "documents").select(F.explode(categories_of(codes)).alias("category")).groupBy("category").agg(F.count("*").alias("drafts"))


@query(_DRAFTS + f"""SELECT doc_id || ':' || k.kind AS record_id, k.kind, e.category FROM (SELECT DISTINCT doc_id, {_CATEGORY} AS category FROM f WHERE verdict = 'reject') e
 CROSS JOIN (VALUES ('error_diagnosis'), ('correction'), ('transfer')) k(kind) WHERE e.category IS NOT NULL""")
def mistake_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three records of each rejected draft and kind of mistake: what is wrong, how it is put right, where else it matters."""
    rejected = F.transform(F.filter(_findings(), lambda f: f["verdict"] == "reject"), lambda f: f["code"])
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(categories_of(rejected)).alias("category"))
    x = x.select("doc_id", "category", F.explode(F.array(*map(F.lit, ("error_diagnosis", "correction", "transfer")))).alias("kind"))
    return x.select(F.concat_ws(":", F.col("doc_id").cast("string"), "kind").alias("record_id"), "kind", "category")


_GRADE = f"""WITH t AS (SELECT doc_id, text, {S.tokens('text')} AS w FROM documents WHERE text IS NOT NULL), m AS (SELECT *, {S.ngrams('w', 4)} AS g, regexp_replace(text, '[ \\n]', '', 'g') AS b FROM t)
 SELECT doc_id, len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS control_chars, round(len(list_distinct(w)) / greatest(1, len(w))::DOUBLE, 4) AS unique_token_ratio,
 CASE WHEN len(g) > 0 THEN round(len(list_distinct(g)) / len(g)::DOUBLE, 4) END AS distinct_4gram_ratio, round(coalesce({_MOST("regexp_extract_all(b, '(?s).')")}, 0) / greatest(1, length(b))::DOUBLE, 4) AS top_char_share FROM m"""


@query(_GRADE)
def text_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanical grades of each text: control characters, distinct tokens and rows of four, share of the most frequent character."""
    body = F.regexp_replace("text", "[ \n]", "")
    top = let(body, lambda b: F.when(F.length(b) > 0, most_alike(F.split(b, "")) / F.length(b)).otherwise(0.0))
    x = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", tokens(F.col("text")).alias("w"))
    rows = let(ngrams(F.col("w"), 4), lambda g: F.round(F.try_divide(F.size(F.array_distinct(g)), F.size(g)), 4))
    control = F.regexp_count("text", F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return x.select("doc_id", control.alias("control_chars"), F.round(F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1)), 4).alias("unique_token_ratio"), rows.alias("distinct_4gram_ratio"), F.round(top, 4).alias("top_char_share"))


@query("SELECT event_type, round((max(s) - min(s)) / avg(s), 6) AS spread, max(s) - min(s) <= 0.02 * avg(s) AS reproducible FROM (SELECT event_type, event_id % 4 AS run, avg(value) AS s FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of a score over four runs, in parts of its mean, and whether it stays within two in a hundred."""
    runs = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type", (F.col("event_id") % 4).alias("run")).agg(F.avg("value").alias("s"))
    return runs.groupBy("event_type").agg(F.round((F.max("s") - F.min("s")) / F.avg("s"), 6).alias("spread"), (F.max("s") - F.min("s") <= 0.02 * F.avg("s")).alias("reproducible"))


_TRACE = "SELECT event_type, event_id // 400 AS step, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events WHERE value IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT event_type, count(*) AS steps, round(max(abs(a - b)), 6) AS max_abs, round(avg(abs(a - b)), 6) AS mean_abs FROM ({_TRACE}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def trace_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two runs' traces lie apart, step by step."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    side = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    x = e.groupBy("event_type", F.floor(F.col("event_id") / 400).alias("step")).agg(side(0).alias("a"), side(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return x.groupBy("event_type").agg(F.count("*").alias("steps"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("max_abs"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean_abs"))


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more in small letters, common ones left out."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*COMMON)))


COMMON = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "not", "but", "you", "your", "all", "can", "will", "its")
_CONTENT = f"list_distinct(list_filter(regexp_extract_all(lower(prompt), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(map(S.q, COMMON))})))"
_IDEAS = f"SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY case_id) AS i, {_CONTENT} AS w FROM dev_smoke_suite WHERE prompt IS NOT NULL"
_ALIKE = "len(list_intersect(x.w, q.w)) >= 0.6 * len(list_distinct(list_concat(x.w, q.w))) AND len(x.w) > 0 AND len(q.w) > 0"


@query(f"""WITH RECURSIVE x AS MATERIALIZED ({_IDEAS}), r(axis, i, kept) AS (SELECT axis, 1, [1] FROM x WHERE i = 1
 UNION ALL SELECT q.axis, q.i, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.axis = q.axis AND list_contains(r.kept, x.i) AND {_ALIKE}) THEN r.kept ELSE list_append(r.kept, q.i) END FROM r JOIN x q ON q.axis = r.axis AND q.i = r.i + 1)
 SELECT axis, max(i) AS ideas, max(len(kept)) AS distinct_ideas FROM r GROUP BY axis""")
def distinct_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of each axis that are like no earlier one that was kept (three fifths of their content words in common): a fold over the
    fixed, small suite, in order."""
    x = table(spark, sf_dir, "dev_smoke_suite").where("prompt IS NOT NULL").select("axis", F.struct("case_id", content_words(F.col("prompt")).alias("w")).alias("c"))
    each = x.groupBy("axis").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["w"]).alias("ideas"))

    def add(kept: Column, w: Column) -> Column:
        like = F.exists(kept, lambda k: (F.size(k) > 0) & (F.size(w) > 0) & (F.size(F.array_intersect(k, w)) >= 0.6 * F.size(F.array_union(k, w))))
        return F.when(like, kept).otherwise(F.concat(kept, F.array(w)))

    kept = F.aggregate("ideas", F.array().cast("array<array<string>>"), add)
    return each.select("axis", F.size("ideas").alias("ideas"), F.size(kept).alias("distinct_ideas"))


@query("SELECT event_type, coalesce(lead(event_type) OVER (ORDER BY n DESC, event_type), '(last)') AS next, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of event in order of their number, each with the one after it."""
    from pyspark.sql import Window

    x = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return x.select("event_type", F.coalesce(F.lead("event_type").over(Window.orderBy(F.col("n").desc(), "event_type")), F.lit("(last)")).alias("next"), "n")


@query("SELECT source, documents FROM (SELECT source, count(*) AS documents FROM documents GROUP BY 1) ORDER BY documents DESC, source NULLS LAST LIMIT 10")
def largest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sources of most documents (a top-ten report)."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents")).orderBy(F.col("documents").desc(), F.col("source").asc_nulls_last()).limit(10)


@query("SELECT sha256(string_agg(h, chr(10) ORDER BY source)) AS tree, count(*) AS leaves FROM (SELECT coalesce(source, '') AS source, sha256(coalesce(source, '') || ':' || count(*) || ':' || sum(coalesce(length(text), 0)) || ':' || min(doc_id) || ':' || max(doc_id)) AS h FROM documents GROUP BY 1)")
def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over a leaf a source (its documents, characters and ids), so that a change shows where it is."""
    each = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    leaf = each.select("source", F.sha2(F.concat_ws(":", "source", *[F.col(c).cast("string") for c in ("n", "c", "lo", "hi")]), 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "h"))), lambda x: x["h"]), "\n")
    return leaf.agg(F.sha2(joined, 256).alias("tree"), F.count("*").alias("leaves"))


_VOTES = "SELECT user_id AS request, event_type AS answer, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2"


@query(f"""SELECT request, answer, n AS support, drafts, round(n / drafts::DOUBLE, 6) AS share, CASE WHEN drafts < 2 THEN 'unverified' WHEN n = drafts THEN 'agreed' WHEN n > drafts / 2.0 THEN 'majority' ELSE 'disputed' END AS status
 FROM (SELECT *, sum(n) OVER (PARTITION BY request) AS drafts, row_number() OVER (PARTITION BY request ORDER BY n DESC, answer) AS r FROM ({_VOTES})) WHERE r = 1""")
def consensus_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of most drafts of each request (the least on a tie), its support, and what that makes of it."""
    votes = table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("request"), F.col("event_type").alias("answer")).agg(F.count("*").alias("n"))
    x = votes.groupBy("request").agg(F.min_by("answer", F.struct(-F.col("n"), F.col("answer"))).alias("answer"), F.max("n").alias("support"), F.sum("n").alias("drafts"))
    status = F.when(F.col("drafts") < 2, "unverified").when(F.col("support") == F.col("drafts"), "agreed").when(F.col("support") > F.col("drafts") / 2, "majority").otherwise("disputed")
    return x.select("request", "answer", "support", "drafts", F.round(F.col("support") / F.col("drafts"), 6).alias("share"), status.alias("status"))


_ROUTES = "CASE WHEN license IS NULL OR provenance.artifact IS NULL THEN 'rejected' WHEN NOT coalesce(license_verified, false) OR synthetic THEN 'quarantine' ELSE 'trainable' END"


@query(f"SELECT doc_id, {_ROUTES} AS route FROM {_ONE} WHERE {_ROUTES} <> 'trainable'")
def routed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records not to be trained on, with where they go instead, written to a folder a route and read from these alone."""
    out = f"{folder(spark)}/routes"
    write_routes(_deliveries(spark, sf_dir).select("doc_id", F.expr(_ROUTES).alias("route")), "route", out)
    return spark.read.parquet(out).where("route <> 'trainable'").select("doc_id", "route")


@query("SELECT split_part(doc_id, ':', 1) AS source, count(DISTINCT doc_id) FILTER (split = 'train') AS train, count(DISTINCT doc_id) FILTER (split = 'val') AS val, count(DISTINCT doc_id) FILTER (split = 'test') AS test FROM split_stream GROUP BY 1")
def source_split_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each source in each split, zeros filled in (pivot)."""
    x = table(spark, sf_dir, "split_stream").groupBy("doc_id").agg(F.min("split").alias("split"))
    x = x.groupBy(F.split("doc_id", ":")[0].alias("source")).pivot("split", ["train", "val", "test"]).count()
    return x.na.fill(0, ["train", "val", "test"])


@query(f"SELECT axis, code, count(*) AS cases FROM (SELECT axis, unnest(list_filter([{', '.join(f'CASE WHEN {v} THEN {S.q(k)} END' for k, v in _CASES.items())}], lambda x: x IS NOT NULL)) AS code FROM dev_smoke_suite) GROUP BY 1, 2")
def suite_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of each axis that break a rule, by rule."""
    axis = table(spark, sf_dir, "dev_smoke_suite").select("case_id", "axis")
    return suite_case_issues(spark, sf_dir).join(axis, "case_id").groupBy("axis", "code").agg(F.count("*").alias("cases"))


@query(f"SELECT doc_id, sha256(coalesce({S.collapse('text')}, '') || chr(31) || coalesce(language, '') || chr(31) || coalesce(source_id, '') || chr(31) || coalesce(license, '')) AS content_hash FROM {_ONE}")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of the fields that make a record's content, white space collapsed."""
    fields = [F.coalesce(c, F.lit("")) for c in (collapse(F.col("text")), F.col("language"), F.col("source_id"), F.col("license"))]
    return _deliveries(spark, sf_dir).select("doc_id", F.sha2(F.concat_ws("\x1f", *fields), 256).alias("content_hash"))


@query("SELECT id, coalesce(status, 'needs_review') AS status, coalesce(license, '(none)') AS license, len(coalesce(languages, [])) AS languages FROM source_manifest")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest written as YAML and read again, defaults filled in; an id that occurs twice would end the query."""
    out, m = f"{folder(spark)}/manifest", table(spark, sf_dir, "source_manifest").select("id", "status", "license", "languages")
    m.agg(F.to_json(F.struct(F.collect_list(F.struct(*m.columns)).alias("sources"))).alias("value")).coalesce(1).write.text(out)
    schema = m.schema
    x = read_yaml_list(spark, out, "sources", schema, "id", {"status": "needs_review", "license": "(none)"})
    return x.select("id", "status", "license", F.size(F.coalesce("languages", F.array().cast("array<string>"))).alias("languages"))
