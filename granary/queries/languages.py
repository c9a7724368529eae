"""Queries on scripts and languages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.langid import ALLOWED, ANY, LABELS, MARKERS, CLEANER_ROMANISED, EXPECTED, LATIN_BLOCK, ROMANISED, SCRIPTS, WORD, code_switches, guessed, identified, identify, marker_scores as marked, reconciled, romanised_score, script_agrees, script_counts, script_profile, script_share
from granary.operators.cleaning import clean_text
from granary.queries import query, table
from granary.queries import sql as S
from granary.queries.cleaning import _CLEAN

_COUNT = {s: f"coalesce(len(regexp_extract_all(text, {S.q(p)})), 0)" for s, p in SCRIPTS.items()}
_WORDS = f"list_filter(regexp_extract_all(text, {S.q(WORD)}), lambda w: length(w) > 1)"
_LIST = lambda ws: "[" + ", ".join(S.q(w) for w in ws) + "]"


def _score(words: str, lexicon: list[str]) -> str:
    return f"coalesce(len(list_filter({words}, lambda w: list_contains({_LIST(lexicon)}, w))) / greatest(len({words}), 1)::DOUBLE, 0.0)"


_HI, _MR, _SA = (_score(_WORDS, m) for m in MARKERS.values())
_ROM = _score("regexp_extract_all(lower(text), '[a-z'']+')", ROMANISED)
_MEASURED = (
    "WITH c AS (SELECT doc_id, text, lang, " + ", ".join(f"{e} AS n_{s}" for s, e in _COUNT.items()) + f", {_HI} AS hi, {_MR} AS mr, {_SA} AS sa, {_ROM} AS rom FROM documents), "
    "m AS (SELECT *, " + ", ".join(f"n_{s} / greatest(" + " + ".join(f"n_{x}" for x in SCRIPTS) + f", 1)::DOUBLE AS s_{s}" for s in SCRIPTS) + " FROM c) "
)
_IDENTIFY = (
    "CASE WHEN s_devanagari >= 0.40 AND s_latin >= 0.20 THEN 'hinc-deva' "
    + " ".join(f"WHEN s_{s} >= 0.5 THEN '{x}'" for s, x in LABELS.items() if s not in ("devanagari", "latin"))
    + " WHEN s_devanagari >= 0.5 THEN CASE WHEN hi >= 0.05 AND hi >= mr AND hi >= sa AND hi >= 2 * greatest(mr, sa) THEN 'hi' WHEN mr >= 0.05 AND mr > hi AND mr >= sa AND mr >= 2 * greatest(hi, sa) THEN 'mr' WHEN sa >= 0.05 AND sa > hi AND sa > mr AND sa >= 2 * greatest(hi, mr) THEN 'sa' WHEN lang IN ('hi', 'mr', 'sa') THEN lang ELSE 'hi' END"
    + " WHEN s_latin >= 0.5 AND rom >= 0.18 THEN 'hinc-latn' WHEN s_latin >= 0.5 THEN 'en' ELSE 'unknown' END"
)
_AGREES = "CASE " + " ".join(f"WHEN lang = '{k}' THEN greatest(" + ", ".join(f"s_{s}" for s in ss) + ") >= 0.5" for k, ss in ALLOWED.items()) + " ELSE true END"


@query(_MEASURED + "SELECT doc_id, " + ", ".join(f"n_{s}" for s in SCRIPTS) + " FROM m")
def script_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each script per document."""
    x = table(spark, sf_dir, "documents").select("doc_id", script_counts(F.col("text")).alias("c"))
    return x.select("doc_id", *[F.col("c")[i].cast("bigint").alias(f"n_{s}") for i, s in enumerate(SCRIPTS)])


@query(_MEASURED + "SELECT doc_id, round(hi, 6) AS hi, round(mr, 6) AS mr, round(sa, 6) AS sa, round(rom, 6) AS romanised FROM m")
def marker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the marker lexicons per document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", marked(t).alias("m"), F.round(romanised_score(t), 6).alias("romanised")).select("doc_id", *[F.round(F.col("m")[i], 6).alias(x) for i, x in enumerate(MARKERS)], "romanised")


@query(_MEASURED + f"SELECT doc_id, lang, {_IDENTIFY} AS measured, round(s_devanagari, 6) AS devanagari, round(s_latin, 6) AS latin FROM m WHERE text IS NOT NULL")
def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by rules of script and lexicon."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", identify(t, F.col("lang")).alias("measured"), F.round(script_share(t, "devanagari"), 6).alias("devanagari"), F.round(script_share(t, "latin"), 6).alias("latin"))


@query(_MEASURED + f"SELECT lang, {_IDENTIFY} AS measured, count(*) AS documents FROM m WHERE text IS NOT NULL GROUP BY 1, 2")
def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by label and measured language."""
    x = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return x.groupBy("lang", identify(F.col("text"), F.col("lang")).alias("measured")).agg(F.count("*").alias("documents"))


@query(_MEASURED + f"SELECT doc_id, lang FROM m WHERE text IS NOT NULL AND NOT ({_AGREES})")
def script_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose script the label doesn't allow."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").where(~script_agrees(F.col("text"), F.col("lang"))).select("doc_id", "lang")


@query(f"SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(text, {S.q(WORD)}), lambda w: regexp_matches(w, '[A-Za-z]'))) >= 2 AND len(list_filter(regexp_extract_all(text, {S.q(WORD)}), lambda w: regexp_matches(w, '[\\x{{900}}-\\x{{97f}}]'))) >= 2")
def code_switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with words of both Latin and Devanagari letters."""
    return table(spark, sf_dir, "documents").where(code_switches(F.col("text"))).select("doc_id")


@query(_MEASURED + "SELECT count(*) AS documents, count(*) FILTER (measured = 'unknown') AS unknown, count(*) FILTER (NOT agrees) AS mismatched, count(*) FILTER (measured = 'unknown') <= 0.02 * count(*) AND count(*) FILTER (NOT agrees) <= 0.02 * count(*) AS passes FROM (SELECT " + _IDENTIFY + " AS measured, " + _AGREES + " AS agrees FROM m WHERE text IS NOT NULL)")
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether unknown languages and mismatched scripts stay within two in a hundred."""
    x = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(identify(F.col("text"), F.col("lang")).alias("m"), script_agrees(F.col("text"), F.col("lang")).alias("a"))
    x = x.agg(F.count("*").alias("documents"), F.count_if(F.col("m") == "unknown").alias("unknown"), F.count_if(~F.col("a")).alias("mismatched"))
    return x.withColumn("passes", (F.col("unknown") <= 0.02 * F.col("documents")) & (F.col("mismatched") <= 0.02 * F.col("documents")))


_METHOD = (
    "CASE WHEN s_devanagari >= 0.40 AND s_latin >= 0.20 THEN {m: 'script-mixed(devanagari+latin)', c: least(0.75, 0.35 + s_devanagari * s_latin * 2)} "
    + " ".join(f"WHEN s_{s} >= 0.5 THEN {{m: 'script({s})', c: least(0.9, 0.45 + s_{s})}}" for s in LABELS if s not in ("devanagari", "latin"))
    + " WHEN s_devanagari >= 0.5 THEN CASE "
    + " ".join(f"WHEN {a} >= 0.05 AND {a} >= 2 * greatest({b}, {c}) THEN {{m: 'script(devanagari)+marker-lexicon({a})', c: least(0.85, 0.4 + {a} * 4)}}" for a, b, c in (("hi", "mr", "sa"), ("mr", "hi", "sa"), ("sa", "hi", "mr")))
    + " WHEN lang IN ('hi', 'mr', 'sa') THEN {m: 'script(devanagari)+declared-prior(' || lang || ')', c: 0.4} ELSE {m: 'script(devanagari)+default', c: 0.3} END"
    + " WHEN s_latin >= 0.5 AND rom >= 0.18 THEN {m: 'latin+romanized-hindi-lexicon', c: least(0.6, 0.25 + rom)} WHEN s_latin >= 0.5 THEN {m: 'script(latin)', c: least(0.9, 0.45 + s_latin)} ELSE {m: 'script', c: 0.0} END"
)


@query(_MEASURED + f"SELECT doc_id, language, method.m AS method, round(method.c::DOUBLE, 6) AS confidence FROM (SELECT doc_id, {_IDENTIFY} AS language, {_METHOD} AS method FROM m)")
def language_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, the rule that gave it, and its confidence."""
    x = table(spark, sf_dir, "documents").select("doc_id", identified(F.col("text"), F.col("lang")).alias("v"))
    return x.select("doc_id", "v.language", "v.method", F.round("v.confidence", 6).alias("confidence"))


_KNOWN = "lang IN (" + ", ".join(S.q(x) for x in (*ALLOWED, *ANY)) + ") AND lang <> 'unknown' AND lang <> language"


@query(_MEASURED + f"SELECT doc_id, CASE WHEN keep THEN lang ELSE language END AS language, CASE WHEN keep THEN method.m || '+declared-prior' ELSE method.m END AS method, round(CASE WHEN keep THEN least(method.c, 0.5) ELSE method.c END::DOUBLE, 6) AS confidence FROM (SELECT *, coalesce({_KNOWN} AND ({_AGREES}), false) AS keep FROM (SELECT *, {_IDENTIFY} AS language, {_METHOD} AS method FROM m))")
def reconciled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured labels, but declared ones that the script allows kept."""
    x = table(spark, sf_dir, "documents").select("doc_id", reconciled(F.col("text"), F.col("lang")).alias("v"))
    return x.select("doc_id", "v.language", "v.method", F.round("v.confidence", 6).alias("confidence"))


_CLEANER = {"latin": LATIN_BLOCK, **{s: p for s, p in SCRIPTS.items() if s not in ("latin", "arabic")}}
_INDIC = [s for s in _CLEANER if s not in ("latin", "devanagari")]
_CLEANER_ROM = _score("regexp_extract_all(lower(text), '[a-z'']+')", CLEANER_ROMANISED)
_GUESS = (
    "WITH c AS (SELECT doc_id, text, coalesce(length(text), 0) AS len, " + ", ".join(f"coalesce(len(regexp_extract_all(text, {S.q(p)})), 0) AS n_{s}" for s, p in _CLEANER.items()) + f", {_CLEANER_ROM} AS rom FROM documents), "
    "m AS (SELECT *, len - " + " - ".join(f"n_{s}" for s in _CLEANER) + " AS n_other, greatest(" + ", ".join(f"n_{s}" for s in _INDIC) + ") AS top, n_devanagari / greatest(len, 1)::DOUBLE AS dev, n_latin / greatest(len, 1)::DOUBLE AS lat, (greatest(len, 1) - n_devanagari - n_latin) / greatest(len, 1)::DOUBLE AS other FROM c) "
)
_NAMED = "CASE " + " ".join(f"WHEN n_{s} = top THEN 'script:{s}'" for s in _INDIC) + " END"
_RULES = (
    "CASE WHEN dev >= 0.4 AND lat >= 0.20 THEN {l: 'hinc-deva', m: 'script-heuristic-mixed', c: least(0.7, 0.35 + dev * lat * 2)} WHEN dev >= 0.5 THEN {l: 'hi', m: 'script-heuristic', c: least(0.95, 0.55 + dev)} "
    f"WHEN other >= 0.5 AND len > 0 THEN CASE WHEN top = 0 THEN {{l: 'unknown', m: 'script-heuristic', c: 0.0}} ELSE {{l: {_NAMED}, m: 'script-heuristic', c: 0.4}} END WHEN lat >= 0.5 AND rom >= 0.18 THEN {{l: 'hinc-latn', m: 'latin+romanized-hindi-lexicon', c: least(0.6, 0.25 + rom)}} "
    "WHEN lat >= 0.5 THEN {l: 'en', m: 'script-heuristic', c: least(0.9, 0.45 + lat - rom)} ELSE {l: 'unknown', m: 'script-heuristic', c: 0.0} END"
)


@query(_GUESS + f"SELECT doc_id, g.l AS language, g.m AS method, round(g.c::DOUBLE, 6) AS confidence FROM (SELECT doc_id, {_RULES} AS g FROM m)")
def cleaner_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaner's guess at each document's language from its scripts."""
    x = table(spark, sf_dir, "documents").select("doc_id", guessed(F.col("text")).alias("v"))
    return x.select("doc_id", "v.language", "v.method", F.round("v.confidence", 6).alias("confidence"))


@query(_GUESS + "SELECT doc_id, " + ", ".join(f"n_{s}" for s in _CLEANER) + ", n_other FROM m")
def cleaner_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each script as the cleaner counts them, signs between Latin letters and all others included."""
    x = table(spark, sf_dir, "documents").select("doc_id", script_counts(F.col("text"), _CLEANER).alias("c"))
    return x.select("doc_id", *[F.col("c")[i].cast("bigint").alias(f"n_{s}") for i, s in enumerate([*_CLEANER, "other"])])


_PROFILE = "SELECT doc_id, lang, len(regexp_extract_all(coalesce(text, ''), '[\\x{900}-\\x{97f}]')) AS d, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS l FROM documents"


@query("SELECT doc_id, CASE WHEN d + l = 0 THEN 0.0 ELSE round(d / (d + l)::DOUBLE, 3) END AS devanagari, CASE WHEN d + l = 0 THEN 0.0 ELSE round(l / (d + l)::DOUBLE, 3) END AS latin, CASE lang " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in EXPECTED.items()) + f" END AS expected FROM ({_PROFILE})")
def script_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of Devanagari and Latin letters, and the script that the label lets expect."""
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv]), F.col("lang"))
    x = table(spark, sf_dir, "documents").select("doc_id", script_profile(F.coalesce("text", F.lit(""))).alias("p"), expected.alias("expected"))
    return x.select("doc_id", "p.devanagari", "p.latin", "expected")


_CLEANED = _MEASURED.replace("FROM documents", f"FROM (SELECT doc_id, lang, {_CLEAN} AS text FROM documents)", 1)


@query(_CLEANED + f"SELECT lang, {_IDENTIFY} AS measured, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM m WHERE length(text) > 0 GROUP BY 1, 2")
def clean_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters after cleaning, by label and measured language."""
    x = table(spark, sf_dir, "documents").select("lang", clean_text(F.col("text")).alias("text")).where("length(text) > 0")
    x = x.select("lang", identify(F.col("text"), F.col("lang")).alias("measured"), F.length("text").alias("c"))
    return x.groupBy("lang", "measured").agg(F.count("*").alias("documents"), F.sum("c").alias("chars"))
