"""Queries on cleaning, blocks and quality."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import collapse
from granary.operators.cleaning import BOILERPLATE, DEVANAGARI, LIMITS, LINK, MARKUP, MOJIBAKE, STRUCTURE, clean_text, cleaned
from granary.operators.blocks import HTML, blocks, html_to_text, json_to_text, packed_blocks, packed_by_language
from granary.queries import query, table
from granary.queries import sql as S

_CLEAN = "nfc_normalize(text)"
for _p, _to in [(r"[\x{200b}-\x{200f}\x{2060}\x{feff}]", ""), (r"\r\n|\r", "\n")]:
    _CLEAN = f"regexp_replace({_CLEAN}, {S.q(_p)}, {S.q(_to)}, 'g')"
_READ = "try(decode(unhex(array_to_string(list_transform(string_split(x, ''), lambda c: printf('%02x', unicode(c))), ''))))"
_DEVA = lambda c: f"len(regexp_extract_all({c}, {S.q(DEVANAGARI)}))"
_MAYBE = f"regexp_matches(x, {S.q(MOJIBAKE)}) AND NOT regexp_matches(x, {S.q(r'[^\x{0}-\x{ff}]')})"
_CLEAN = f"list_transform([{_CLEAN}], lambda x: CASE WHEN {_MAYBE} AND {_DEVA(_READ)} > {_DEVA('x')} THEN {_READ} ELSE x END)[1]"
for _p, _to in [*MARKUP, (r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]", ""), ("\t", " "), (r"[ \x{a0}]{2,}", " "), (r"\n{3,}", "\n\n"), (r"(?m)^[ \x{a0}]+|[ \x{a0}]+$", ""), (r"^\n+|\n+$", "")]:
    _CLEAN = f"regexp_replace({_CLEAN}, {S.q(_p)}, {S.q(_to.replace('$1', chr(92) + '1'))}, 'g')"


def _reasons(c: str) -> str:
    ws = r"[\t-\r \x{85}\p{Z}]"
    t = f"coalesce({c}, '')"
    lines = f"list_filter(string_split({t}, chr(10)), lambda x: length(regexp_replace(x, {S.q(ws)}, '', 'g')) > 0)"
    count = lambda p: f"len(regexp_extract_all({t}, {S.q(p)}))"
    p = LIMITS
    tests = [
        (f"length({t}) < {p['min_chars']}", "too_short"),
        (f"length({t}) > {p['max_chars']}", "too_long"),
        (f"length({t}) > 0 AND {count(r'[\p{L}\p{N}]')} / length({t})::DOUBLE < {p['min_alnum']}", "low_alnum_ratio"),
        (f"len({lines}) > 2 AND list_max(list_transform(list_distinct({lines}), lambda x: len(list_filter({lines}, lambda y: y = x)))) / len({lines})::DOUBLE > {p['max_line']}", "line_repetition"),
        (f"{count(LINK)} / greatest({count(r'[^\t-\r \x{85}\p{Z}]+')}, 1)::DOUBLE > {p['max_url']}", "link_farm"),
        (f"length({t}) > 0 AND {count(r'\p{S}')} / length({t})::DOUBLE > {p['max_symbol']}", "symbol_soup"),
        (f"NOT regexp_matches({t}, {S.q(STRUCTURE)})", "no_punctuation_structure"),
        (" OR ".join(f"contains(lower({t}), {S.q(b)})" for b in BOILERPLATE), "boilerplate"),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{n}' END" for x, n in tests) + "], lambda x: x IS NOT NULL)"


_DOCS = f"WITH c AS (SELECT doc_id, lang, source, text, {_CLEAN} AS clean FROM documents), r AS (SELECT *, {_reasons('clean')} AS reasons FROM c) "


@query(f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cleaned text."""
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, md5(clean) AS clean_md5 FROM (SELECT doc_id, {_CLEAN} AS clean FROM (SELECT DISTINCT doc_id, text FROM split_stream))")
def clean_stream_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned text of every record of split_stream, as a digest; a record delivered twice counts once."""
    x = table(spark, sf_dir, "split_stream").select("doc_id", F.md5(F.encode(clean_text(F.col("text")), "UTF-8")).alias("clean_md5"))
    return x.distinct()


@query(_DOCS + "SELECT doc_id, array_to_string(reasons, ',') AS reasons, coalesce(length(clean), 0) AS chars, len(reasons) = 0 AS kept FROM r")
def clean_quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons to reject each document, after cleaning."""
    x = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.array_join("reasons", ",").alias("reasons"), F.coalesce(F.length("clean"), F.lit(0)).alias("chars"), (F.size("reasons") == 0).alias("kept"))


@query(_DOCS + "SELECT lang, count(*) AS seen, count(*) FILTER (len(reasons) = 0) AS kept, count(*) FILTER (len(reasons) > 0) AS rejected, sum(coalesce(length(text), 0))::BIGINT AS chars_before, sum(CASE WHEN len(reasons) = 0 THEN length(clean) ELSE 0 END)::BIGINT AS chars_after FROM r GROUP BY lang")
def clean_keep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters before and after cleaning, per label."""
    x = cleaned(table(spark, sf_dir, "documents").select("lang", "text")).withColumn("ok", F.size("reasons") == 0)
    return x.groupBy("lang").agg(
        F.count("*").alias("seen"), F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("rejected"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars_before"), F.sum(F.when(F.col("ok"), F.length("clean")).otherwise(0)).alias("chars_after"),
    )


@query(_DOCS + "SELECT reasons[1] AS reason, count(*) AS documents FROM r WHERE len(reasons) > 0 GROUP BY 1")
def clean_first_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected documents by their first reason."""
    x = cleaned(table(spark, sf_dir, "documents").select("text")).where(F.size("reasons") > 0)
    return x.groupBy(F.col("reasons")[0].alias("reason")).agg(F.count("*").alias("documents"))


@query(_DOCS + "SELECT doc_id, source, reasons[1] AS reason, array_to_string(reasons, ',') AS reasons, coalesce(length(clean), 0) AS chars, 'clean' AS stage FROM r WHERE len(reasons) > 0")
def clean_reject_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a rejected document, without its text."""
    x = cleaned(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).where(F.size("reasons") > 0)
    return x.select("doc_id", "source", F.col("reasons")[0].alias("reason"), F.array_join("reasons", ",").alias("reasons"), F.coalesce(F.length("clean"), F.lit(0)).alias("chars"), F.lit("clean").alias("stage"))


@query(f"SELECT DISTINCT doc_id, md5({S.collapse('text')}) AS form FROM split_stream")
def compare_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed, case kept."""
    return table(spark, sf_dir, "split_stream").select("doc_id", F.md5(F.encode(collapse(F.col("text")), "UTF-8")).alias("form")).distinct()


_BLOCKS = r"""WITH b AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*\n\s*') AS p FROM documents WHERE text IS NOT NULL),
 u AS (SELECT doc_id, unnest(p) AS block, generate_subscripts(p, 1) AS i FROM b),
 t AS (SELECT doc_id, i, regexp_replace(regexp_replace(block, '(?m)[ \t]+$', '', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS block FROM u)
 """


@query(_BLOCKS + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_no, length(block) AS chars, md5(block) AS digest FROM t WHERE length(block) > 0")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each document, parted by blank lines."""
    x = blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return x.select("doc_id", F.col("block_no").cast("bigint").alias("block_no"), F.length("block").alias("chars"), F.md5(F.encode("block", "UTF-8")).alias("digest"))


def _packed(pieces: str, most: int, least: int) -> str:
    """Recursion over the pieces (k, i from 1, p) of each k: chunks ch(k, chunk_no, chunk)."""
    fits = f"r.n + 2 + length(q.p) <= {most}"
    return f"""WITH RECURSIVE pieces AS MATERIALIZED ({pieces}),
 r(k, i, c, n) AS (SELECT k, i, 0, length(p) FROM pieces WHERE i = 1 UNION ALL
  SELECT q.k, q.i, CASE WHEN {fits} THEN r.c ELSE r.c + 1 END, CASE WHEN {fits} THEN r.n + 2 ELSE 0 END + length(q.p) FROM r JOIN pieces q ON q.k = r.k AND q.i = r.i + 1),
 j AS (SELECT r.k, r.c, string_agg(p, chr(10) || chr(10) ORDER BY r.i) AS chunk FROM r JOIN pieces q ON q.k = r.k AND q.i = r.i GROUP BY 1, 2),
 ch AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY c) - 1)::INT AS chunk_no, chunk FROM j WHERE length(chunk) >= {least}) """


_STRIP = r"regexp_replace(regexp_replace(b, '(?m)[ \t]+$', '', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"


def _pieces(rows: str, most: int) -> str:
    """The pieces of rows (k, o, text): each row's blocks in order of o, cut at ``most`` characters."""
    return rf"""SELECT k, row_number() OVER (PARTITION BY k ORDER BY o, i, f) AS i, substr(b, f + 1, {most}) AS p FROM
 (SELECT k, o, i, b, unnest(range(0, length(b), {most})) AS f FROM (SELECT k, o, i, {_STRIP} AS b FROM
  (SELECT k, o, unnest(p) AS b, generate_subscripts(p, 1) AS i FROM (SELECT k, o, regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*\n\s*') AS p FROM ({rows}) WHERE text IS NOT NULL)))
  WHERE length(b) > 0)"""


@query(_packed(_pieces("SELECT doc_id AS k, source, 0 AS o, text FROM documents", 1200), 1200, 40) + "SELECT k AS doc_id, chunk_no, d.source || ':' || k || ':' || lpad(chunk_no::VARCHAR, 6, '0') AS chunk_id, length(chunk) AS chars, md5(chunk) AS digest FROM ch JOIN documents d ON d.doc_id = k")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks packed into chunks of at most 1,200 characters, named by source, document and number."""
    d = table(spark, sf_dir, "documents")
    x = packed_blocks(d.withColumn("k", F.struct("source", "doc_id")), "k", "text", 1200, 40)
    name = F.when(F.col("k.source").isNotNull(), F.format_string("%s:%s:%06d", F.col("k.source"), F.col("k.doc_id").cast("string"), F.col("chunk_no")))
    return x.select("k.doc_id", "chunk_no", name.alias("chunk_id"), F.length("chunk").alias("chars"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


_RUNS = """SELECT DISTINCT provenance.artifact AS a, doc_id, language, text FROM split_stream WHERE provenance.artifact IS NOT NULL"""
_RUNS = f"""SELECT a, sum(s) OVER (PARTITION BY a ORDER BY doc_id) AS run_no, doc_id AS o, language, text FROM (
 SELECT *, CASE WHEN row_number() OVER w > 1 AND language IS DISTINCT FROM lag(language) OVER w THEN 1 ELSE 0 END AS s FROM ({_RUNS}) WINDOW w AS (PARTITION BY a ORDER BY doc_id))"""


@query(_packed(_pieces(f"SELECT a || '|' || run_no AS k, o, text FROM ({_RUNS})", 6000), 6000, 200) + f", l AS (SELECT DISTINCT a, run_no, language FROM ({_RUNS})) SELECT a AS artifact, run_no::BIGINT AS run_no, language, chunk_no, length(chunk) AS chars, md5(chunk) AS digest FROM ch JOIN l ON ch.k = a || '|' || run_no")
def packed_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each artifact packed in order into chunks of one language, of 200 to 6,000 characters."""
    s = table(spark, sf_dir, "split_stream").select(F.col("provenance.artifact").alias("artifact"), "doc_id", "language", "text").where("artifact IS NOT NULL").groupBy("artifact", "doc_id").agg(F.min("language").alias("language"), F.min("text").alias("text"))
    x = packed_by_language(s, "artifact", "doc_id", "language", "text", 6000, 200)
    return x.select("artifact", "run_no", "language", "chunk_no", F.length("chunk").alias("chars"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


@query("SELECT doc_id, md5(concat_ws(chr(10), id, text, split, source_id, provenance.url, provenance.format)) AS digest FROM (SELECT DISTINCT doc_id, id, text, split, source_id, provenance FROM split_stream)")
def nested_json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of each record written as nested JSON, in order of the length of field names, as a digest."""
    s = table(spark, sf_dir, "split_stream")
    nested = F.to_json(F.struct("source_id", "text", F.struct(F.col("provenance.url").alias("url"), F.struct(F.col("provenance.format").alias("format")).alias("details")).alias("provenance"), "split", "id", F.array(F.lit(1), F.lit(2)).alias("chars")))
    return s.select("doc_id", F.md5(F.encode(json_to_text(nested), "UTF-8")).alias("digest")).distinct()


_PLAIN = "text"
for _p, _to in HTML:
    _PLAIN = f"regexp_replace({_PLAIN}, {S.q(_p)}, {S.q(_to)}, 'g')"
for _e, _to in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&amp;", "'&'")):
    _PLAIN = f"replace({_PLAIN}, {S.q(_e)}, {_to})"
_PLAIN = f"regexp_replace({_PLAIN}, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g')"


@query(f"SELECT doc_id, md5({_PLAIN}) AS plain FROM (SELECT doc_id, min(text) AS text FROM split_stream GROUP BY doc_id)")
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every record without its tags and character references, as a digest; a record delivered twice counts once."""
    x = table(spark, sf_dir, "split_stream").select("doc_id", F.md5(F.encode(html_to_text(F.col("text")), "UTF-8")).alias("plain"))
    return x.groupBy("doc_id").agg(F.min("plain").alias("plain"))
