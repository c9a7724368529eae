"""Queries that write with each sink into the shared folder, read back with each reader, and compare."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import compare_form, tokens
from granary.queries import query, table
from granary.queries import sql as S
from granary.session import ensure_checkpoint_dir
from granary.sources.files import hashed_files, read_artifacts, read_json_documents, read_json_records, read_jsonl, read_latest, read_suites, read_token_stream, text_parts
from granary.sources.sinks import append_log, files_written, write_jsonl, write_report, write_routes, write_sorted, write_token_stream


def folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/storage-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read again with their schema."""
    d, out = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), f"{folder(spark)}/docs"
    write_jsonl(d, out)
    return read_jsonl(spark, out, d.schema).select("doc_id", "lang", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def json_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in JSON files that hold a list under "documents", at most 500 ids a list, read again."""
    schema, out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())]), f"{folder(spark)}/lists"
    d = table(spark, sf_dir, "documents").select("source", F.struct("doc_id", "lang", "text").alias("d"))
    lists = d.groupBy("source", F.floor(F.col("d.doc_id") / 500).alias("part")).agg(F.collect_list("d").alias("documents"))
    lists.select(F.to_json(F.struct("documents")).alias("value")).write.option("lineSep", "\n").text(out)
    return read_jsonl(spark, out, T.StructType([T.StructField("documents", T.ArrayType(schema))])).select(F.explode("documents").alias("d")).select("d.doc_id", "d.lang", F.md5(F.encode("d.text", "UTF-8")).alias("digest"))


@query("SELECT case_id, language, md5(prompt) AS digest FROM dev_smoke_suite")
def json_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of the suite in one JSON file, read again."""
    out, schema = f"{folder(spark)}/one", T.StructType([T.StructField(c, T.StringType()) for c in ("case_id", "language", "prompt")])
    c = table(spark, sf_dir, "dev_smoke_suite").select(F.struct("case_id", "language", "prompt").alias("c"))
    c.agg(F.to_json(F.struct(F.collect_list("c").alias("documents"))).alias("value")).coalesce(1).write.text(out)
    return read_json_documents(spark, out, schema).select("case_id", "language", F.md5(F.encode("prompt", "UTF-8")).alias("digest"))


@query("SELECT language, count(*) AS records, count(*) FILTER (prompt IS NOT NULL) AS texts FROM m1_probe_v0 GROUP BY 1")
def json_records_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts in a JSON file of records, each with its own language, read again."""
    out = f"{folder(spark)}/records"
    p = table(spark, sf_dir, "m1_probe_v0").select(F.struct(F.col("prompt").alias("text"), "language").alias("r"))
    p.agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.text(out)
    return read_json_records(spark, out).groupBy("language").agg(F.count("*").alias("records"), F.count("text").alias("texts"))


@query("SELECT format, count(*) AS files, sum(chars)::BIGINT AS chars FROM (VALUES ('text', 9), ('markup', 5), ('json', 7), ('text', 3)) t(format, chars) GROUP BY 1")
def artifacts_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each kind, read by their suffix."""
    base = folder(spark)
    for name, body in (("a.txt", "one\n\ntwo\n"), ("b.html", "<p>one</p>&amp;<script>x</script>"), ("c.json", '{"b": "one", "a": {"x": "two"}}'), ("d.md", "end")):
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        stream = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs)
        stream.write(bytearray(body.encode()))
        stream.close()
    return read_artifacts(spark, base).groupBy("format").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


@query("SELECT axis, count(*) AS cases, sum(length(prompt))::BIGINT AS chars FROM dev_smoke_suite GROUP BY 1")
def suites_as_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite written in two files and read as one by a glob."""
    base, s = folder(spark), table(spark, sf_dir, "dev_smoke_suite").select("case_id", "axis", "prompt")
    for i in (0, 1):
        write_jsonl(s.where(F.pmod(F.xxhash64("case_id"), F.lit(2)) == i), f"{base}/suite{i}")
    return read_suites(spark, f"{base}/suite*", s.schema).groupBy("axis").agg(F.count("*").alias("cases"), F.sum(F.length("prompt")).alias("chars"))


@query("SELECT path, max(bytes) AS bytes FROM artifact_ledger WHERE path IS NOT NULL GROUP BY 1")
def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger appended to JSON lines twice, read back with the largest row of each path."""
    out, a = f"{folder(spark)}/ledger", table(spark, sf_dir, "artifact_ledger").select("path", "sha256", "bytes")
    append_log(a.where("bytes IS NULL"), out)
    append_log(a.where("bytes IS NOT NULL"), out)
    return read_latest(spark, out, a.schema, "path", "bytes").select("path", "bytes")


@query("SELECT count(*) AS rows, count(DISTINCT path) AS paths, true AS in_order FROM artifact_ledger")
def sorted_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written in the order of its paths: whether each file begins where the one before ends."""
    out, a = f"{folder(spark)}/sorted", table(spark, sf_dir, "artifact_ledger").select("path", "sha256")
    write_sorted(a, "path", out)
    x = read_jsonl(spark, out, a.schema).withColumn("f", F.input_file_name())
    files = x.groupBy("f").agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.count("*").alias("n"), F.count_distinct("path").alias("p"))
    chain = F.transform(F.array_sort(F.collect_list(F.struct("f", "lo", "hi"))), lambda r: r)
    ends = files.agg(F.sum("n").alias("rows"), F.sum("p").alias("paths"), chain.alias("c"))
    ok = F.forall(F.sequence(F.lit(1), F.greatest(F.size("c") - 1, F.lit(1))), lambda i: (F.size("c") < 2) | (F.get("c", i)["lo"] >= F.get("c", i - 1)["hi"]))
    return ends.select("rows", "paths", ok.alias("in_order"))


@query("SELECT lang, count(*) AS documents FROM documents WHERE lang IN ('hi', 'mr') GROUP BY 1")
def routes_read_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to a folder for each label; two of them read alone."""
    out = f"{folder(spark)}/routes"
    write_routes(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", out)
    return spark.read.parquet(out).where("lang IN ('hi', 'mr')").groupBy("lang").agg(F.count("*").alias("documents"))


@query("SELECT 1 AS files, (SELECT count(*) FROM region) AS rows, true AS same_hash")
def files_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and SHA-256 of what was written, by the sink and by hashing the files again."""
    out, r = f"{folder(spark)}/hashed", table(spark, sf_dir, "region").coalesce(1)
    said = write_jsonl(r, out)
    there = files_written(spark, out)
    again = hashed_files(spark, f"{out}/part-*").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256).alias("h"))
    same = (F.col("h") == there["sha256"]) & (F.col("bytes") == there["bytes"])
    return again.select(F.col("files").cast("int").alias("files"), F.lit(said["rows"]).cast("bigint").alias("rows"), same.alias("same_hash"))


@query("SELECT key, value FROM (VALUES ('a', '[\"x\",null]'), ('b', '1')) t(key, value)")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small report written as one JSON file, its entries read again."""
    out = f"{folder(spark)}/report"
    write_report({"b": 1, "a": ["x", None]}, spark, out)
    x = spark.read.text(out)
    return x.select(F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.get_json_object("value", "$.a"), F.get_json_object("value", "$.b"))))).select("key", "value")


@query("SELECT case_id || ':' || i AS doc_id, length(t) AS chars FROM (SELECT case_id, unnest([0, 1]) AS i, unnest([trim(prompt), 'second part']) AS t FROM dev_smoke_suite WHERE prompt IS NOT NULL)")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of the suite in text files of two parts each, read again part by part."""
    base = folder(spark)
    c = table(spark, sf_dir, "dev_smoke_suite").where("prompt IS NOT NULL").select("case_id", F.concat(F.trim("prompt"), F.lit("\r\n \r\nsecond part")).alias("value"))
    c.repartition("case_id").write.partitionBy("case_id").text(base)
    x = spark.read.text(base, wholetext=True).select("case_id", "value")
    parts = text_parts(x, "case_id", "value")
    return parts.select("doc_id", F.length("text").alias("chars"))


_W = f"SELECT doc_id, lang, {S.tokens(S.compare_form('text'))} AS w FROM documents WHERE lang IN ('hi', 'en', 'mr') AND text IS NOT NULL"
_STREAM = f"SELECT *, sum(len(w) + 1) OVER (PARTITION BY lang ORDER BY doc_id) AS stop FROM ({_W})"


@query(f"SELECT * FROM (SELECT stop - len(w) - 1 + i - 1 AS place, ('0x' || substr(md5(w[i]), 1, 6))::INT AS id FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ({_STREAM}) WHERE lang = 'hi')) WHERE place >= 500 AND place < 2500 UNION ALL SELECT stop - 1, -1 FROM ({_STREAM}) WHERE lang = 'hi' AND stop - 1 >= 500 AND stop - 1 < 2500")
def token_stream_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids (a hash of each word) written as a stream for each label with end tokens; 2,000 places of one read back (the range is
    the feature)."""
    out, d = f"{folder(spark)}/tokens", table(spark, sf_dir, "documents").where("lang IN ('hi', 'en', 'mr') AND text IS NOT NULL")
    ids = F.transform(tokens(compare_form(F.col("text"))), lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"))
    write_token_stream(d.select("doc_id", "lang", ids.alias("ids")), "doc_id", "ids", "lang", out, -1)
    return read_token_stream(spark, out, "lang", "hi", 500, 2500).withColumnRenamed("at", "place")


@query("SELECT * FROM (VALUES ('region', 'ok'), ('nation', 'mismatch'), ('nowhere', 'missing'), ('extra', 'unlisted')) t(name, status)")
def ledger_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files hashed again and set against a ledger: the same, another hash, not there, not listed."""
    out = folder(spark)
    for name, source in (("region", "region"), ("nation", "nation"), ("extra", "region")):
        table(spark, sf_dir, source).coalesce(1).write.json(f"{out}/{name}")
    there = hashed_files(spark, f"{out}/*/part-*").select(F.regexp_extract("path", "/([a-z]+)/part-", 1).alias("name"), "sha256")
    ledger = there.where("name = 'region'").select("name", F.col("sha256").alias("listed")).union(spark.createDataFrame([("nation", "0" * 64), ("nowhere", "1" * 64)], "name string, listed string"))
    x = ledger.join(there, "name", "full")
    return x.select("name", F.when(F.col("listed").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("listed"), "ok").otherwise("mismatch").alias("status"))


@query("SELECT route, count(*) AS records FROM (SELECT CASE WHEN license IS NULL THEN 'rejected' ELSE 'trainable' END AS route FROM documents) GROUP BY 1")
def route_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to a folder a route with a report of how many went where, the report read again."""
    out = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("license").isNull(), "rejected").otherwise("trainable").alias("route"))
    write_routes(d, "route", f"{out}/routes")
    counts = {r.route: r.n for r in spark.read.parquet(f"{out}/routes").groupBy("route").agg(F.count("*").alias("n")).collect()}
    write_report(counts, spark, f"{out}/report")
    x = spark.read.text(f"{out}/report").select(F.explode(F.from_json("value", "map<string, bigint>")).alias("route", "records"))
    return x.select("route", "records")
