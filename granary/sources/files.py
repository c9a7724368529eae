"""Readers of documents in files. Schemas are given, not inferred; what cannot be read is an error, not a null."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.blocks import html_to_text, json_to_text

DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "id", "source_id", "language", "text", "license")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped. strict: a malformed line ends the read with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """A JSON file that is a list of documents, or an object with the list under "documents"."""
    both = T.StructType([*schema.fields, T.StructField("documents", T.ArrayType(schema))])
    x = spark.read.schema(both).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    listed = x.where("documents IS NOT NULL").select(F.explode("documents").alias("d")).select("d.*")
    return x.where("documents IS NULL").drop("documents").unionByName(listed)


def text_parts(x: DataFrame, name: str, text: str) -> DataFrame:
    """doc_id ("name:i") and text of the parts between blank lines of each text."""
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    strip = lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda b: F.length(b) > 0)
    return x.select(F.col(name).alias("name"), F.posexplode(parts).alias("i", "text")).select(F.concat_ws(":", "name", F.col("i").cast("string")).alias("doc_id"), "text")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files split on blank lines: doc_id ("name:i"), text."""
    x = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "value")
    return text_parts(x, "name", "value")


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that are lists of {text, language}: path, record_no and both, each record with its own language."""
    one = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("language", T.StringType())]))
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", one).alias("r"))
    return x.select("path", F.posexplode("r").alias("record_no", "r")).select("path", "record_no", "r.text", "r.language")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, format and text of files by their suffix: text (txt, md, none), markup (html, htm, xhtml, xml), json (all strings in it).

    A file of another kind, or JSON that cannot be read, ends the read with an error.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").withColumn("suffix", suffix)
    kind = F.when(F.col("suffix").isin("", "txt", "md"), "text").when(F.col("suffix").isin("html", "htm", "xhtml", "xml"), "markup").when(F.col("suffix") == "json", "json")
    kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unsupported format: "), "suffix")).cast("string"))
    text = F.when(F.col("format") == "markup", html_to_text(F.col("value"))).when(F.col("format") == "json", F.coalesce(json_to_text(F.col("value")), F.raise_error(F.concat(F.lit("unreadable JSON: "), "path")).cast("string"))).otherwise(F.col("value"))
    return x.withColumn("format", kind).select("path", "format", text.alias("text"))


def read_required(df: DataFrame, what: str) -> DataFrame:
    """df as it is; one without rows is an error."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


@F.pandas_udf(T.StringType())
def yaml_to_json(s: pd.Series) -> pd.Series:
    """YAML texts as JSON; dates as text. Needs the package yaml where it runs, and says so where it is missing."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package yaml") from e
    return s.map(lambda t: json.dumps(yaml.safe_load(t), ensure_ascii=False, default=str), na_action="ignore")


def read_yaml_list(spark: SparkSession, path: str, field: str, schema: T.StructType, key: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """The list under ``field`` of YAML files (JSON is YAML too), nulls of some columns filled; a key that occurs twice is an error."""
    x = spark.read.text(path, wholetext=True).select(yaml_to_json("value").alias("j"))
    x = x.select(F.explode(F.from_json("j", T.StructType([T.StructField(field, T.ArrayType(schema))]))[field]).alias("r")).select("r.*")
    return union_unique([x.na.fill(defaults) if defaults else x], key)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph in YAML: under "nodes" a list of id, subject, grade and depends_on. nodes: node, subject, grade;
    edges: node, needs."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("grade", T.IntegerType()), T.StructField("depends_on", T.ArrayType(T.StringType()))])
    x = read_yaml_list(spark, path, "nodes", schema, "id").withColumnRenamed("id", "node")
    return x.select("node", "subject", "grade"), x.select("node", F.explode("depends_on").alias("needs"))


def read_suites(spark: SparkSession, glob: str, schema: T.StructType, key: str = "case_id") -> DataFrame:
    """The cases of all suites that a glob of JSON lines files names; a case that occurs twice ends the query with an error."""
    return union_unique([read_jsonl(spark, glob, schema)], key)


def read_latest(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str) -> DataFrame:
    """A ledger of JSON lines: of each key the row that is last in order."""
    x = read_jsonl(spark, path, schema)
    return x.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in x.columns if c != key]), F.struct(F.col(order), F.xxhash64(*x.columns))).alias("r")).select(key, "r.*")


def read_token_stream(spark: SparkSession, path: str, by: str, value: str, start: int, stop: int) -> DataFrame:
    """The tokens from start up to stop of one stream as ``write_token_stream`` wrote it: (at, id). Only rows that reach into
    the range are read for their ids."""
    x = spark.read.parquet(path).where((F.col(by) == value) & (F.col("start") < stop) & (F.col("stop") > start))
    x = x.select("start", F.posexplode("ids").alias("i", "id")).select((F.col("start") + F.col("i")).alias("at"), "id")
    return x.where((F.col("at") >= start) & (F.col("at") < stop))


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, to be set against a ledger."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def union_unique(frames: list[DataFrame], key: str) -> DataFrame:
    """The union of frames by column names; a key that occurs twice ends the query with an error."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    twice = out.groupBy(key).agg(F.count("*").alias("_n"))
    once = twice.where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("twice: "), F.col(key).cast("string"))).isNull())
    return out.join(once.select(key), key)
