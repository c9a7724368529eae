"""Writers that say what they wrote."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.running import running_total


def digest(df: DataFrame) -> dict:
    """Rows, characters of their JSON and a digest that doesn't depend on their order."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    r = df.select(row.alias("r")).agg(F.count("*").alias("n"), F.sum(F.length("r")).alias("c"), F.sum(F.xxhash64("r").cast("decimal(38,0)")).alias("h")).first()
    return {"rows": r.n, "chars": int(r.c or 0), "digest": str(r.h or 0)}


def files_written(spark: SparkSession, path: str) -> dict:
    """Files under a path, their bytes, and one SHA-256 over the sorted hashes of their contents. Files are hashed where they are
    read; the driver sees a hash a file."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("length", F.sha2("content", 256).alias("h"))
    r = x.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("sha256")).first()
    return {"files": r.files, "bytes": int(r.bytes), "sha256": r.sha256}


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> dict:
    """Write JSON lines and return their digest. ``files_written`` gives bytes and SHA-256 of what is there then."""
    df.write.mode(mode).json(path)
    return digest(df.sparkSession.read.schema(df.schema).json(path))


def write_sorted(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> dict:
    """Write JSON lines in the order of key, from file to file (ledgers are read by people): range-partitioned, not brought into one task."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode(mode).json(path)
    return files_written(df.sparkSession, path)


def write_routes(df: DataFrame, route: str, path: str, mode: str = "errorifexists") -> None:
    """One folder a route, so that a reader of one route reads no other."""
    df.write.mode(mode).partitionBy(route).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(report: dict, spark: SparkSession, path: str) -> None:
    """A small report as one JSON file, keys in order."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_token_stream(df: DataFrame, key: str, ids: str, by: str, path: str, end: int, mode: str = "errorifexists") -> dict:
    """Token ids of each row and an end token, as rows (by, key, start, stop, ids) of the stream of each ``by``, in order of key, with
    the place that each row takes in it. Returns rows, tokens and the end token; rows without ids take their end token's place only."""
    x = df.select(key, by, F.concat(F.coalesce(ids, F.array().cast("array<int>")), F.array(F.lit(end))).alias("ids"))
    x = running_total(x.withColumn("_n", F.size("ids")), by, key, "_n", "stop").withColumn("start", F.col("stop") - F.col("_n"))
    x.select(by, key, "start", "stop", "ids").write.mode(mode).partitionBy(by).parquet(path)
    r = df.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("tokens")).first()
    return {"rows": r.rows, "tokens": int(r.tokens), "end": end}
