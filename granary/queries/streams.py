"""Queries that run as streams over what a table holds now (an extension beyond batch work)."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.queries import query, table
from granary.session import ensure_checkpoint_dir
from granary.streaming.events import each_once, run_to_end, windowed_counts


@query("SELECT DISTINCT log_id, source_id, stage FROM acquisition_log WHERE log_id IS NOT NULL AND received_at IS NOT NULL")
def stream_log_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acquisition log as a stream, each event once."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "acquisition_log").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/acquisition_log.parque[t]").where("log_id IS NOT NULL AND received_at IS NOT NULL").select("log_id", "source_id", "stage", "received_at")
    run_to_end(each_once(s, "log_id", "received_at", "3650 days").drop("received_at"), f"{base}/out", f"{base}/state")
    return spark.read.schema("log_id string, source_id string, stage string").parquet(f"{base}/out")


@query("SELECT floor(epoch(received_at) / 86400)::BIGINT AS day, stage, count(*) AS events FROM acquisition_log WHERE received_at IS NOT NULL GROUP BY 1, 2")
def stream_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and stage, counted as a stream whose watermark passes every window at the end: late ones are in."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "acquisition_log").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/acquisition_log.parque[t]").where("received_at IS NOT NULL").select("received_at", "stage")
    run_to_end(windowed_counts(s, "received_at", ["stage"], "1 day", "3650 days"), f"{base}/out", f"{base}/state", "complete")
    x = spark.read.schema("window struct<start: timestamp, end: timestamp>, stage string, events bigint").parquet(f"{base}/out")
    return x.select(F.floor(F.unix_timestamp("window.start") / 86400).alias("day"), "stage", "events")
