"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.session import cut


def running_total(df: DataFrame, by: str, order: str, value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows of the same by up to this one, in the order of order (which should be unique).

    A group may hold most of all rows: rows are range-partitioned by both, summed up within their partition, and shifted by
    what the partitions before hold. Nothing but a number per partition and group is brought together. Nulls of by are a group.
    """
    key = F.struct(F.col(by).isNull().alias("n"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("v"))
    x = df.withColumn("_by", key)
    x = cut(x.repartitionByRange(F.col("_by"), F.col(order)).withColumn("_p", F.spark_partition_id()))
    parts = x.groupBy("_p", "_by").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_p", "_by", before.alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_p", "_by").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_own", own).join(parts, ["_p", "_by"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_p", "_by", "_own", "_before")
