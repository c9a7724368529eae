"""Which of many 64-bit keys a bounded filter holds, so that what cannot join is dropped before it is shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import ngrams

#: Bits of a filter: 16 for each key, up to this bound (64 MB). Beyond it more keys pass, and the join after it drops them.
FILTER_BITS = 1 << 29
SEGMENT = 1 << 19


def gram_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of every row of n words, in order, repeats kept. Rows of words are never shuffled as text."""
    return F.transform(ngrams(words, n), lambda g: F.xxhash64(g))


def key_filter(keys: DataFrame, column: str = "g", rows: float | None = None) -> tuple[int, np.ndarray]:
    """(bits, filter as bytes) of a column of longs. It is put together from segments of 64 KB, each made by one task from
    its distinct bits, so the driver holds the filter (at most FILTER_BITS) and never the keys. rows: about how many there
    are, if that is known; else they are counted."""
    bits = SEGMENT
    while bits < min(FILTER_BITS, 16 * (keys.count() if rows is None else rows or 0)):
        bits *= 2
    slots = keys.where(F.col(column).isNotNull()).select(F.pmod(column, F.lit(bits)).alias("s")).distinct()
    slots = slots.select(F.floor(F.col("s") / SEGMENT).alias("seg"), (F.col("s") % SEGMENT).alias("s"))

    def segment(t: pa.Table) -> pa.Table:
        m = np.zeros(SEGMENT, np.uint8)
        m[t["s"].to_numpy()] = 1
        return pa.table({"seg": [t["seg"][0].as_py()], "m": [np.packbits(m).tobytes()]})

    whole = np.zeros(bits // 8, np.uint8)
    for r in slots.groupBy("seg").applyInArrow(segment, "seg bigint, m binary").toLocalIterator():
        whole[r.seg * SEGMENT // 8 : (r.seg + 1) * SEGMENT // 8] = np.frombuffer(r.m, np.uint8)
    return bits, whole


def held_by(held: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each of the keys."""
    bits, whole = held
    s = keys & (bits - 1)
    return (whole[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool)


def may_hold(df: DataFrame, key: str, held: tuple[int, np.ndarray]) -> DataFrame:
    """df with _held: whether a filter may hold the long in its column key (false for null), in place of that column."""
    shared = df.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        return pd.Series(held_by(shared.value, s.fillna(0).to_numpy(np.int64))) & s.notna()

    return df.withColumn("_held", test(F.col(key))).drop(key)


def exploded(df: DataFrame, column: str, only: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """df with a row for each element of its column of arrays of longs; those that the filter ``only`` cannot hold left out.

    A row of df without elements gives none. Elements are filtered in their Arrow batches, so nothing is exploded that is dropped.
    """
    if only is None:
        return df.withColumn(column, F.explode(column))
    shared = df.sparkSession.sparkContext.broadcast(only)
    names, at = df.columns, df.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.LongType()) if f.name == column else f for f in df.schema.fields])

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            a = b.column(at)
            of, row = a.flatten(), pc.list_parent_indices(a)
            keep = np.flatnonzero(held_by(shared.value, of.to_numpy(zero_copy_only=False)))
            row = row.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([of.take(pa.array(keep)) if i == at else c.take(row) for i, c in enumerate(b.columns)], names)

    return df.mapInArrow(run, schema)
