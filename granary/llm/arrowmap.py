"""Row-wise work in Python by Arrow batches, without pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS = 2000


def map_rows(df: DataFrame, schema: str | StructType, start: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """For each row of df, the tuples that start()(*values) yields, as columns of schema.

    start runs once in each task, so what it loads is kept for the task. Output goes out in batches of ROWS rows, so a
    task holds little whatever the partition's size.
    """
    st = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(st, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, out = start(), []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out.extend(f(*row))
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, st)
