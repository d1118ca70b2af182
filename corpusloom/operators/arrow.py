"""Arrow-batched Python over a few columns, with the other columns left in the JVM where possible."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_rows(df: DataFrame, schema: str | T.StructType, fn: Callable[..., list[tuple]], columns: list[str] | None = None) -> DataFrame:
    """fn(*values of a row) gives the output rows of that row, as tuples in the order of schema; runs by Arrow batch."""
    cols = columns or df.columns
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                out.extend(fn(*row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select(*cols).mapInArrow(run, st)
