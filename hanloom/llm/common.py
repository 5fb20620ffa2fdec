"""What the text operators share: Arrow streaming over rows and stable hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship

#: Rows gathered before a batch goes back to the JVM.
ROWS_OUT = 4096


def signed64(data: bytes | str) -> int:
    """A stable 64-bit hash in the range of bigint."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >= 1 << 63 else h


def flat_map(df: DataFrame, each: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Call ``each(*columns)`` for every row and emit the tuples it gives, batch by batch.

    Rows travel as Arrow batches; ``each`` is made once a task by calling it when it has
    the attribute ``per_task``, so that models and tables load once.
    """
    spark_schema = _parse_datatype_string(schema)
    assert isinstance(spark_schema, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spark_schema)
        work = each() if getattr(each, "per_task", False) else each
        width = len(arrow)
        out: list[list] = [[] for _ in range(width)]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    for made in work(*row):
                        for cell, value in zip(out, made):
                            cell.append(value)
                if len(out[0]) >= ROWS_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)
                    out = [[] for _ in range(width)]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return arrow_map(df, run, spark_schema)


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with this package sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def per_task(make: Callable[[], Callable[..., Iterable[tuple]]]) -> Callable:
    """Mark ``make`` as a factory that flat_map calls once in each task."""
    make.per_task = True
    return make
