"""Arrays over streams. Operators within rows (fields, element-wise functions, reducers at inner axes, filters, strings,
combinations) are expressions, and run on a stream as they do on files. Whatever needs the order or the number of all rows
(slices, axis 0, axis None) isn't defined there and is refused by Spark when the query starts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ragtide.operators.array import Array, over_columns
from ragtide.operators.frame import Frame


def from_stream(source: DataFrame) -> Array:
    """An array over a streaming DataFrame's rows."""
    if not source.isStreaming:
        raise TypeError("from_stream: the DataFrame isn't a stream")
    frame = Frame(source, order=("__rt_none",))
    return over_columns(frame, source.columns)


def read_parquet_stream(path: str, schema: T.StructType, spark: SparkSession | None = None, max_files: int | None = None) -> Array:
    """Files as they arrive in a folder; max_files bounds what one batch takes."""
    reader = (spark or SparkSession.active()).readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return from_stream(reader.parquet(path))


def write_stream(array: Array, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Appends the array's rows as Parquet. The checkpoint folder keeps what has been written, so that a query that was
    stopped goes on where it was, without losing or repeating rows."""
    writer = array.to_spark().writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
