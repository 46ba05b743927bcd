"""Sinks: Parquet, JSON, DataFrames and what the driver can hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.array import Array
from ragtide.operators.node import Rec, column


def _written(array: Array, name: str = "value") -> DataFrame:
    """Rows in the array's order within each file, and files in its order where partitions are known."""
    frame = array.frame
    order, df = frame.ordered(), frame.df
    if frame.part is not None and (frame.divisions is not None or frame.packed):
        df = df.repartitionById(frame.npartitions, F.col(frame.part).cast("int")).sortWithinPartitions(*order)
    if isinstance(array.node, Rec) and array.depth == 0:
        return df.select(*[column(v).alias(n) for n, v in array.node.fields.items()])
    return df.select(array.col.alias(name))


def _void_as(df: DataFrame, to: str | None) -> DataFrame:
    """Types of nothing can't be written: they become `to`."""
    cast = {f.name: F.col(f"`{f.name}`").cast(to or "string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    return df.withColumns(cast) if cast else df


def to_parquet(array: Array, destination: str, emptyarray_to: str | None = None, compression: str = "zstd", compression_level: int | None = None, row_group_size: int = 64 * 1024 * 1024, mode: str = "error", compute: bool = True, **options: Any) -> Any:
    """One file for each partition at least; a failed write leaves no files that readers see. compute=False gives a
    callable that writes."""

    def write() -> str:
        writer = _void_as(_written(array), emptyarray_to).write.mode(mode).option("compression", compression).option("parquet.block.size", row_group_size)
        if compression_level is not None:
            writer = writer.option("parquet.compression.codec.zstd.level", compression_level)
        for k, v in options.items():
            writer = writer.option(k, v)
        writer.parquet(destination)
        return destination

    return write() if compute else write


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON values to the lines of one array, as they stream by."""
    mark = "["
    for batch in batches:
        rows = batch.column(0).to_pylist()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([f"{mark}{rows[0]}", *(f",{x}" for x in rows[1:])])], ["value"])
            mark = ","
    if mark == ",":
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def to_json(array: Array, path: str, line_delimited: bool = True, nan_string: str | None = None, posinf_string: str | None = None, neginf_string: str | None = None, complex_record_fields: tuple[str, str] | None = None, compression: str | None = None, mode: str = "error", compute: bool = True, **options: Any) -> Any:
    """JSON lines. nan_string and its like are written for those numbers; without them Spark writes NaN and Infinity as
    strings of these names. Missing values are written as null."""
    names = [(float("nan"), nan_string), (float("inf"), posinf_string), (float("-inf"), neginf_string)]
    given = [(x, s) for x, s in names if s is not None]

    def strings(col: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            fields = {f.name: strings(col.getField(f.name), f.dataType) for f in t.fields}
            if complex_record_fields and list(fields) == ["re", "im"]:
                fields = dict(zip(complex_record_fields, fields.values()))
            return F.when(col.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))
        if isinstance(t, T.ArrayType):
            return F.transform(col, lambda v: strings(v, t.elementType))
        if given and isinstance(t, T.DoubleType | T.FloatType):
            # A variant, so that numbers stay numbers beside the strings.
            out = col.cast("variant")
            for x, s in given:
                out = F.when(F.isnan(col) if x != x else col == x, F.lit(s).cast("variant")).otherwise(out)
            return out
        return col

    def write() -> str:
        df = _void_as(_written(array), "string")
        df = df.select(*[strings(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
        if not line_delimited:
            rows = F.to_json(F.struct(*[F.col(f"`{n}`") for n in df.columns]), {"ignoreNullFields": "false"})
            df.select(rows.alias("value")).mapInArrow(_as_array, "value string").write.mode(mode).option("compression", compression or "none").text(path)
        elif df.columns == ["value"] and not (isinstance(array.node, Rec) and array.depth == 0):
            # Bare values, as JSON has them: without a name in front.
            rows = F.regexp_replace(F.to_json(F.struct("value"), {"ignoreNullFields": "false"}), r'^\{"value":(.*)\}$', "$1")
            df.select(rows.alias("value")).write.mode(mode).option("compression", compression or "none").text(path)
        else:
            writer = df.write.mode(mode).option("ignoreNullFields", "false").option("compression", compression or "none")
            for k, v in options.items():
                writer = writer.option(k, v)
            writer.json(path)
        return path

    return write() if compute else write


def to_dataframe(array: Array, levelname: Callable[[int], str] = lambda i: f"{'sub' * i}entry", values: str = "values") -> DataFrame:
    """A row for each single value, with its row's number and its places in the lists; a column for each field. Lists of
    a record's fields that are deeper than it have to be equally long; null and empty lists give no rows."""
    from ragtide.operators.array import exploded
    from ragtide.operators.structure import zip as rzip

    if isinstance(array.node, Rec):
        def flat(v: Rec, prefix: str = "") -> dict[str, Any]:
            out: dict[str, Any] = {}
            for n, x in v.fields.items():
                out.update(flat(x, f"{prefix}{n}.") if isinstance(x, Rec) else {f"{prefix}{n}": array.of(x)})
            return out

        parts = flat(array.node)
        array = rzip(parts) if any(p.depth for p in parts.values()) else rzip(parts, depth_limit=1)
    row = array.frame.ranked()
    places = [row]
    while array.depth:
        array = exploded(array, keep=(row,) if row not in array.frame.order else ())
        places.append(array.frame.order[-1])
        array.frame.row = None
    cols = [column(v).alias(n) for n, v in array.node.fields.items()] if isinstance(array.node, Rec) else [array.col.alias(values)]
    return array.frame.df.select(*[F.col(p).cast("bigint").alias(levelname(i)) for i, p in enumerate(places)], *cols)


def to_numpy(array: Array, dtype: Any = None) -> Any:
    """All values on the driver, as one NumPy array: rows have to have the same shape."""
    import numpy as np

    rows = array.compute()
    out = np.array(rows, dtype=dtype)
    if out.dtype == object and array.depth:
        raise ValueError("rows of different shapes don't make a NumPy array")
    return out


def to_bag(array: Array) -> Iterator[Any]:
    """Rows as Python values, a partition at a time."""
    return iter(array.to_local_iterator())


def to_delayed(array: Array) -> list[Callable[[], list]]:
    """For each partition a callable that computes its rows."""
    return [lambda i=i: array.partitions[i].compute() for i in range(array.npartitions)]


def to_list(array: Any) -> Any:
    return array.compute()

