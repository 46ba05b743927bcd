"""Sources: Parquet, JSON and text files, and rows made by functions or held in memory."""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import json
import lzma
import zipfile
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.array import Array, over_columns
from ragtide.operators.frame import Frame, hidden
from ragtide.operators.node import Leaf, Rec, of_type


def _spark(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.active()


def _paths(source: Any) -> list[str]:
    return [str(source)] if not isinstance(source, list | tuple) else [str(s) for s in source]


def _pick(array: Array, columns: Any) -> Array:
    """Leaves named by dotted paths, in which * stands for any names."""
    import fnmatch

    wanted = [columns] if isinstance(columns, str) else list(columns)

    def pick(rec: Rec, prefix: str) -> Rec:
        fields = {}
        for n, v in rec.fields.items():
            path = f"{prefix}{n}"
            if any(fnmatch.fnmatchcase(path, w) for w in wanted):
                fields[n] = v
            elif isinstance(v, Rec) and any(_may(w, path) for w in wanted):
                inner = pick(v, f"{path}.")
                if inner.fields:
                    fields[n] = inner
        return Rec(rec.depth, fields, rec.skel, None, rec.attrs)

    def _may(w: str, path: str) -> bool:
        parts, have = w.split("."), path.split(".")
        return len(parts) > len(have) and all(fnmatch.fnmatchcase(h, p) for h, p in zip(have, parts))

    out = pick(array.node, "")
    if not out.fields:
        raise ValueError(f"no column matches {wanted}; there are {array.fields}")
    return array.of(out)


def from_parquet(path: Any, columns: Any = None, split_row_groups: bool | None = False, report: bool = False, spark: SparkSession | None = None, schema: T.StructType | None = None, **options: Any) -> Any:
    """Records of Parquet files: a path, a glob, a folder or a list. A file is a partition; split_row_groups=True cuts at
    row groups, which Spark does when a file is read in any case, so that here it sets the divisions only: they are
    counted at once. columns: dotted paths, * stands for names. report: also a DataFrame of path, bytes, rows and ok; files
    that can't be read then give no rows. Other options go to Spark's reader."""
    reader = _spark(spark).read
    if report:
        reader = reader.option("ignoreCorruptFiles", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(*_paths(path))
    names = df.columns
    array = over_columns(Frame(df, from_files=True, whole=True), names)
    if columns is not None:
        array = _pick(array, columns)
    if split_row_groups:
        array.frame.compute_divisions()
    return (array, _report(_paths(path), df, _spark(spark))) if report else array


def _report(paths: list[str], df: DataFrame, spark: SparkSession) -> DataFrame:
    """A row for each file: only names and sizes are listed; rows are counted from the files' own statistics."""
    listed = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))
    rows = df.groupBy(F.col("_metadata.file_path").alias("__rt_path")).agg(F.count("*").alias("rows"))
    same = F.url_decode(F.regexp_replace("path", r"^file:/+", "/")) == F.url_decode(F.regexp_replace("__rt_path", r"^file:/+", "/"))
    return listed.join(rows, same, "left").select("path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNotNull().alias("ok"))


# JSON.
_OPENERS: dict[str, Callable[[bytes], bytes]] = {"gz": gzip.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress, "lzma": lzma.decompress}


def _inflate(data: bytes, how: str) -> bytes:
    if how == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return b"\n".join(z.read(n) for n in z.namelist())
    if how in ("zst", "zstd"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return _OPENERS[how](data)


def _suffix(paths: list[str]) -> str | None:
    ends = {p.rsplit(".", 1)[-1] for p in paths if "." in p.rsplit("/", 1)[-1]}
    found = ends & {*_OPENERS, "zip", "zst"}
    return found.pop() if len(found) == 1 == len(ends) else None


def _lines(paths: list[str], compression: str | None, delimiter: str | None, spark: SparkSession, whole: bool) -> DataFrame:
    """Column value: lines (or whole files) with their file and place. Files in packings that Spark's own readers lack are
    unpacked by the tasks, a file at a time."""
    how = _suffix(paths) if compression == "infer" else compression
    if how in (None, "gz", "gzip", "bz2") and not whole:
        reader = spark.read.option("lineSep", delimiter) if delimiter else spark.read
        df = reader.text(paths)
        return df.select(F.col("value"), F.col("_metadata.file_path").alias("__rt_file"), F.col("_metadata.file_block_start").alias("__rt_block"), F.monotonically_increasing_id().alias("__rt_at"))
    raw = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                text = (_inflate(data, how) if how else data).decode()
                parts = [text] if whole else text.split(delimiter or "\n")
                if not whole and parts and not parts[-1]:
                    parts.pop()
                for i in range(0, len(parts), 10_000):
                    n = len(parts[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(parts[i : i + n]), pa.array([path] * n), pa.array([0] * n, pa.int64()), pa.array(range(i, i + n), pa.int64())], ["value", "__rt_file", "__rt_block", "__rt_at"])

    return raw.mapInArrow(run, "value string, __rt_file string, __rt_block long, __rt_at long")


def from_text(source: Any, blocksize: Any = None, delimiter: str | bytes = "\n", compression: str | None = "infer", spark: SparkSession | None = None) -> Array:
    """A string for each part between delimiters. blocksize: how much of a file a task reads (such as "64 MiB")."""
    spark = _with_blocks(_spark(spark), blocksize)
    if isinstance(delimiter, bytes):
        delimiter = delimiter.decode()
    df = _lines(_paths(source), compression, delimiter, spark, whole=False)
    return Array(Frame(df, ("__rt_file", "__rt_block", "__rt_at")), Leaf(F.col("value"), 0, (), T.StringType()))


def _with_blocks(spark: SparkSession, blocksize: Any) -> SparkSession:
    """A session that cuts files into blocks of this size: a copy, as Spark has one such setting for a session and other
    reads are to keep theirs."""
    if blocksize is None:
        return spark
    copy = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set("spark.sql.files.maxPartitionBytes", str(_bytes(blocksize)))
    return copy


def _bytes(size: Any) -> int:
    if isinstance(size, int):
        return size
    number, unit = str(size).split()
    return int(float(number) * {"B": 1, "KB": 10**3, "KIB": 2**10, "MB": 10**6, "MIB": 2**20, "GB": 10**9, "GIB": 2**30}[unit.upper()])


def from_json(source: Any, line_delimited: bool = True, schema: Any = None, nan_string: str | None = None, posinf_string: str | None = None, neginf_string: str | None = None, complex_record_fields: tuple[str, str] | None = None, blocksize: Any = None, delimiter: str | bytes | None = None, compression: str | None = "infer", meta_sample_rows: int | None = 100, report: bool = False, spark: SparkSession | None = None) -> Any:
    """Records of JSON lines, or (line_delimited=False) one value a file. schema: Spark's, its text, or a JSON schema;
    without it one is made from the first meta_sample_rows lines (None: from all); a later line with a field that these
    lack is an error, or counted in the report as lost_fields. nan_string and its like are strings that
    stand for those numbers. complex_record_fields: names of two fields, real and imaginary, that are kept as a record of
    doubles. report: also a DataFrame of the lines that aren't JSON, by file; their rows are then missing."""
    spark = _with_blocks(_spark(spark), blocksize)
    if isinstance(delimiter, bytes):
        delimiter = delimiter.decode()
    df = _lines(_paths(source), compression, delimiter, spark, whole=not line_delimited)
    df = df.where(F.trim("value") != "")
    if isinstance(schema, dict):
        schema = schema_of_jsonschema(schema)
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    sampled = schema is None and bool(meta_sample_rows)
    if schema is None:
        lines = df.select("value").limit(meta_sample_rows) if meta_sample_rows else df.select("value")
        objects = lines.where(F.ltrim("value").startswith("{"))
        if objects.limit(1).count():
            strings = getattr(objects._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
            schema = T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(strings).schema().json()))
        else:
            first = lines.first()
            if first is None:
                raise OSError(f"no JSON in {source}")
            schema = spark.range(1).select(F.schema_of_json(F.lit(first[0])).alias("s")).first()[0]
            schema = T._parse_datatype_string(schema)
    names = {nan_string: float("nan"), posinf_string: float("inf"), neginf_string: float("-inf")}
    names.pop(None, None)
    read = _loose(schema) if names else schema
    bad = hidden("bad")
    if isinstance(read, T.StructType):
        with_bad = T.StructType([*read.fields, T.StructField(bad, T.StringType())])
        df = df.withColumn("__rt_v", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "allowNonNumericNumbers": "true"}))
        wrong = F.col("__rt_v").isNull() | F.col("__rt_v").getField(bad).isNotNull()
    else:
        df = df.withColumn("__rt_v", F.from_json("value", read, {"allowNonNumericNumbers": "true"}))
        wrong = F.col("__rt_v").isNull()
    col = F.col("__rt_v")
    lost = F.lit(False)
    if sampled and isinstance(read, T.StructType):
        lost = F.coalesce(F.size(F.array_except(F.json_object_keys("value"), F.lit(read.names))) > 0, F.lit(False))
    failed = df.where(wrong | lost).groupBy(F.col("__rt_file").alias("path")).agg(F.count_if(wrong).alias("bad_lines"), F.count_if(lost & ~wrong).alias("lost_fields"))
    if not report:
        late = F.concat(F.lit("a field that the sampled lines lack (give a schema, or meta_sample_rows=None): "), F.substring("value", 1, 200))
        checked = F.when(lost & ~wrong, F.raise_error(late)).when(wrong, F.raise_error(F.concat(F.lit("not JSON of the schema: "), F.substring("value", 1, 200)))).otherwise(col)
        df = df.withColumn("__rt_v", checked)
    if names:
        df = df.withColumn("__rt_v", _numbers(F.col("__rt_v"), read, schema, names))
    frame = Frame(df, ("__rt_file", "__rt_block", "__rt_at"))
    if isinstance(schema, T.StructType):
        array = Array(frame, of_type(F.col("__rt_v"), schema))
        array = array.of(Rec(0, array.node.fields, (), None))
    else:
        array = Array(frame, of_type(F.col("__rt_v"), schema))
    if complex_record_fields:
        array = array.of(_complex(array.node, complex_record_fields))
    return (array, failed) if report else array


def _loose(t: T.DataType) -> T.DataType:
    """Doubles read as strings, as they may be names of special values."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_loose(t.elementType))
    return T.StringType() if isinstance(t, T.DoubleType | T.FloatType) else t


def _numbers(col: Any, old: T.DataType, new: T.DataType, names: dict[str, float]) -> Any:
    if isinstance(new, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_numbers(col.getField(f.name), old[f.name].dataType, f.dataType, names).alias(f.name) for f in new.fields]))
    if isinstance(new, T.ArrayType):
        return F.transform(col, lambda v: _numbers(v, old.elementType, new.elementType, names))
    if isinstance(new, T.DoubleType | T.FloatType):
        out = col.try_cast("double")
        for name, x in names.items():
            out = F.when(col == name, F.lit(x)).otherwise(out)
        return out.cast(new)
    return col


def _complex(value: Any, names: tuple[str, str]) -> Any:
    if isinstance(value, Leaf):
        return value
    if set(value.fields) == set(names):
        return Rec(value.depth, {"re": value.fields[names[0]], "im": value.fields[names[1]]}, value.skel, None, {**value.attrs, "record": "complex"})
    return Rec(value.depth, {n: _complex(v, names) for n, v in value.fields.items()}, value.skel, None, value.attrs)


#: JSON schema's names of types and Spark's.
_SIMPLE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def schema_of_jsonschema(schema: dict) -> T.DataType:
    """Spark's type of a JSON schema."""
    kind = schema.get("type")
    if isinstance(kind, list):
        return schema_of_jsonschema({**schema, "type": next(k for k in kind if k != "null")})
    if kind == "object":
        return T.StructType([T.StructField(n, schema_of_jsonschema(s)) for n, s in schema.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(schema_of_jsonschema(schema["items"]))
    if "enum" in schema and kind is None:
        return T.StringType()
    if kind not in _SIMPLE:
        raise ValueError(f"a JSON schema's type isn't known: {schema}")
    return _SIMPLE[kind]


def layout_to_jsonschema(layout: Any, existing_schema: dict | None = None, title: str = "untitled", description: str = "Made from an array's type", required: bool = False, is_option: bool = False) -> dict:
    """The JSON schema of an array's type."""
    dtype = layout.dtype if isinstance(layout, Array) else layout
    size = layout.node.attrs.get("size") if isinstance(layout, Array) else None

    def of(t: T.DataType, nullable: bool) -> dict:
        if isinstance(t, T.StructType):
            out: dict = {"type": "object", "properties": {f.name: of(f.dataType, f.nullable and is_option) for f in t.fields}}
            if required:
                out["required"] = [f.name for f in t.fields]
        elif isinstance(t, T.ArrayType):
            out = {"type": "array", "items": of(t.elementType, t.containsNull and is_option)}
        elif isinstance(t, T.VariantType | T.NullType):
            out = {}
        else:
            name = "string" if isinstance(t, T.StringType | T.BinaryType) else "boolean" if isinstance(t, T.BooleanType) else "integer" if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType) else "number"
            out = {"type": name}
        if nullable and "type" in out:
            out["type"] = [out["type"], "null"]
        return out

    made = of(dtype, False)
    if isinstance(size, int) and not isinstance(size, bool):
        made |= {"minItems": size, "maxItems": size}
    return {**(existing_schema or {"title": title, "description": description}), **made}


# Rows from memory or functions.
def _table(rows: list, dtype: T.DataType | None) -> tuple[Any, T.DataType]:
    from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

    if dtype is not None:
        return pa.array(rows, to_arrow_type(dtype)), dtype
    made = pa.array(rows)
    if pa.types.is_null(made.type):
        made = made.cast(pa.int64())
    return made, from_arrow_type(made.type)


def from_lists(source: list[list], schema: Any = None, spark: SparkSession | None = None) -> Array:
    """Each list is a partition of rows: Python values, as they would be in JSON."""
    if not source:
        raise ValueError("from_lists: no lists")
    dtype = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = [r for part in source for r in part]
    values, dtype = _table(rows, dtype)
    divisions = tuple(itertools.accumulate((len(p) for p in source), initial=0))
    parts = [i for i, p in enumerate(source) for _ in p]
    return _held(values, dtype, parts, divisions, _spark(spark))


def _held(values: Any, dtype: T.DataType, parts: list[int], divisions: tuple, spark: SparkSession) -> Array:
    from pyspark.sql.pandas.types import to_arrow_type

    table = pa.table({"value": values.cast(to_arrow_type(dtype)) if not isinstance(dtype, T.StructType) else values, "__rt_row": pa.array(range(len(values)), pa.int64()), "__rt_part": pa.array(parts, pa.int32())})
    df = spark.createDataFrame(table)
    frame = Frame(df, ("__rt_row",), row="__rt_row", part="__rt_part", divisions=divisions)
    return Array(frame, of_type(F.col("value"), df.schema["value"].dataType))


def from_rows(source: Any, npartitions: int = 1, label: str | None = None, schema: Any = None, spark: SparkSession | None = None) -> Array:
    """Rows in memory (a list or a pyarrow array), cut into partitions of equal length."""
    dtype = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if isinstance(source, pa.Array | pa.ChunkedArray):
        from pyspark.sql.pandas.types import from_arrow_type

        values = source.combine_chunks() if isinstance(source, pa.ChunkedArray) else source
        dtype = dtype or from_arrow_type(values.type)
    else:
        values, dtype = _table(list(source), dtype)
    n = len(values)
    size = max(1, -(-n // npartitions))
    divisions = (*range(0, n, size), n) if n else (0, 0)
    return _held(values, dtype, [i // size for i in range(n)], tuple(divisions), _spark(spark))


def from_numpy(array: Any, chunks: int | tuple[int, ...] | None = None, spark: SparkSession | None = None) -> Array:
    """A NumPy array, or one in chunks along its first axis."""
    import numpy as np

    array = np.asarray(array)
    flat = pa.array(array.reshape(-1))
    for n in reversed(array.shape[1:]):
        flat = pa.FixedSizeListArray.from_arrays(flat, n).cast(pa.list_(flat.type))
    if chunks is None or isinstance(chunks, int):
        return from_rows(flat, -(-len(array) // chunks) if chunks else 1, spark=spark)
    from pyspark.sql.pandas.types import from_arrow_type

    if sum(chunks) != len(array):
        raise ValueError("from_numpy: the chunks don't sum up to the length")
    parts = [i for i, c in enumerate(chunks) for _ in range(c)]
    return _held(flat, from_arrow_type(flat.type), parts, tuple(itertools.accumulate(chunks, initial=0)), _spark(spark))


def from_map(func: Callable, *iterables: Any, args: tuple | None = None, label: str | None = None, token: str | None = None, divisions: tuple | None = None, meta: Any = None, report: bool = False, allowed_exceptions: tuple = (OSError,), spark: SparkSession | None = None, **kwargs: Any) -> Any:
    """A partition for each item: the rows that func(item, *args, **kwargs) gives, on the executors. meta: Spark's type of a
    row, or its text; without it func is called on the first item, on the driver. report: also a DataFrame with a row for
    each item (columns args, kwargs, exception, message); an item whose call raises one of allowed_exceptions has no rows."""
    spark = _spark(spark)
    items = [list(i) for i in iterables]
    if not items:
        raise ValueError("from_map: at least one iterable is needed")
    if len({len(i) for i in items}) > 1:
        raise ValueError("from_map: the iterables' lengths differ")
    if not items[0]:
        raise ValueError("from_map: the iterables are empty")
    calls = list(zip(*items))
    more = tuple(args or ())
    if divisions is not None and len(divisions) != len(calls) + 1:
        raise ValueError("from_map: there is one division more than items")
    if meta is None:
        from pyspark.sql.pandas.types import from_arrow_type

        meta = from_arrow_type(_arrow(func(*calls[0], *more, **kwargs)).type)
    dtype = T._parse_datatype_string(meta) if isinstance(meta, str) else meta
    n = len(calls)
    shared = spark.sparkContext.broadcast(calls) if n > 1000 else None
    schema = T.StructType([T.StructField("value", dtype), T.StructField("__rt_part", T.IntegerType()), T.StructField("__rt_at", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                try:
                    got = _arrow(func(*(shared.value if shared else calls)[i], *more, **kwargs))
                except allowed_exceptions:
                    if not report:
                        raise
                    continue
                k = len(got)
                yield from pa.Table.from_arrays([got.cast(arrow.field(0).type), pa.array([i] * k, pa.int32()), pa.array(range(k), pa.int64())], schema=arrow).to_batches()

    ids = spark.range(0, n, 1, n)
    df = ids.mapInArrow(run, schema)
    frame = Frame(df, ("__rt_part", "__rt_at"), part="__rt_part", divisions=tuple(divisions) if divisions else None, parts=n)
    array = Array(frame, of_type(F.col("value"), dtype))
    if not report:
        return array

    def tried(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                error = message = None
                try:
                    func(*(shared.value if shared else calls)[i], *more, **kwargs)
                except allowed_exceptions as e:
                    error, message = type(e).__name__, str(e)
                rows.append((i, json.dumps([str(x) for x in (*calls[i], *more)]), json.dumps({k: str(v) for k, v in kwargs.items()}), error, message))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.string()) for k in range(5)], ["item", "args", "kwargs", "exception", "message"])

    return array, ids.mapInArrow(tried, "item long, args string, kwargs string, exception string, message string")


def _arrow(x: Any) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x if isinstance(x, pa.Array) else pa.array(x)


def from_delayed(source: list[Callable[[], Any]], meta: Any = None, divisions: tuple | None = None, prefix: str = "from-delayed", spark: SparkSession | None = None) -> Array:
    """A partition for each callable, which gives its rows when a task calls it."""
    source = [source] if callable(source) else list(source)
    return from_map(_call, source, meta=meta, divisions=divisions, spark=spark)


def _call(fn: Callable[[], Any]) -> Any:
    return fn()
