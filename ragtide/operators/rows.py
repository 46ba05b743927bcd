"""Operators on whole rows: appending, repartitioning, sampling, functions over partitions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.array import Array, aligned
from ragtide.operators.frame import Frame, hidden
from ragtide.operators.node import Leaf, Rec, column, fresh, lift, of_type

#: Spark's partitions that rows are dealt to at most, unless its shuffles have more.
MANY = 1000


def concatenate(arrays: list[Array], axis: int = 0, mergebool: bool = True) -> Array:
    """axis 0: the rows of one array after those of another; numbers are widened, fields that one lacks are missing.
    Else: lists joined to lists. mergebool: truth values beside numbers count as 0 and 1; without it they are refused."""
    arrays = list(arrays)
    if not arrays or not all(isinstance(a, Array) for a in arrays):
        raise TypeError("concatenate: lazy arrays are needed")
    if axis < 0:
        raise NotImplementedError("concatenate isn't defined for negative axes")
    kinds = {isinstance(a.scalar_type, T.BooleanType) for a in arrays if not a.fields}
    merge = len(kinds) == 2
    if merge and not mergebool:
        raise TypeError("concatenate: truth values and numbers aren't merged with mergebool=False")
    if merge:
        from ragtide.operators.structure import values_astype

        arrays = [values_astype(a, T.IntegerType()) if isinstance(a.scalar_type, T.BooleanType) else a for a in arrays]
    if axis == 0:
        return _append(arrays)
    frame, arrays = aligned(*arrays, name="concatenate")
    if any(a.depth < axis for a in arrays):
        raise ValueError(f"concatenate: axis {axis} is beyond an array's dimensions")

    def joined(values: list) -> Any:
        first = values[0]
        if isinstance(first, Leaf):
            col = lift(lambda *c: F.concat(*c), [v.col for v in values], [axis - 1] * len(values), [v.skel for v in values])
            return Leaf(col, first.depth, first.skel[: axis - 1] + fresh(first.depth - axis + 1))
        if any(not isinstance(v, Rec) or set(v.fields) != set(first.fields) for v in values):
            raise TypeError("concatenate: the records' fields differ")
        skel = first.skel[: axis - 1] + fresh(first.depth - axis + 1)
        fields = {n: joined([v.fields[n] for v in values]) for n in first.fields}
        fields = {n: type(v)(**{**v.__dict__, "skel": skel + v.skel[first.depth :]}) for n, v in fields.items()}
        return Rec(first.depth, fields, skel, None, first.attrs)

    return Array(frame, joined([a.node for a in arrays]))


def _append(arrays: list[Array]) -> Array:
    """A union of all frames. Each frame keeps its own order columns, behind the number of its array."""
    source, name = hidden("src"), hidden("v")
    whole, order, part, parts = None, [source], hidden("part"), 0
    # Partitions are numbered on where all arrays have them; else they are what Spark makes of the union.
    numbered = all(a.frame.part is not None for a in arrays)
    for k, a in enumerate(arrays):
        own = [(hidden("o"), o) for o in a.frame.ordered()]
        order += [n for n, _ in own]
        cols = [F.lit(k).alias(source), *[F.col(o).alias(n) for n, o in own]]
        if numbered:
            cols.append((F.col(a.frame.part) + parts).cast("int").alias(part))
            parts += a.frame.npartitions
        # A record's fields stay columns of their own, so that the scans below still read only what is used.
        if isinstance(a.node, Rec) and a.depth == 0:
            df = a.frame.df.select(*cols, *[column(v).alias(f"{name}.{n}") for n, v in a.node.fields.items()])
        else:
            df = a.frame.df.select(*cols, a.col.alias(name))
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    frame = Frame(whole, tuple(order), part=part, parts=parts, packed=any(a.frame.packed for a in arrays)) if numbered else Frame(whole, tuple(order))
    if numbered and all(a.frame.divisions is not None for a in arrays):
        out = [0]
        for a in arrays:
            out += [out[-1] + d - c for c, d in zip(a.frame.divisions, a.frame.divisions[1:])]
        frame.divisions = tuple(out)
    schema = whole.schema
    if name in schema.names:
        if any(n.startswith(f"{name}.") for n in schema.names):
            raise TypeError("concatenate: records and plain values")
        return Array(frame, of_type(F.col(name), schema[name].dataType, attrs=arrays[0].node.attrs))
    fields = {n.removeprefix(f"{name}."): of_type(F.col(f"`{n}`"), schema[n].dataType) for n in schema.names if n.startswith(f"{name}.")}
    return Array(frame, Rec(0, fields, (), None, arrays[0].node.attrs))


def repartition(array: Array, npartitions: int | None = None, divisions: Any = None, rows_per_partition: int | None = None, one_to_n: int | None = None, n_to_one: int | None = None) -> Array:
    """The same rows in other partitions; exactly one of the options is given. Rows beyond the last division go."""
    if sum(x is not None for x in (npartitions, divisions, rows_per_partition, one_to_n, n_to_one)) != 1:
        raise ValueError("repartition: exactly one of npartitions, divisions, rows_per_partition, one_to_n, n_to_one")
    frame = array.frame
    if n_to_one is not None:
        if n_to_one < 1:
            raise ValueError("n_to_one is 1 at least")
        part = F.floor(F.col(frame.parted()) / n_to_one).cast("int")
        n = -(-frame.npartitions // n_to_one)
        known = frame.divisions and (*frame.divisions[:-1][::n_to_one], frame.divisions[-1])
        return _dealt(array, part, n, known)
    frame.compute_divisions()
    total = frame.divisions[-1]
    if npartitions is not None:
        size = -(-total // npartitions) if total else 1
        divisions = [min(i * size, total) for i in range(npartitions + 1)]
    elif rows_per_partition is not None:
        divisions = [*range(0, total, rows_per_partition), total]
    elif one_to_n is not None:
        divisions = [0]
        for a, b in zip(frame.divisions, frame.divisions[1:]):
            size = -(-(b - a) // one_to_n) if b > a else 0
            divisions += [min(a + (i + 1) * size, b) for i in range(one_to_n)]
    divisions = list(divisions)
    if len(divisions) < 2 or divisions != sorted(divisions):
        raise ValueError("divisions don't fall and are two at least")
    divisions = [min(d, total) for d in divisions]
    own = frame.ranked()
    row = F.col(own)
    inside = frame.derived(frame.df.where((row >= divisions[0]) & (row < divisions[-1])))
    if divisions[0]:
        own = hidden("row")
        inside.df = inside.df.withColumn(own, row - divisions[0])
    step = _step(divisions)
    if step is not None:
        part = F.floor((row - divisions[0]) / step).cast("int")
    elif len(divisions) < 1000:
        # The last of the divisions that is not beyond the row: a search in a constant list of as many numbers as partitions.
        part = F.size(F.filter(F.lit(divisions[1:]), lambda e: e <= row))
    else:
        raise ValueError("a thousand divisions or more have to be equally long")
    return _dealt(array.over(inside), part, len(divisions) - 1, tuple(d - divisions[0] for d in divisions), own)


def _step(divisions: Any) -> int | None:
    """The length of all partitions up to where the rows run out, if it is one."""
    step = max(1, divisions[1] - divisions[0])
    return step if all(d == min(divisions[0] + i * step, divisions[-1]) for i, d in enumerate(divisions)) else None


def _dealt(array: Array, part: Any, n: int, divisions: tuple | None, row: str | None = None) -> Array:
    """Rows go by their partition's number to one of Spark's, without the sample of all rows that a range partitioning
    takes to the driver. Each task has its cost in the driver: many partitions share one, side by side, and are dealt once
    more where a function or files need them apart."""
    frame, name = array.frame, hidden("part")
    order = frame.ordered()
    most = max(MANY, int(frame.spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.col(name) if n <= most else F.floor(F.col(name).cast("long") * most / n).cast("int")
    df = frame.df.withColumn(name, part).repartitionById(min(n, most), at)
    return Array(Frame(df, order, row=row, part=name, divisions=divisions, parts=n, packed=n > most), array.node)


def sample(arr: Array, factor: int | None = None, probability: float | None = None, seed: int | None = None) -> Array:
    """Every factor-th row of each partition, or rows at random."""
    if (factor is None) == (probability is None):
        raise ValueError("sample: exactly one of factor and probability")
    frame = arr.frame
    if probability is not None:
        frame.ordered()
        return arr.over(frame.derived(frame.df.sample(probability, seed=seed)))
    divisions = frame.compute_divisions()
    row, part = F.col(frame.ranked()), F.col(frame.parted())
    step = _step(divisions)
    first = F.get(F.lit(list(divisions)), part.cast("int")) if step is None else part.cast("long") * step + divisions[0]
    return arr.over(frame.derived(frame.df.where((row - first) % factor == 0)))


def map_partitions(base_fn: Callable, *args: Any, label: str | None = None, token: str | None = None, meta: Any = None, output_divisions: int | None = None, traverse: bool = True, per_batch: bool | None = None, **kwargs: Any) -> Array:
    """A function over the partitions of arrays that lie side by side. It gets pyarrow arrays (a partition's rows, or with
    per_batch those of an Arrow batch, which bounds what a task holds) and gives one, or anything pyarrow makes one of.
    meta: Spark's type of a row, or its text; without it the function is called on arrays of no rows. output_divisions:
    1 if rows stay what they were; the function then gets batches unless per_batch is False. traverse: also look for arrays inside lists, tuples and dictionaries."""
    found: list[Array] = []

    def pack(x: Any) -> Any:
        if isinstance(x, Array):
            found.append(x)
            return _Slot(len(found) - 1)
        if traverse and isinstance(x, list | tuple):
            return type(x)(pack(y) for y in x)
        if traverse and isinstance(x, dict):
            return {k: pack(y) for k, y in x.items()}
        return x

    if per_batch is None:
        per_batch = output_divisions == 1
    packed, named = [pack(a) for a in args], {k: pack(v) for k, v in kwargs.items()}
    if not found:
        raise TypeError("map_partitions: no lazy array among the arguments")
    frame, arrays = aligned(*found, name=label or "map_partitions")
    order, names = frame.ordered(), [hidden("a") for _ in arrays]
    keep = [*order, *([frame.part] if frame.part else [])]
    df = frame.df.select(*keep, *[a.col.alias(n) for a, n in zip(arrays, names)])
    if frame.packed and not per_batch:
        df = df.repartitionById(frame.npartitions, frame.part)

    def call(columns: list) -> pa.Array:
        got = base_fn(*[_unpack(x, columns) for x in packed], **{k: _unpack(x, columns) for k, x in named.items()})
        return got if isinstance(got, pa.Array) else got.combine_chunks() if isinstance(got, pa.ChunkedArray) else pa.array(got)

    if meta is None:
        from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

        meta = from_arrow_type(call([pa.array([], to_arrow_type(df.schema[n].dataType)) for n in names]).type)
    dtype = T._parse_datatype_string(meta) if isinstance(meta, str) else meta
    same = output_divisions == 1
    out_name, at = hidden("v"), hidden("k")
    schema = T.StructType([*(df.schema[k] for k in (keep if same else [])), *([] if same else [T.StructField(at, T.LongType())]), T.StructField(out_name, dtype)])
    ordered = df.sortWithinPartitions(*order) if not same else df

    def run(batches: Any) -> Any:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, done = to_arrow_schema(schema), 0
        groups = ([b] for b in batches) if per_batch else [list(batches)]
        for group in groups:
            if not group:
                continue
            table = pa.Table.from_batches(group)
            columns = [table.column(n).combine_chunks() for n in names]
            got = call(columns)
            if same and len(got) != table.num_rows:
                raise ValueError("the function gave another number of rows, and output_divisions is 1")
            front = [table.column(k).combine_chunks() for k in keep] if same else [pa.array(range(done, done + len(got)), pa.int64())]
            done += len(got)
            made = pa.Table.from_arrays([*front, got], names=[*(keep if same else [at]), out_name]).cast(arrow)
            yield from made.to_batches()

    if same:
        made = ordered.mapInArrow(run, schema)
        out = Frame(made, order, part=frame.part, divisions=frame.divisions, parts=frame._parts, packed=frame.packed and per_batch)
    else:
        made = ordered.mapInArrow(run, schema).withColumn("__rt_pid", F.spark_partition_id())
        out = Frame(made, ("__rt_pid", at))
    return Array(out, of_type(F.col(out_name), dtype))


class _Slot:
    def __init__(self, at: int):
        self.at = at


def _unpack(x: Any, columns: list) -> Any:
    if isinstance(x, _Slot):
        return columns[x.at]
    if isinstance(x, list | tuple):
        return type(x)(_unpack(y, columns) for y in x)
    if isinstance(x, dict):
        return {k: _unpack(y, columns) for k, y in x.items()}
    return x

