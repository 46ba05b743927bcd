"""What an array is over its frame: a plain column under some list levels, or a record whose fields are such values.

A record is kept as a bundle of its fields, each a column with all list levels of its own. Field access is then a choice
of column, and what is read from Parquet are the leaves in use; a struct is put together only where it is given out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_fresh = itertools.count()


def fresh(depth: int) -> tuple:
    return tuple(("new", next(_fresh)) for _ in range(depth))


@dataclass(frozen=True)
class Leaf:
    """col under depth list levels; skel: for each level a mark that equal list structures share; dtype: of col."""

    col: Column
    depth: int = 0
    skel: tuple = ()
    dtype: T.DataType | None = None
    attrs: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Rec:
    """A record under depth list levels. origin: the column it came from, while it is unchanged."""

    depth: int
    fields: dict[str, Value]
    skel: tuple = ()
    origin: Column | None = None
    attrs: dict = field(default_factory=dict)


Value = Leaf | Rec


def is_tuple(value: Rec) -> bool:
    return bool(value.fields) and list(value.fields) == [str(i) for i in range(len(value.fields))]


def _field(col: Column, name: str, depth: int) -> Column:
    return col.getField(name) if depth < 2 else F.transform(col, lambda v: _field(v, name, depth - 1))


def of_type(col: Column, dtype: T.DataType, outer: int = 0, path: str = "", skel: tuple = (), attrs: dict | None = None) -> Value:
    """The value of a column; outer: list levels that are not in dtype, as they belong to a record around it."""
    depth, inner = outer, dtype
    while isinstance(inner, T.ArrayType):
        inner, depth = inner.elementType, depth + 1
    path = path or f"@{next(_fresh)}"
    skel = skel + tuple((path, i) for i in range(len(skel), depth))
    if isinstance(inner, T.StructType):
        fields = {f.name: of_type(_field(col, f.name, depth), f.dataType, depth, f"{path}.{f.name}", skel, dict(f.metadata or {})) for f in inner.fields}
        return Rec(depth, fields, skel, col, attrs or {})
    whole = dtype
    for _ in range(outer):
        whole = T.ArrayType(whole)
    return Leaf(col, depth, skel, whole, attrs or {})


def zipped(depth: int, cols: dict[str, Column]) -> Column:
    """Structs of columns that share depth list levels."""
    if depth == 0:
        return F.struct(*[c.alias(n) for n, c in cols.items()])
    whole = F.arrays_zip(*[c.alias(n) for n, c in cols.items()])
    return whole if depth == 1 else F.transform(whole, lambda z: zipped(depth - 1, {n: z.getField(n) for n in cols}))


def column(value: Value) -> Column:
    """The value as one column."""
    if isinstance(value, Leaf):
        return value.col
    if value.origin is not None:
        return value.origin
    if not value.fields:
        raise ValueError("a record without fields can't be given out")
    return zipped(value.depth, {n: column(v) for n, v in value.fields.items()})


def leaves(value: Value) -> list[Leaf]:
    return [value] if isinstance(value, Leaf) else [x for v in value.fields.values() for x in leaves(v)]


def thinnest(value: Value, depth: int | None = None) -> Column:
    """The cheapest column that has the value's list levels: no text, and as few further levels as may be."""
    own = [x for x in leaves(value) if x.depth >= (value.depth if depth is None else depth)]
    return min(own, key=lambda x: (x.depth, isinstance(scalar_type(x.dtype), (T.StringType, T.BinaryType)))).col


def scalar_type(dtype: T.DataType | None) -> T.DataType | None:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype


def mapped(value: Value, fn: Callable[[Column], Column], change: int = 0, skel: tuple | None = None) -> Value:
    """fn on every leaf, where fn moves whole list elements about and never looks inside: a record stays a bundle.
    change: by how many list levels the result is deeper. skel: marks of the changed levels (else new ones)."""
    depth = value.depth + change
    skel = fresh(depth) if skel is None else skel
    if isinstance(value, Leaf):
        dtype = value.dtype
        for _ in range(max(0, change)):
            dtype = dtype and T.ArrayType(dtype)
        for _ in range(max(0, -change)):
            dtype = dtype and dtype.elementType
        return Leaf(fn(value.col), depth, skel, dtype, value.attrs)
    fields = {n: mapped(v, fn, change, skel + v.skel[value.depth :]) for n, v in value.fields.items()}
    return Rec(depth, fields, skel, None, value.attrs)


def rebuilt(value: Value, name: Callable[[Leaf], Column]) -> Value:
    """The same tree over other columns: of a frame made from this one."""
    if isinstance(value, Leaf):
        return replace(value, col=name(value))
    return replace(value, fields={n: rebuilt(v, name) for n, v in value.fields.items()}, origin=None)


def _computed(col: Column) -> bool:
    """Whether working the column out takes more than looking it up."""
    return "(" in str(col).replace("namedlambdavariable()", "")


def let(cols: list[Column], fn: Callable[..., Column]) -> Column:
    """fn of columns that it may use any number of times, in lambdas too: each is worked out once for a row. (Spark would
    work out a column that a lambda uses again for every element.)"""
    at = [i for i, c in enumerate(cols) if _computed(c)]
    if not at:
        return fn(*cols)
    if len(at) == 1:
        return F.get(F.transform(F.array(cols[at[0]]), lambda v: fn(*[v if i == at[0] else c for i, c in enumerate(cols)])), F.lit(0))
    bound = F.array(F.struct(*[cols[i].alias(f"c{i}") for i in at]))
    return F.get(F.transform(bound, lambda s: fn(*[s.getField(f"c{i}") if i in at else c for i, c in enumerate(cols)])), F.lit(0))


def once(fn: Callable[..., Column]) -> Callable[..., Column]:
    """fn with its columns bound by let()."""
    return lambda *cols: let(list(cols), fn)


def lift(fn: Callable[..., Column], cols: list[Column], depths: list[int], marks: list[tuple] | None = None) -> Column:
    """fn below the list levels, the outermost first: a column without further levels is repeated in the others' lists.
    Lists zipped with one another must have equal lengths, which is checked unless their marks say so."""
    deep = [i for i, d in enumerate(depths) if d > 0]
    if not deep:
        return fn(*cols)
    marks = marks or [()] * len(cols)
    alike = [bool(marks[deep[0]] and marks[i] and marks[deep[0]][0] == marks[i][0]) for i in deep]
    # What lambdas below capture, and lists whose lengths are compared, are worked out once.
    bound = [i for i in range(len(cols)) if (i not in deep or not all(alike)) and _computed(cols[i])]
    if bound:
        return let([cols[i] for i in bound], lambda *vs: lift(fn, [vs[bound.index(i)] if i in bound else c for i, c in enumerate(cols)], depths, marks))

    def at(values: dict[int, Column]) -> Column:
        down = [values.get(i, c) for i, c in enumerate(cols)]
        return lift(fn, down, [d - (i in values) for i, d in enumerate(depths)], [m[1:] if i in values else m for i, m in enumerate(marks)])

    if len(deep) == 1:
        return F.transform(cols[deep[0]], lambda v: at({deep[0]: v}))
    first = deep[0]
    if len(deep) == 2:
        out = F.zip_with(cols[deep[0]], cols[deep[1]], lambda a, b: at({deep[0]: a, deep[1]: b}))
    else:
        whole = F.arrays_zip(*[cols[i].alias(f"c{i}") for i in deep])
        out = F.transform(whole, lambda z: at({i: z.getField(f"c{i}") for i in deep}))
    for other, same in zip(deep[1:], alike[1:], strict=True):
        if not same:
            out = F.when(F.size(cols[first]) != F.size(cols[other]), F.raise_error(F.lit("lists of different lengths can't be broadcast together"))).otherwise(out)
    return out


def below(fn: Callable[[Column], Column], col: Column, levels: int) -> Column:
    """fn on what lies below so many list levels."""
    return fn(col) if levels <= 0 else F.transform(col, lambda v: below(fn, v, levels - 1))
