"""Array, Record and Scalar: lazy values over a Frame."""

from __future__ import annotations

import enum
import numbers
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators import behavior as behaviors
from ragtide.operators.frame import HIDDEN, Frame, hidden
from ragtide.operators.node import Leaf, Rec, Value, below, column, fresh, is_tuple, leaves, lift, mapped, of_type, once, rebuilt, scalar_type


class ConcretizationTypeError(TypeError):
    """A lazy value was used where a concrete one is needed."""

    def __init__(self, what: str):
        super().__init__(f"{what} is lazy and has no concrete value yet; call compute() first")


class IncompatiblePartitions(ValueError):
    """Arrays whose rows can't be put side by side."""

    def __init__(self, name: str, *arrays):
        super().__init__(f"{name}: the arrays' partitions or lengths differ: {', '.join(str(a.frame.divisions) for a in arrays)}")


class PartitionCompatibility(enum.IntEnum):
    """Whether arrays' rows lie side by side: not, perhaps (not yet counted), surely."""

    NO = 0
    MAYBE = 1
    YES = 2


def plain(value: Any) -> Any:
    """Spark's rows as dictionaries, tuples, lists and scalars."""
    if isinstance(value, T.Row):
        names = value.__fields__
        if names == [str(i) for i in range(len(names))]:
            return tuple(plain(v) for v in value)
        return {n: plain(v) for n, v in zip(names, value)}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


class Scalar:
    """A lazy value: the column of a one-row DataFrame, or a known value."""

    def __init__(self, df: DataFrame | None, name: str = "value", known: Any = None, dtype: T.DataType | None = None):
        self.df, self.name, self._known, self._dtype = df, name, known, dtype

    @classmethod
    def from_known(cls, value: Any, dtype: T.DataType | None = None) -> Scalar:
        return cls(None, known=value, dtype=dtype)

    @property
    def is_known(self) -> bool:
        return self.df is None

    @property
    def known_value(self) -> Any:
        if not self.is_known:
            raise TypeError("this scalar's value isn't known yet")
        return self._known

    @property
    def dtype(self) -> T.DataType:
        if self.is_known:
            return self._dtype or T._infer_type(self._known)
        return self.df.schema[self.name].dataType

    def expr(self) -> Column:
        """For use in other queries: a literal, or a subquery that gives one row."""
        if self.is_known:
            return F.lit(self._known) if self._dtype is None else F.lit(self._known).cast(self._dtype)
        return self.df.select(self.name).scalar()

    def to_spark(self, spark=None) -> DataFrame:
        if self.is_known:
            from pyspark.sql import SparkSession

            spark = spark or SparkSession.active()
            return spark.range(1).select(self.expr().alias("value"))
        return self.df.select(F.col(self.name).alias("value"))

    def compute(self) -> Any:
        return self._known if self.is_known else plain(self.df.select(self.name).first()[0])

    def to_delayed(self) -> Callable[[], Any]:
        return self.compute

    def _with(self, fn: Callable, other: Any) -> Scalar:
        if isinstance(other, Array | Record):
            return NotImplemented
        if self.is_known and not isinstance(other, Scalar):
            other = Scalar.from_known(other)
        if self.is_known and (other is None or other.is_known):
            from pyspark.sql import SparkSession

            one = SparkSession.active().range(1)
        else:
            one = (self.df if not self.is_known else other.df).sparkSession.range(1)
        right = other.expr() if isinstance(other, Scalar) else None if other is None else F.lit(other)
        return Scalar(one.select(fn(self.expr(), right).alias("value")))

    def _refuse(self, *_):
        raise ConcretizationTypeError("a Scalar")

    __bool__ = __int__ = __float__ = __complex__ = __index__ = _refuse

    def __repr__(self) -> str:
        return f"ragtide.Scalar<{'known ' + repr(self._known) if self.is_known else self.name}, type={self.dtype.simpleString()}>"


class Mask:
    """array.mask[selection]: as many rows, with None where the selection is false."""

    def __init__(self, array: Array):
        self.array = array

    def __getitem__(self, where: Array) -> Array:
        from ragtide.operators.structure import mask

        return mask(self.array, where)


class Partitions:
    """array.partitions[i], or a slice of partitions."""

    def __init__(self, array: Array):
        self.array = array

    def __getitem__(self, index: int | slice) -> Array:
        frame = self.array.frame
        n, part = frame.npartitions, frame.parted()
        chosen = range(n)[index]
        if isinstance(chosen, int):
            out = frame.derived(frame.df.where(F.col(part) == chosen).withColumn(part, F.lit(0)), parts=1)
            if frame.divisions is not None:
                out.divisions = (0, frame.divisions[chosen + 1] - frame.divisions[chosen])
        else:
            df = frame.df.where(F.col(part).isin(list(chosen)))
            out = frame.derived(df.withColumn(part, ((F.col(part) - chosen.start) / chosen.step).cast("int") if len(chosen) else F.col(part)), parts=max(1, len(chosen)))
        return self.array.over(out)


class Array:
    """A lazy, partitioned array of nested lists and records: a value over a frame."""

    __slots__ = ("frame", "node")
    __array_priority__ = 1000

    def __init__(self, frame: Frame, node: Value):
        object.__setattr__(self, "frame", frame)
        object.__setattr__(self, "node", node)

    # What it is.
    @property
    def depth(self) -> int:
        return self.node.depth

    @property
    def ndim(self) -> int:
        return self.node.depth + 1

    @property
    def col(self) -> Column:
        return column(self.node)

    @property
    def dtype(self) -> T.DataType:
        """Spark's type of a row."""
        if isinstance(self.node, Leaf) and self.node.dtype is not None:
            return self.node.dtype
        out = self.frame.df.select(self.col.alias("v")).schema[0].dataType
        if isinstance(self.node, Leaf):
            object.__setattr__(self, "node", Leaf(self.node.col, self.node.depth, self.node.skel, out, self.node.attrs))
        return out

    @property
    def scalar_type(self) -> T.DataType:
        return scalar_type(self.dtype)

    @property
    def type(self) -> str:
        return f"?? * {self.dtype.simpleString()}"

    @property
    def form(self) -> dict:
        return self.dtype.jsonValue() if isinstance(self.dtype, T.ArrayType | T.StructType) else {"type": self.dtype.simpleString()}

    layout = form

    @property
    def fields(self) -> list[str]:
        return list(self.node.fields) if isinstance(self.node, Rec) else []

    @property
    def attrs(self) -> dict:
        return dict(self.node.attrs.get("attrs", {}))

    @property
    def parameters(self) -> dict:
        return {k: v for k, v in self.node.attrs.items() if k not in ("attrs", "record")}

    @property
    def record_name(self) -> str | None:
        return self.node.attrs.get("record")

    @property
    def behavior(self) -> dict:
        return behaviors.registered()

    @property
    def mask(self) -> Mask:
        return Mask(self)

    # Partitions.
    @property
    def npartitions(self) -> int:
        return self.frame.npartitions

    @property
    def divisions(self) -> tuple:
        return self.frame.divisions or (None,) * (self.npartitions + 1)

    @property
    def known_divisions(self) -> bool:
        return self.frame.divisions is not None

    @property
    def defined_divisions(self) -> tuple:
        return self.eager_compute_divisions() or self.frame.divisions

    def eager_compute_divisions(self) -> None:
        self.frame.compute_divisions()

    def clear_divisions(self) -> None:
        self.frame.divisions = None

    def reset_meta(self) -> None:
        """The schema belongs to the plan: nothing to forget but the cached type."""
        if isinstance(self.node, Leaf):
            object.__setattr__(self, "node", Leaf(self.node.col, self.node.depth, self.node.skel, None, self.node.attrs))

    @property
    def partitions(self) -> Partitions:
        return Partitions(self)

    def repartition(self, npartitions=None, divisions=None, rows_per_partition=None, one_to_n=None, n_to_one=None) -> Array:
        from ragtide.operators.rows import repartition

        return repartition(self, npartitions, divisions, rows_per_partition, one_to_n, n_to_one)

    # Making further arrays.
    def over(self, frame: Frame) -> Array:
        """The same expression over a frame that has this one's columns."""
        return Array(frame, self.node)

    def of(self, value: Value) -> Array:
        return Array(self.frame, value)

    def leaf(self, col: Column, depth: int, skel: tuple | None = None, dtype: T.DataType | None = None) -> Array:
        return Array(self.frame, Leaf(col, depth, fresh(depth) if skel is None else skel, dtype))

    def moved(self, fn: Callable[[Column], Column], level: int, change: int = 0, keep: bool = False) -> Array:
        """fn, which moves elements about, on the lists below `level` levels."""
        v = self.node
        skel = v.skel if keep else v.skel[:level] + fresh(v.depth + change - level)
        return self.of(mapped(v, lambda c: below(once(fn), c, level), change, skel))

    # Access.
    def __getitem__(self, where: Any) -> Any:
        from ragtide.operators.indexing import getitem

        return getitem(self, where)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        if isinstance(self.node, Rec) and name in self.node.fields:
            return self.field(name)
        found = behaviors.lookup(self.record_name, name)
        if found is not None:
            return found(self)
        raise AttributeError(f"no field or behavior named {name!r}; fields: {self.fields}")

    def __dir__(self) -> list[str]:
        return [*super().__dir__(), *self.fields, *behaviors.names(self.record_name)]

    def __setattr__(self, name: str, what: Any) -> None:
        if name in Array.__slots__ or isinstance(getattr(type(self), name, None), property):
            object.__setattr__(self, name, what)
        else:
            raise AttributeError(f"use array[{name!r}] = ... to set a field")

    def field(self, name: str) -> Array:
        if not isinstance(self.node, Rec) or name not in self.node.fields:
            raise KeyError(f"no field {name!r}; fields: {self.fields}")
        return self.of(self.node.fields[name])

    def __setitem__(self, where: str, what: Any) -> None:
        from ragtide.operators.structure import with_field

        if not isinstance(where, str | tuple | list) or isinstance(where, list | tuple) and not all(isinstance(x, str) for x in where):
            raise TypeError("only fields can be set, by their names")
        if not isinstance(what, Array | Scalar | numbers.Number):
            raise TypeError("a field is set to an array or a number")
        new = with_field(self, what, where)
        object.__setattr__(self, "frame", new.frame)
        object.__setattr__(self, "node", new.node)

    def __delitem__(self, where: str | list[str]) -> None:
        from ragtide.operators.structure import without_field

        if not isinstance(where, str | list | tuple):
            raise TypeError("only fields can be deleted, by their names")
        object.__setattr__(self, "node", without_field(self, where).node)

    def _refuse(self, *_):
        raise ConcretizationTypeError("an Array")

    __bool__ = __int__ = __float__ = __complex__ = __index__ = _refuse

    def __iter__(self):
        raise NotImplementedError("a lazy array can't be iterated over; compute() it, or use to_local_iterator()")

    def __array__(self, *_, **__):
        raise NotImplementedError("a lazy array can't become a NumPy array; use to_numpy()")

    def __len__(self) -> int:
        if self.frame.divisions is None:
            raise TypeError("the length isn't known: call eager_compute_divisions(), or num(array, axis=0) for a lazy one")
        return self.frame.divisions[-1]

    def __repr__(self) -> str:
        return f"ragtide.Array<{self.record_name or 'array'}, type={self.type!r}>"

    # Giving out.
    def to_spark(self, name: str = "value", keep_order: bool = False) -> DataFrame:
        """A DataFrame with one column, or one for each field of an outermost record."""
        df = self.frame.sorted() if keep_order else self.frame.df
        if isinstance(self.node, Rec) and self.node.depth == 0 and not is_tuple(self.node):
            return df.select(*[column(v).alias(n, metadata=metadata(v)) for n, v in self.node.fields.items()])
        return df.select(self.col.alias(name, metadata=metadata(self.node)))

    def compute(self) -> list:
        """All rows, in order, as Python values."""
        df = self.frame.sorted().select(self.col.alias("value"))
        return [plain(r[0]) for r in df.collect()]

    to_list = compute

    def persist(self) -> Array:
        """Keeps what this array reads in memory, or on disk where it doesn't fit."""
        kept = carried(self, lambda df: df.persist())
        kept.frame.divisions = self.frame.divisions
        return kept

    def explain(self, mode: str = "formatted") -> None:
        self.to_spark().explain(mode=mode)

    visualize = explain

    def head(self, nrow: int = 10, compute: bool = True) -> Any:
        out = self[:nrow]
        return out.compute() if compute else out

    def to_local_iterator(self) -> Iterable:
        return (plain(r[0]) for r in self.frame.sorted().select(self.col.alias("value")).toLocalIterator())

    # Element-wise operators come from ragtide.functions.ufuncs.
    def __array_ufunc__(self, ufunc, method: str, *inputs, **kwargs):
        from ragtide.functions.ufuncs import by_name

        if method != "__call__":
            raise NotImplementedError(f"{ufunc.__name__}.{method} isn't an element-wise call")
        if kwargs:
            raise NotImplementedError(f"{ufunc.__name__} takes no options here: {', '.join(kwargs)}")
        return by_name(ufunc.__name__)(*inputs)


class Record:
    """One lazy row that is a record."""

    def __init__(self, frame: Frame, node: Rec):
        self.frame, self.node = frame, node

    @property
    def fields(self) -> list[str]:
        return list(self.node.fields)

    def __getitem__(self, where: Any) -> Any:
        if isinstance(where, tuple):
            out = self
            for w in where:
                out = out[w]
            return out
        if isinstance(where, list):
            return Record(self.frame, Rec(0, {n: self.node.fields[n] for n in where}, (), None, self.node.attrs))
        if not isinstance(where, str):
            raise TypeError("a record is indexed by field names")
        if where not in self.node.fields:
            raise KeyError(where)
        return single(Array(self.frame, self.node.fields[where]))

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") or name in ("frame", "node"):
            raise AttributeError(name)
        if name in self.node.fields:
            return self[name]
        found = behaviors.lookup(self.node.attrs.get("record"), name)
        if found is None:
            raise AttributeError(name)
        out = found(Array(self.frame, self.node))
        return single(out) if isinstance(out, Array) else lambda *a, **k: single(out(*a, **k))

    def __iter__(self):
        raise NotImplementedError("a lazy record can't be iterated over")

    def to_spark(self) -> DataFrame:
        return Array(self.frame, self.node).to_spark()

    def compute(self) -> Any:
        rows = Array(self.frame, self.node).compute()
        return rows[0] if rows else None

    def __repr__(self) -> str:
        return f"ragtide.Record<{', '.join(self.fields)}>"


def single(array: Array) -> Array | Record | Scalar:
    """What a one-row array's only row is. A list becomes an array of its elements."""
    if array.depth:
        return exploded(array)
    if isinstance(array.node, Rec):
        return Record(array.frame, array.node)
    name = hidden("v")
    return Scalar(array.frame.df.select(array.col.alias(name)), name)


def metadata(value: Value) -> dict:
    return {k: v for k, v in value.attrs.items() if v is not None}


def from_dataframe(df: DataFrame, columns: list[str] | None = None, order_by: str | list[str] | None = None) -> Array:
    """An array of a DataFrame's rows, as records. order_by: columns that order the rows."""
    columns = columns or [c for c in df.columns if not c.startswith(HIDDEN)]
    order = (order_by,) if isinstance(order_by, str) else tuple(order_by or ())
    names = [hidden("o") for _ in order]
    frame = Frame(df.withColumns({n: F.col(o) for n, o in zip(names, order)}) if order else df, tuple(names))
    return over_columns(frame, columns)


def over_columns(frame: Frame, columns: list[str]) -> Array:
    schema = frame.df.schema
    fields = {c: of_type(F.col(f"`{c}`"), schema[c].dataType, 0, f"{id(frame)}.{c}", (), dict(schema[c].metadata or {})) for c in columns}
    return Array(frame, Rec(0, fields))


def carried(array: Array, change: Callable[[DataFrame], DataFrame], *, extra: dict[str, Column] | None = None, order: tuple[str, ...] | None = None) -> Array:
    """The array over a frame that has its leaves as columns of their own, changed by a DataFrame function."""
    frame = array.frame
    names = {id(x): hidden("c") for x in leaves(array.node)}
    keep = [*frame.ordered(), *([frame.part] if frame.part else [])]
    # A record's own nulls are kept where it is still as it was read.
    df = frame.df.select(*keep, *[x.col.alias(names[id(x)]) for x in leaves(array.node)], *[c.alias(n) for n, c in (extra or {}).items()])
    out = frame.derived(change(df), order)
    return Array(out, rebuilt(array.node, lambda x: F.col(names[id(x)])))


def exploded(array: Array, outer: bool = False, keep: tuple[str, ...] = (), ordered: bool = True) -> Array:
    """A row for each element of the outermost lists; null lists give none (with outer: a row of null). ordered: False if
    nobody will ask for the rows' order."""
    at = hidden("at")
    frame, v = array.frame, array.node
    names = {id(x): hidden("c") for x in leaves(v)}
    order = frame.ordered() if ordered else ()
    df = frame.df.select(*order, *keep, *([frame.part] if frame.part else []), *[x.col.alias(names[id(x)]) for x in leaves(v)])
    cols = list(names.values())
    rest = [c for c in df.columns if c not in cols]
    item = hidden("e")
    how = F.posexplode_outer if outer else F.posexplode
    if len(cols) == 1:
        df = df.select(*rest, how(cols[0]).alias(at, item)).withColumnRenamed(item, cols[0])
    else:
        df = df.select(*rest, how(F.arrays_zip(*cols)).alias(at, item)).select(*rest, at, *[F.col(item).getField(c).alias(c) for c in cols])

    def inner(x: Value) -> Value:
        if isinstance(x, Leaf):
            return Leaf(F.col(names[id(x)]), x.depth - 1, x.skel[1:], x.dtype.elementType if isinstance(x.dtype, T.ArrayType) else None, x.attrs)
        return Rec(x.depth - 1, {n: inner(y) for n, y in x.fields.items()}, x.skel[1:], None, x.attrs)

    return Array(frame.derived(df, (*order, at), inner=frame.inner + 1 if order else 0), inner(v))


def aligned(*items: Any, name: str = "operation") -> tuple[Frame, list]:
    """The arrays among items over one frame, side by side; scalars as columns of it."""
    arrays = [x for x in items if isinstance(x, Array)]
    if not arrays:
        raise TypeError(f"{name}: at least one lazy array is needed")
    frame = arrays[0].frame
    others = {id(a.frame): a.frame for a in arrays if a.frame is not frame}
    if others:
        items, frame = side_by_side(list(items), name)
    return frame, [x if not isinstance(x, Scalar) or x.is_known else Array(frame, Leaf(frame.bind(x.expr()), 0, (), x.dtype)) for x in items]


def side_by_side(items: list, name: str) -> tuple[list, Frame]:
    """Arrays of several frames joined by row number. Rows that the other frames lack raise an error when it runs."""
    arrays = [x for x in items if isinstance(x, Array)]
    if compatibility(*arrays) == PartitionCompatibility.NO:
        raise IncompatiblePartitions(name, *arrays)
    frames = list({id(a.frame): a.frame for a in arrays}.values())
    row, made, df = hidden("row"), {}, None
    for frame in frames:
        own = frame.ranked()
        mine = [a for a in arrays if a.frame is frame]
        names = {id(x): hidden("c") for a in mine for x in leaves(a.node)}
        cols = {names[id(x)]: x.col for a in mine for x in leaves(a.node)}
        there = hidden("there")
        part = frame.df.select(F.col(own).alias(row), *[c.alias(n) for n, c in cols.items()], F.lit(True).alias(there), *([F.col(frame.part).alias("__rt_part")] if frame.part and df is None else []))
        df = part if df is None else df.join(part, row, "full")
        made.update({id(a): rebuilt(a.node, lambda x, names=names: F.col(names[id(x)])) for a in mine})
        if frame is not frames[0]:
            checked = F.when(F.col(there) & F.col(first), F.col(row)).otherwise(F.raise_error(F.lit(f"{name}: the arrays' lengths differ")).cast("bigint"))
            df = df.withColumn(row, checked).drop(there)
        else:
            first = there
    out = Frame(df, (row,), row=row, part="__rt_part" if "__rt_part" in df.columns else None, divisions=next((f.divisions for f in frames if f.divisions), None), parts=frames[0]._parts)
    return [Array(out, made[id(x)]) if isinstance(x, Array) else x for x in items], out


def compatibility(*arrays: Array) -> PartitionCompatibility:
    """Whether the arrays' rows lie side by side, as far as is known without counting."""
    frames = list({id(a.frame): a.frame for a in arrays}.values())
    if len(frames) == 1:
        return PartitionCompatibility.YES
    if len({f._parts if f.divisions is None else len(f.divisions) - 1 for f in frames if f._parts or f.divisions}) > 1:
        return PartitionCompatibility.NO
    known = {f.divisions for f in frames if f.divisions is not None}
    if len(known) > 1:
        return PartitionCompatibility.NO
    return PartitionCompatibility.YES if all(f.divisions is not None for f in frames) else PartitionCompatibility.MAYBE


def partition_compatibility(*arrays: Array) -> PartitionCompatibility:
    return compatibility(*arrays)


def compatible_partitions(*arrays: Array, how_strict: PartitionCompatibility = PartitionCompatibility.MAYBE) -> bool:
    return compatibility(*arrays) >= how_strict


def elementwise(fn: Callable[..., Column], *items: Any, name: str = "operation", dtype: T.DataType | None = None) -> Array:
    """fn on single values, with lists of less depth (and plain values) broadcast into deeper ones."""
    frame, items = aligned(*items, name=name)
    cols, depths, marks = [], [], []
    for x in items:
        if isinstance(x, Array):
            if isinstance(x.node, Rec):
                raise TypeError(f"{name} isn't defined for records; fields: {x.fields}")
            cols.append(x.node.col)
            depths.append(x.depth)
            marks.append(x.node.skel)
        else:
            cols.append(x if isinstance(x, Column) else x.expr() if isinstance(x, Scalar) else F.lit(x))
            depths.append(0)
            marks.append(())
    deepest = depths.index(max(depths))
    skel = marks[deepest]
    whole = dtype
    for _ in range(depths[deepest] if dtype is not None else 0):
        whole = T.ArrayType(whole)
    return Array(frame, Leaf(lift(fn, cols, depths, marks), depths[deepest], skel, whole))


def axis_level(array: Array, axis: int, what: str = "axis") -> int:
    """A non-negative axis."""
    out = axis + array.ndim if axis < 0 else axis
    if not 0 <= out < array.ndim:
        raise ValueError(f"{what} {axis} is beyond the {array.ndim} dimensions")
    return out


def _binary(name: str, flip: bool = False):
    def op(self, other):
        from ragtide.functions.ufuncs import by_name

        if isinstance(self, Scalar):
            if isinstance(other, Array):
                return by_name(name)(other, self) if flip else by_name(name)(self, other)
            kernel = by_name(name).kernel
            return self._with((lambda a, b: kernel(b, a)) if flip else kernel, other if isinstance(other, Scalar) else Scalar.from_known(other))
        return by_name(name)(other, self) if flip else by_name(name)(self, other)

    return op


def _unary(name: str):
    def op(self):
        from ragtide.functions.ufuncs import by_name

        if isinstance(self, Scalar):
            return self._with(lambda a, _: by_name(name).kernel(a), None)
        return by_name(name)(self)

    return op


_OPERATORS = {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "true_divide", "floordiv": "floor_divide", "mod": "mod", "pow": "power", "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "left_shift", "rshift": "right_shift"}
for _short, _long in _OPERATORS.items():
    for _cls in (Array, Scalar):
        setattr(_cls, f"__{_short}__", _binary(_long))
        setattr(_cls, f"__r{_short}__", _binary(_long, flip=True))
for _short, _long in {"eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal"}.items():
    for _cls in (Array, Scalar):
        setattr(_cls, f"__{_short}__", _binary(_long))
for _short, _long in {"neg": "negative", "pos": "positive", "abs": "absolute", "invert": "invert"}.items():
    for _cls in (Array, Scalar):
        setattr(_cls, f"__{_short}__", _unary(_long))
Array.__hash__ = Scalar.__hash__ = object.__hash__
