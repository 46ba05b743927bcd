"""Operators on the structure of arrays: lists, missing values, records, combinations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.array import Array, Scalar, aligned, axis_level, carried, elementwise, exploded
from ragtide.operators.frame import Frame, hidden
from ragtide.operators.reducers import flat_values
from ragtide.operators.node import Leaf, Rec, Value, below, column, fresh, leaves, let, lift, mapped, of_type, once, thinnest

_builtin_zip = zip


def _lazy(array: Any, name: str) -> Array:
    if not isinstance(array, Array):
        raise TypeError(f"{name}: a lazy array is needed, not {type(array).__name__}")
    return array


def _level(array: Array, axis: int, name: str, least: int = 1) -> int:
    level = axis_level(_lazy(array, name), axis)
    if level < least:
        raise NotImplementedError(f"{name} isn't defined for axis {axis}")
    return level


def _each(value: Value, fn: Callable[[Leaf], Leaf]) -> Value:
    return fn(value) if isinstance(value, Leaf) else replace(value, fields={n: _each(v, fn) for n, v in value.fields.items()}, origin=None)


# Lists.
def num(array: Array, axis: int = 1) -> Array | Scalar:
    """Lengths of lists; at axis 0 the number of rows, as a scalar."""
    level = axis_level(_lazy(array, "num"), axis)
    if level == 0:
        if array.frame.divisions is not None:
            return Scalar.from_known(array.frame.divisions[-1], T.LongType())
        return Scalar(array.frame.df.agg(F.count("*").alias("value")))
    col = below(lambda a: F.size(a).cast("bigint"), thinnest(array.node, level), level - 1)
    return array.leaf(col, level - 1, array.node.skel[: level - 1])


def local_index(array: Array, axis: int = -1) -> Array:
    """Each element's place in its list; at axis 0 the row's number."""
    level = axis_level(_lazy(array, "local_index"), axis)
    if level == 0:
        row = array.frame.ranked()
        return array.leaf(F.col(row), 0, ())
    col = below(lambda a: F.transform(a, lambda v, i: i.cast("bigint")), thinnest(array.node, level), level - 1)
    return array.leaf(col, level, array.node.skel[:level])


def flatten(array: Array, axis: int | None = 1) -> Array:
    """One list level less; axis None: all of them. Missing lists count as empty, at axis 0 missing rows go."""
    if axis is None:
        return drop_none(flat_values(_lazy(array, "flatten")), axis=0)
    level = axis_level(_lazy(array, "flatten"), axis)
    if level == 0:
        return drop_none(array, axis=0)
    if level == 1:
        return exploded(array)
    return array.moved(lambda a: F.flatten(F.filter(a, lambda v: v.isNotNull())), level - 2, -1)


def ravel(array: Array) -> Array:
    """All values of all lists as rows, missing ones included."""
    return flat_values(_lazy(array, "ravel"))


def firsts(array: Array, axis: int = 1) -> Any:
    """First elements, None for empty lists; at axis 0 the first row."""
    level = axis_level(_lazy(array, "firsts"), axis)
    if level == 0:
        return array[0]
    return array.moved(lambda a: F.get(a, F.lit(0)), level - 1, -1)


def singletons(array: Array, axis: int = 0) -> Array:
    """Lists of one value, or none for a missing value."""
    level = axis_level(_lazy(array, "singletons"), axis)
    if isinstance(array.node, Rec) and level == array.depth:
        gone = below(lambda v: v.isNull(), column(array.node), level)
        return array.of(mapped(array.node, lambda c: lift(lambda v, g: F.when(g, F.slice(F.array(v), 1, 0)).otherwise(F.array(v)), [c, gone], [level, level]), 1))
    return array.moved(lambda v: F.when(v.isNull(), F.slice(F.array(v), 1, 0)).otherwise(F.array(v)), level, 1)


def pad_none(array: Array, target: int, axis: int = 1, clip: bool = False) -> Array:
    """Lists with None added up to `target` elements; clip: and cut there."""
    level = _level(array, axis, "pad_none")

    def fn(a: Column) -> Column:
        cut = F.slice(a, 1, target) if clip else a
        return F.when(F.size(a) >= target, cut).otherwise(F.concat(a, F.transform(F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(target) - F.size(a))), lambda _: F.get(a, F.size(a)))))

    return array.moved(fn, level - 1)


def sort(array: Array, axis: int = -1, ascending: bool = True, stable: bool = True) -> Array:
    """Sorted lists, missing values last. Equal values can't be told apart, so every sort is stable."""
    level = _level(array, axis, "sort")
    if isinstance(array.node, Rec) or level != array.depth:
        raise NotImplementedError("sort is for the innermost lists of plain values")
    return array.moved(lambda a: F.array_sort(a) if ascending else F.sort_array(a, False), level - 1, keep=True)


def argsort(array: Array, axis: int = -1, ascending: bool = True, stable: bool = True) -> Array:
    """Places that sort the lists, equal values in their order, missing ones last."""
    level = _level(array, axis, "argsort")
    if isinstance(array.node, Rec) or level != array.depth:
        raise NotImplementedError("argsort is for the innermost lists of plain values")

    def fn(a: Column) -> Column:
        if ascending:
            return F.array_sort(F.transform(a, lambda v, i: F.struct(v.isNull().alias("m"), v.alias("v"), i.cast("bigint").alias("i")))).getField("i")
        keyed = F.array_sort(F.transform(a, lambda v, i: F.struct(v.isNotNull().alias("m"), v.alias("v"), (-i.cast("bigint")).alias("i"))))
        return F.transform(F.reverse(keyed), lambda s: -s["i"])

    return array.leaf(below(fn, array.node.col, level - 1), array.depth, array.node.skel)


def run_lengths(array: Array) -> Array:
    """Lengths of stretches of equal neighbours: in the innermost lists, or of the rows of a flat array."""
    if isinstance(_lazy(array, "run_lengths").node, Rec):
        raise TypeError("run_lengths isn't defined for records")
    if array.depth:

        def fn(a: Column) -> Column:
            changes = F.filter(F.transform(a, lambda v, i: i), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
            return let([changes], lambda starts: F.transform(starts, lambda s, j: (F.coalesce(F.get(starts, j + 1), F.size(a)) - s).cast("bigint")))

        return array.leaf(below(once(fn), array.node.col, array.depth - 1), array.depth, array.node.skel[:-1] + fresh(1))
    # Runs may go on from partition to partition: each row is held against the one before by its number.
    base = carried(array, lambda df: df)
    row, v = base.frame.ranked(), base.node.col
    before = base.frame.df.select((F.col(row) + 1).alias("__rt_r"), v.alias("__rt_v"))
    joined = base.frame.df.join(before, F.col(row) == F.col("__rt_r"), "left")
    run = hidden("run")
    change = F.when(F.col("__rt_r").isNull() | ~v.eqNullSafe(F.col("__rt_v")), 1).otherwise(0)
    starts = joined.where(change == 1).select(F.col(row))
    ordered = Frame(starts, (row,))
    numbered = ordered.running(F.lit(1), run)
    nxt = numbered.select((F.col(run) - 1).alias("__rt_n"), F.col(row).alias("__rt_end"))
    total = base.frame.df.agg(F.count("*").alias("__rt_total"))
    out = numbered.join(nxt, F.col(run) == F.col("__rt_n"), "left").select(F.col(run), (F.coalesce(F.col("__rt_end"), total.scalar()) - F.col(row)).alias("value"))
    return Array(Frame(out, (run,), row=run), Leaf(F.col("value")))


def unflatten(array: Array, counts: Any, axis: int = 0) -> Array:
    """Lists of so many elements each: of rows at axis 0, of the elements of lists else. counts: a number, or an array of
    them (at axis 0 with a row for each list)."""
    level = axis_level(_lazy(array, "unflatten"), axis)
    if level == 0:
        return _unflatten_rows(array, counts)
    if isinstance(counts, int):

        def fn(a: Column) -> Column:
            n = F.ceil(F.size(a) / F.lit(counts)).cast("int")
            parts = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a, i * counts + 1, counts))
            return F.when(F.size(a) % counts == 0, parts).otherwise(F.raise_error(F.lit("a list's length isn't a multiple of counts")))

        return array.moved(fn, level - 1, 1)
    frame, (array, counts) = aligned(array, counts, name="unflatten")

    def cut(a: Column, n: Column) -> Column:
        # Lists in order with where each begins: one pass over the counts.
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<at:bigint,n:bigint>>").alias("cuts"))
        step = lambda acc, k: F.struct((acc["at"] + k).alias("at"), F.concat(acc["cuts"], F.array(F.struct(acc["at"].alias("at"), k.cast("bigint").alias("n")))).alias("cuts"))
        return let([F.aggregate(n, start, step)], lambda made: parted(a, made))

    def parted(a: Column, made: Column) -> Column:
        parts = F.transform(made["cuts"], lambda c: F.slice(a, (c["at"] + 1).cast("int"), c["n"].cast("int")))
        whole = made["at"]
        return F.when(whole == F.size(a), parts).otherwise(F.raise_error(F.lit("counts don't sum up to the length of a list")))

    value = mapped(array.node, lambda c: lift(once(cut), [c, counts.node.col], [level - 1, level - 1]), 1, array.node.skel[: level - 1] + fresh(array.depth + 2 - level))
    return Array(frame, value)


def _unflatten_rows(array: Array, counts: Any) -> Array:
    array = carried(array, lambda df: df)
    row = array.frame.ranked()
    cols = leaves(array.node)
    names = [hidden("c") for _ in cols]
    flat = array.frame.df.select(F.col(row), *[x.col.alias(n) for x, n in _builtin_zip(cols, names)])
    if isinstance(counts, int):
        keyed = flat.withColumn("__rt_g", F.floor(F.col(row) / counts).cast("bigint"))
        grouped = keyed.groupBy("__rt_g")
        check = F.when(F.count("*") == counts, F.lit(True)).otherwise(F.raise_error(F.lit("the number of rows isn't a multiple of counts")).cast("boolean"))
    else:
        counts = carried(_lazy(counts, "unflatten"), lambda df: df)
        group = counts.frame.ranked()
        first = hidden("f")
        n = counts.node.col.cast("bigint")
        places = counts.frame.running(n, first).select(F.col(group).alias("__rt_g"), F.col(first).alias("__rt_f"), n.alias("__rt_n"))
        places = places.withColumn("__rt_k", F.explode_outer(F.when(F.col("__rt_n") > 0, F.sequence(F.col("__rt_f"), F.col("__rt_f") + F.col("__rt_n") - 1))))
        keyed = places.join(flat, F.col("__rt_k") == F.col(row), "full")
        grouped = keyed.groupBy("__rt_g")
        lost = F.count_if(F.col("__rt_g").isNull() | (F.col("__rt_k").isNotNull() & F.col(row).isNull())) > 0
        check = F.when(lost, F.raise_error(F.lit("counts don't sum up to the number of rows")).cast("boolean")).otherwise(F.lit(True))
    # A group is a list of the result, so it has to fit into one row whatever one does.
    made = grouped.agg(F.array_sort(F.collect_list(F.when(F.col(row).isNotNull(), F.struct(F.col(row).alias("r"), *[F.col(x).alias(x) for x in names])))).alias("l"), check.alias("ok")).where("ok")
    by = {id(x): F.col("l").getField(x_name) for x, x_name in _builtin_zip(cols, names)}

    def deeper(v: Value) -> Value:
        if isinstance(v, Leaf):
            return Leaf(by[id(v)], v.depth + 1, fresh(1) + v.skel, v.dtype and T.ArrayType(v.dtype), v.attrs)
        mark = fresh(1)
        fields = {n: deeper(x) for n, x in v.fields.items()}
        fields = {n: replace(x, skel=mark + x.skel[1:]) for n, x in fields.items()}
        return Rec(v.depth + 1, fields, mark + v.skel, None, v.attrs)

    return Array(Frame(made, ("__rt_g",), row="__rt_g"), deeper(array.node))


def from_regular(array: Array, axis: int | None = 1) -> Array:
    """Lists of fixed size as lists of any size: the size is forgotten."""
    if axis == 0:
        raise ValueError("the rows themselves aren't a list of fixed size")
    return without_parameters(array, only=("size",))


def to_regular(array: Array, axis: int | None = 1) -> Array:
    """Lists that all have one size, which is checked when it runs."""
    if axis == 0:
        raise ValueError("the rows themselves can't be a list of fixed size")
    for level in range(1, array.depth + 1) if axis is None else [axis_level(array, axis)]:
        size = thinnest(array.node, level)
        widest = array.frame.df.agg(F.max(_extreme(size, level, True)).alias("value"))
        one = array.frame.bind(widest.scalar())
        array = array.moved(lambda a: F.when(F.size(a) == one, a).otherwise(F.when(a.isNull(), a).otherwise(F.raise_error(F.lit("lists of different sizes can't become regular")))), level - 1, keep=True)  # noqa: B023
    return with_parameter(array, "size", True)


def _extreme(col: Column, level: int, top: bool) -> Column:
    if level == 1:
        return F.size(col)
    return F.array_max(F.transform(col, lambda v: _extreme(v, level - 1, top)))


def to_packed(array: Array) -> Array:
    """The same array: Spark's rows have no unused buffers."""
    return _lazy(array, "to_packed").of(array.node)


def copy(array: Array) -> Array:
    return _lazy(array, "copy").of(array.node)


# Missing values.
def is_none(array: Array, axis: int = 0) -> Array:
    level = axis_level(_lazy(array, "is_none"), axis)
    whole = column(array.node) if level == array.depth else thinnest(array.node, level + 1)
    return array.leaf(below(lambda v: v.isNull(), whole, level), level, array.node.skel[:level], dtype=None)


def fill_none(array: Array, value: Any, axis: int | None = -1) -> Array:
    """Missing values replaced: at an axis, or (None) at all; a record's fields each."""
    if isinstance(value, Array):
        raise TypeError("fill_none: the value is a single one")

    def leaf(x: Leaf) -> Leaf:
        kind = x.dtype if x.dtype is not None else Array(array.frame, x).dtype
        for _ in range(x.depth):
            kind = kind.elementType
        filled = F.lit(value) if not isinstance(value, Scalar) else value.expr()
        if not isinstance(value, str) and isinstance(value, float) and not isinstance(kind, T.FloatType | T.DoubleType):
            fill, wider = filled, T.DoubleType()
        else:
            fill, wider = filled.cast(kind), kind
        levels = range(x.depth + 1) if axis is None else [axis + x.depth + 1 if axis < 0 else axis]
        col = x.col
        for level in levels:
            if level == x.depth:
                col = below(lambda v: F.coalesce(v, fill), col, level)
            elif axis is not None:
                raise TypeError("fill_none: only single values can be filled in, and lists lie at this axis")
        out = wider
        for _ in range(x.depth):
            out = T.ArrayType(out)
        return Leaf(col, x.depth, x.skel, out, x.attrs)

    return _lazy(array, "fill_none").of(_each(array.node, leaf))


def drop_none(array: Array, axis: int | None = None) -> Array:
    """Without missing values: at an axis, or (None) at all. At axis 0 rows go."""
    _lazy(array, "drop_none")
    levels = range(array.depth, -1, -1) if axis is None else [axis_level(array, axis)]
    for level in levels:
        if level == 0:
            gone = column(array.node) if array.depth == 0 else thinnest(array.node, 1)
            array = array.over(array.frame.where(gone.isNotNull()))
        elif isinstance(array.node, Rec) and level == array.depth:
            there = below(lambda v: v.isNotNull(), column(array.node), level)
            array = _masked(array, there, level)
        else:
            array = array.moved(lambda a: F.filter(a, lambda v: v.isNotNull()), level - 1)
    return array


def _masked(array: Array, mask_col: Column, level: int) -> Array:
    """Elements of the lists at a level, where a mask of the same structure is true."""

    def fn(a: Column, m: Column) -> Column:
        return let([m], lambda chosen: F.filter(a, lambda v, i: F.coalesce(F.get(chosen, i), F.lit(False))))

    skel = array.node.skel[: level - 1] + fresh(array.depth - level + 1)
    return array.of(mapped(array.node, lambda c: lift(fn, [c, mask_col], [level - 1, level - 1]), 0, skel))


def mask(array: Array, mask: Array, valid_when: bool = True) -> Array:
    """Missing where the mask isn't valid_when; as many elements as before."""
    frame, (array, mask) = aligned(array, mask, name="mask")
    level = mask.depth
    if level > array.depth:
        raise ValueError("mask: the mask is deeper than the array")

    def fn(v: Column, m: Column) -> Column:
        return F.when(m if valid_when else ~m, v)

    # Below a record's levels its own None comes as None of every field.
    return Array(frame, mapped(array.node, lambda c: lift(fn, [c, mask.node.col], [level, level]), 0, array.node.skel))


def nan_to_none(array: Array) -> Array:
    return array.of(_each(array.node, lambda x: replace(x, col=below(lambda v: F.when(~F.isnan(v), v), x.col, x.depth))))


def nan_to_num(array: Array, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Array:
    """NaN and infinities replaced; without values for these, by the largest doubles."""
    high = posinf if posinf is not None else 1.7976931348623157e308
    low = neginf if neginf is not None else -1.7976931348623157e308

    def leaf(x: Leaf) -> Leaf:
        kind = Array(array.frame, x).scalar_type
        if not isinstance(kind, T.FloatType | T.DoubleType):
            return x
        fn = lambda v: F.when(F.isnan(v), F.lit(nan).cast(kind)).when(v == float("inf"), F.lit(high).cast(kind)).when(v == float("-inf"), F.lit(low).cast(kind)).otherwise(v)
        return replace(x, col=below(fn, x.col, x.depth))

    return _lazy(array, "nan_to_num").of(_each(array.node, leaf))


def isclose(a: Array, b: Any, rtol: float = 1e-05, atol: float = 1e-08, equal_nan: bool = False) -> Array:
    def fn(x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        both = F.isnan(x) & F.isnan(y) if equal_nan else F.lit(False)
        near = (F.abs(x - y) <= atol + rtol * F.abs(y)) & (F.abs(y) != float("inf")) | (x == y) & ~F.isnan(x)
        return F.when(x.isNotNull() & y.isNotNull(), both | (near & ~F.isnan(x) & ~F.isnan(y)))

    return elementwise(fn, a, b, name="isclose", dtype=T.BooleanType())


# Like another array.
def full_like(array: Array, fill_value: Any, dtype: Any = None) -> Array:
    if dtype is str:
        raise ValueError("full_like can't make strings")

    def leaf(x: Leaf) -> Leaf:
        kind = _spark_type(dtype) if dtype is not None else Array(array.frame, x).scalar_type
        fill = fill_value.expr() if isinstance(fill_value, Scalar) else F.lit(fill_value)
        if isinstance(fill_value, Scalar):
            fill = array.frame.bind(fill)
        whole = kind
        for _ in range(x.depth):
            whole = T.ArrayType(whole)
        return Leaf(below(lambda v: F.when(v.isNotNull(), fill.cast(kind)), x.col, x.depth), x.depth, x.skel, whole, {})

    return _lazy(array, "full_like").of(_each(array.node, leaf))


def ones_like(array: Array, dtype: Any = None) -> Array:
    return full_like(array, 1, dtype)


def zeros_like(array: Array, dtype: Any = None) -> Array:
    return full_like(array, 0, dtype)


#: Names and NumPy's types as Spark's.
_TYPES = {"bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "str": T.StringType(), "string": T.StringType(), "bytes": T.BinaryType(), "datetime64": T.TimestampNTZType(), "timedelta64": T.DayTimeIntervalType()}


def _spark_type(to: Any) -> T.DataType:
    if isinstance(to, T.DataType):
        return to
    if to in (int, float, bool, str, bytes):
        return {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType(), bytes: T.BinaryType()}[to]
    name = str(getattr(to, "__name__", to)).split("[")[0]
    return _TYPES[name] if name in _TYPES else T._parse_datatype_string(name)


def values_astype(array: Array, to: Any, including_unknown: bool = False) -> Array:
    """Numbers of another type, at all leaves that aren't strings. Fractions are cut; whole numbers that don't fit wrap
    around, as machine words do; NaN and infinities become 0."""
    kind = _spark_type(to)
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind))

    def leaf(x: Leaf) -> Leaf:
        old = Array(array.frame, x).scalar_type
        if isinstance(old, T.StringType | T.BinaryType):
            return x

        def fn(v: Column) -> Column:
            if isinstance(kind, T.LongType) or bits:
                if isinstance(old, T.FloatType | T.DoubleType):
                    v = F.when(F.isnan(v) | (F.abs(v) >= 2.0**63), F.lit(0).cast("bigint")).otherwise(v.cast("bigint"))
                if bits and not isinstance(old, T.BooleanType):
                    wide = v.cast("bigint").bitwiseAND(2**bits - 1)
                    return F.when(wide >= 2 ** (bits - 1), wide - 2**bits).otherwise(wide).cast(kind)
            return v.cast(kind)

        whole = kind
        for _ in range(x.depth):
            whole = T.ArrayType(whole)
        return Leaf(below(fn, x.col, x.depth), x.depth, x.skel, whole, x.attrs)

    return _lazy(array, "values_astype").of(_each(array.node, leaf))


def strings_astype(array: Array, to: Any) -> Array:
    """Strings as numbers; what isn't one becomes missing."""
    kind = _spark_type(to)
    whole = kind
    for _ in range(_lazy(array, "strings_astype").depth):
        whole = T.ArrayType(whole)
    return array.of(_each(array.node, lambda x: Leaf(below(lambda v: v.try_cast(kind), x.col, x.depth), x.depth, x.skel, whole)))


# Choice.
def where(condition: Array, x: Any, y: Any, mergebool: bool = True) -> Array:
    """x where the condition holds, y elsewhere. A missing condition gives a missing value. mergebool: truth values beside
    numbers count as 0 and 1; without it that is refused."""
    if not isinstance(condition, Array):
        raise TypeError("where: the condition has to be a lazy array")
    if isinstance(x, Array) and x.fields or isinstance(y, Array) and y.fields:
        if not (isinstance(x, Array) and isinstance(y, Array) and x.fields == y.fields):
            raise TypeError("where: records are chosen from arrays with the same fields")
        parts = {n: where(condition, x[n], y[n], mergebool) for n in x.fields}
        return zip(parts, depth_limit=max(condition.ndim, x.ndim))
    kinds = [v.scalar_type if isinstance(v, Array) else T._infer_type(v) if not isinstance(v, Scalar) else v.dtype for v in (x, y)]
    bools = [isinstance(k, T.BooleanType) for k in kinds]
    if bools[0] != bools[1]:
        if not mergebool:
            raise TypeError("where: truth values and numbers aren't merged with mergebool=False")
        cast = lambda v, b: v.cast("int") if b else v
        return elementwise(lambda c, p, q: F.when(c, cast(p, bools[0])).when(~c, cast(q, bools[1])), condition, x, y, name="where")
    return elementwise(lambda c, p, q: F.when(c, p).when(~c, q), condition, x, y, name="where")


def broadcast_arrays(*arrays: Any) -> list[Array]:
    """All arrays with the list structure of the deepest."""
    lazies = [a for a in arrays if isinstance(a, Array)]
    frame, items = aligned(*arrays, name="broadcast_arrays")
    depth = max(a.depth for a in lazies)
    model = next(a for a in items if isinstance(a, Array) and a.depth == depth)
    shape = thinnest(model.node, depth)

    def one(x: Any) -> Array:
        if not isinstance(x, Array):
            return Array(frame, Leaf(lift(lambda m, c: c, [shape, F.lit(x)], [depth, 0]), depth, model.node.skel))
        if x.depth == depth:
            return elementwise(lambda m, c: c, Array(frame, Leaf(shape, depth, model.node.skel)), x) if not x.fields else x
        change = depth - x.depth
        return Array(frame, mapped(x.node, lambda c: lift(lambda m, v: v, [shape, c], [depth, x.depth]), change, model.node.skel))

    return [one(x) for x in items]


# Combinations.
def _placed(arrays: list[Array], names: list[str], places: Column, levels: int, level: int, skel: tuple) -> Array:
    """Records of the elements at places: structs of p0, p1 and so on, `levels` list levels below the given level.

    From three arrays on, the fields can't be nested transforms of their own: Spark takes expressions for equal that
    differ only in which outer variable an inner function uses, and would work out one for several."""
    fields = {}
    for k, (name, a) in enumerate(_builtin_zip(names, arrays)):
        pick = lambda c, p, k=k: below(lambda s: F.get(c, s.getField(f"p{k}")), p, levels)
        fields[name] = mapped(a.node, lambda c, pick=pick: lift(once(pick), [c, places], [level - 1, level - 1]), levels - 1, skel + fresh(a.depth - level))
    return arrays[0].of(Rec(level + levels - 1, fields, skel))


def _choose(arrays: list[Array], level: int, nested: set[int] | bool | None, names: list[str]) -> Array:
    n = len(arrays)
    thin = [thinnest(a.node, level) for a in arrays]
    keep = set(range(n - 1)) if nested is True else set(nested or ())
    skel = arrays[0].node.skel[: level - 1] + fresh(1 + len(keep))

    def build(cols: list[Column], i: int, chosen: list[Column], last: Callable[[list[Column]], Column]) -> Column:
        """A list level for each array, joined to the next where it isn't kept."""
        if i == n - 1:
            return last(chosen)
        out = F.transform(cols[i], lambda v, j: build(cols, i + 1, [*chosen, j if n > 2 else v], last))
        return out if i in keep else F.flatten(out)

    if n > 2:
        ends = lambda cols: lambda chosen: F.transform(cols[-1], lambda v, j: F.struct(*[c.alias(f"p{k}") for k, c in enumerate([*chosen, j])]))
        places = lift(once(lambda *cols: build(list(cols), 0, [], ends(cols))), thin, [level - 1] * n)
        return _placed(arrays, names, places, 1 + len(keep), level, skel)
    fields = {}
    for k, a in enumerate(arrays):
        last = lambda cols, k=k: lambda chosen: cols[-1] if k == n - 1 else F.transform(cols[-1], lambda _: chosen[k])
        fn = lambda c, k=k, last=last: lift(once(lambda *cols: build(list(cols), 0, [], last(cols))), [c if j == k else thin[j] for j in range(n)], [level - 1] * n)
        fields[names[k]] = mapped(a.node, fn, len(keep), skel + fresh(a.depth - level))
    return arrays[0].of(Rec(level + len(keep), fields, skel))


def _named(arrays: Any) -> tuple[list[str], list[Array]]:
    return (list(arrays), list(arrays.values())) if isinstance(arrays, dict) else ([str(i) for i in range(len(arrays))], list(arrays))


def cartesian(arrays: Any, axis: int = 1, nested: Any = None, parameters: dict | None = None, with_name: str | None = None) -> Array:
    """In each row, records of all combinations of one element from each array. nested: True keeps a list for each
    element of all arrays but the last; a list of names or numbers does so for those."""
    if axis < 1:
        raise NotImplementedError("cartesian isn't defined for axis 0 or negative axes")
    names, arrays = _named(arrays)
    frame, arrays = aligned(*arrays, name="cartesian")
    if nested not in (None, False, True):
        nested = {names.index(x) if isinstance(x, str) else x for x in nested}
    out = _choose(arrays, axis, nested or None, names)
    return _labelled(out, parameters, with_name)


def argcartesian(arrays: Any, axis: int = 1, nested: Any = None, parameters: dict | None = None, with_name: str | None = None) -> Array:
    """The elements' places in place of themselves."""
    if axis < 1:
        raise NotImplementedError("argcartesian isn't defined for axis 0 or negative axes")
    names, arrays = _named(arrays)
    return cartesian(dict(_builtin_zip(names, [local_index(a, axis) for a in arrays])), axis, nested, parameters, with_name)


def combinations(array: Array, n: int, replacement: bool = False, axis: int = 1, fields: list[str] | None = None, parameters: dict | None = None, with_name: str | None = None) -> Array:
    """In each row, records of n elements in their order, each set of places once; replacement: a place may repeat."""
    if axis < 0:
        raise ValueError("combinations: the axis can't be negative")
    level = _level(array, axis, "combinations")
    if n < 1:
        raise ValueError("combinations: n is 1 at least")
    names = fields or [str(i) for i in range(n)]
    if len(names) != n:
        raise ValueError("combinations: a name for each of the n fields")
    thin = thinnest(array.node, level)
    step = 0 if replacement else 1
    skel = array.node.skel[: level - 1] + fresh(1)

    def rest(a: Column, start: Any) -> Column:
        return F.slice(a, start, F.greatest(F.lit(0), F.size(a) - start + 1))

    if n < 3:
        whole = lambda a, s: rest(a, F.lit(1))
        firsts = lambda a, s: F.flatten(F.transform(a, lambda v, j: F.transform(rest(s, j + step + 1), lambda _: v)))
        seconds = lambda a, s: F.flatten(F.transform(s, lambda v, j: rest(a, j + step + 1)))
        made = {}
        for name, pick in _builtin_zip(names, [whole] if n == 1 else [firsts, seconds]):
            made[name] = mapped(array.node, lambda c, pick=pick: lift(once(pick), [c, thin], [level - 1, level - 1]), 0, skel + fresh(array.depth - level))
        return _labelled(array.of(Rec(level, made, skel)), parameters, with_name)

    def places(a: Column) -> Column:
        def build(i: int, start: Any, chosen: list[Column]) -> Column:
            if i == n - 1:
                return F.transform(rest(a, start), lambda v, j: F.struct(*[c.alias(f"p{k}") for k, c in enumerate([*chosen, start - 1 + j])]))
            return F.flatten(F.transform(rest(a, start), lambda v, j: build(i + 1, start + j + step, [*chosen, start - 1 + j])))

        return build(0, F.lit(1), [])

    at = below(once(places), thin, level - 1)
    return _labelled(_placed([array] * n, names, at, 1, level, skel), parameters, with_name)


def argcombinations(array: Array, n: int, replacement: bool = False, axis: int = 1, fields: list[str] | None = None, parameters: dict | None = None, with_name: str | None = None) -> Array:
    if axis < 0:
        raise ValueError("argcombinations: the axis can't be negative")
    return combinations(local_index(array, axis), n, replacement, axis, fields, parameters, with_name)


def _labelled(array: Array, parameters: dict | None, with_name_: str | None) -> Array:
    for k, v in (parameters or {}).items():
        array = with_parameter(array, k, v)
    return with_name(array, with_name_) if with_name_ else array


# Records.
def zip(arrays: Any, depth_limit: int | None = None, parameters: dict | None = None, with_name: str | None = None, right_broadcast: bool = False, optiontype_outside_record: bool = False) -> Array:
    """Records (or, from a list, tuples) of arrays. Lists are gone into as far as all arrays have them, or depth_limit
    dimensions; arrays of fewer list levels are repeated in the others' lists. right_broadcast also repeats a list of one
    element. optiontype_outside_record: a record with a missing field is itself missing."""
    names, items = _named(arrays)
    if not items:
        raise ValueError("zip: no arrays")
    if isinstance(arrays, dict) and any(not isinstance(x, Array | Scalar) for x in items):
        raise TypeError("zip: the values have to be lazy arrays")
    frame, items = aligned(*items, name="zip")
    items = [x if isinstance(x, Array) else Array(frame, Leaf(x.expr() if isinstance(x, Scalar) else F.lit(x))) for x in items]
    deepest = max(x.depth for x in items)
    limit = deepest if depth_limit is None else min(depth_limit - 1, deepest)
    model = next(x for x in items if x.depth == deepest)
    shape = thinnest(model.node, limit) if limit else None
    fields: dict[str, Value] = {}
    for name, x in _builtin_zip(names, items):
        v = x.node
        if limit and v.depth < limit:
            at = v.depth
            v = mapped(v, lambda c, at=at: lift(lambda m, y: y, [shape, c], [limit, at]), limit - at, model.node.skel[:limit])
        elif limit and x is not model and (not v.skel or v.skel[:limit] != model.node.skel[:limit]):
            if right_broadcast:
                wide = lambda m, y: F.when((F.size(y) == 1) & (F.size(m) != 1), F.transform(m, lambda _: F.get(y, F.lit(0)))).otherwise(y)
                v = mapped(v, lambda c: lift(once(wide), [shape, c], [limit - 1, limit - 1]), 0, v.skel)
            same = lambda m, y: F.when(F.size(m) != F.size(y), F.raise_error(F.lit("zip: lists of different lengths"))).otherwise(y)
            for level in range(limit):
                v = mapped(v, lambda c, level=level: lift(once(same), [shape, c], [level, level]), 0, model.node.skel[:limit] + v.skel[limit:])
        fields[name] = v
    out = Array(frame, Rec(limit, fields, model.node.skel[:limit]))
    if optiontype_outside_record:
        gone = [below(lambda v: v.isNotNull(), column(v) if v.depth == limit else thinnest(v, limit + 1), limit) for v in fields.values()]
        there = lift(lambda *c: _and(c), gone, [limit] * len(gone), [model.node.skel] * len(gone))
        whole = lift(lambda v, m: F.when(m, v), [column(out.node), there], [limit, limit], [model.node.skel] * 2)
        out = Array(frame, replace(out.node, origin=whole))
    return _labelled(out, parameters, with_name)


def _and(cols: Any) -> Column:
    first, *rest = cols
    for c in rest:
        first = first & c
    return first


def unzip(array: Array) -> tuple[Array, ...]:
    return tuple(array.field(n) for n in _lazy(array, "unzip").fields) or (array,)


def _record(array: Array, name: str) -> Rec:
    if not isinstance(_lazy(array, name).node, Rec):
        raise TypeError(f"{name}: the array isn't one of records")
    return array.node


def with_field(base: Array, what: Any, where: Any = None) -> Array:
    """A field added or replaced; where: its name, or the names on the way to it."""
    _record(base, "with_field")
    if isinstance(what, str | bytes | list | dict | tuple):
        raise TypeError("with_field: the field is a lazy array or a number")
    path = [where] if isinstance(where, str) or where is None else list(where)
    if len(path) > 1:
        inner = with_field(base.field(path[0]), what, path[1:])
        what, path = inner, path[:1]
    frame, (base, what) = aligned(base, what, name="with_field")
    rec = _record(base, "with_field")
    name = path[0] if path[0] is not None else str(len(rec.fields))
    if isinstance(what, Array):
        value = zip({"r": Array(frame, Leaf(thinnest(rec, rec.depth), rec.depth, rec.skel)) if rec.depth else Array(frame, Leaf(F.lit(0))), "f": what}, depth_limit=rec.depth + 1).node.fields["f"]
    else:
        lit = what.expr() if isinstance(what, Scalar) else F.lit(what)
        value = Leaf(below(lambda _: lit, thinnest(rec, rec.depth), rec.depth) if rec.depth else lit, rec.depth, rec.skel)
    return Array(frame, replace(rec, fields={**rec.fields, name: value}, origin=None))


def without_field(base: Array, where: Any) -> Array:
    rec = _record(base, "without_field")
    if isinstance(where, tuple) and len(where) > 1:
        inner = without_field(base.field(where[0]), where[1:] if len(where) > 2 else where[1])
        return base.of(replace(rec, fields={**rec.fields, where[0]: inner.node}, origin=None))
    gone = [where] if isinstance(where, str) else list(where)
    for n in gone:
        if n not in rec.fields:
            raise KeyError(f"no field {n!r}; fields: {base.fields}")
    return base.of(replace(rec, fields={n: v for n, v in rec.fields.items() if n not in gone}, origin=None))


def with_name(array: Array, name: str) -> Array:
    """Records of a name, which decides their behavior."""
    return array.of(replace(_record(array, "with_name"), attrs={**array.node.attrs, "record": name}))


def with_parameter(array: Array, parameter: str, value: Any) -> Array:
    return array.of(replace(_lazy(array, "with_parameter").node, attrs={**array.node.attrs, parameter: value}))


def without_parameters(array: Array, only: tuple[str, ...] | None = None) -> Array:
    keep = {k: v for k, v in _lazy(array, "without_parameters").node.attrs.items() if k in ("attrs", "record") or only and k not in only}
    return array.of(replace(array.node, attrs=keep))


def with_attrs(array: Array, attrs: dict) -> Array:
    return array.of(replace(array.node, attrs={**array.node.attrs, "attrs": {**array.attrs, **attrs}}))


def enforce_type(array: Array, type: Any) -> Array:
    """The array as another type (Spark's, or its text): numbers are cast, fields left out or added as missing, strings
    and variants converted. A type with not null checks that nothing is missing."""
    target = T._parse_datatype_string(type) if isinstance(type, str) else type

    def to(col: Column, old: T.DataType, new: T.DataType) -> Column:
        if isinstance(new, T.StructType):
            if not isinstance(old, T.StructType):
                raise TypeError(f"{old.simpleString()} can't become a record")
            have = {f.name: f for f in old.fields}
            parts = [
                (_required(to(col.getField(f.name), have[f.name].dataType, f.dataType), f.nullable, f.name) if f.name in have else _added(f)).alias(f.name)
                for f in new.fields
            ]
            return F.when(col.isNotNull(), F.struct(*parts))
        if isinstance(new, T.ArrayType):
            if not isinstance(old, T.ArrayType):
                raise TypeError(f"{old.simpleString()} can't become a list")
            return F.transform(col, lambda v: _required(to(v, old.elementType, new.elementType), new.containsNull, "an element"))
        if isinstance(new, T.VariantType):
            return F.to_variant_object(col) if isinstance(old, T.ArrayType | T.StructType) else col.cast("variant")
        if isinstance(old, T.VariantType):
            return F.try_variant_get(col, "$", new.simpleString())
        if isinstance(old, T.ArrayType | T.StructType):
            raise TypeError(f"{old.simpleString()} can't become {new.simpleString()}")
        return col.cast(new)

    old = array.dtype
    return array.of(of_type(to(array.col, old, target), target, attrs=array.node.attrs))


def _required(col: Column, nullable: bool, what: str) -> Column:
    return col if nullable else F.when(col.isNotNull(), col).otherwise(F.raise_error(F.lit(f"{what} is missing where the type allows none")))


def _added(f: T.StructField) -> Column:
    if not f.nullable:
        raise TypeError(f"the field {f.name} isn't there and can't be missing")
    return F.lit(None).cast(f.dataType)

