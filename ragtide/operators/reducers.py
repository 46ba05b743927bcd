"""Reducers: sums, extremes, positions and moments along an axis.

axis >= 1 (or a negative axis that comes to that) works within rows; axis 0 across rows, position by position; axis None
over all values. Missing values are skipped. keepdims keeps a dimension of length 1. Where nothing is left to reduce,
mask_identity=True gives None and False the identity (for max and min the type's bounds). Ties of argmax and argmin go
to the first. NaN is the largest value for max and argmax, as Spark orders it. Products of whole numbers wrap at 64 bits,
as in an array of int64. Positions at axis 0 or None count rows, or values in row order; the mean, variance, deviation,
moments, fits and softmax take any axis that is named below.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.functions import ufuncs
from ragtide.operators.array import Array, Scalar, axis_level, carried, elementwise, exploded
from ragtide.operators.frame import Frame, hidden
from ragtide.operators.node import Leaf, Rec, below, fresh, let, of_type, once

_WHOLE = T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.BooleanType
#: Products by key that a task holds before it hands them on.
_HELD = 2**14


def _present(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def _numeric(v: Column, dtype: T.DataType) -> Column:
    return v.cast("double") if isinstance(dtype, T.FloatType | T.DoubleType) else v.cast("bigint") if isinstance(dtype, _WHOLE) else v


def _zero(dtype: T.DataType, n: int) -> Column:
    return F.lit(n).cast("double" if isinstance(dtype, T.FloatType | T.DoubleType) else "bigint" if isinstance(dtype, _WHOLE) else dtype)


def _bound(dtype: T.DataType, top: bool) -> Column:
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(dtype))
    if bits:
        return F.lit(2**bits - 1 if top else -(2**bits)).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(top)
    if isinstance(dtype, T.FloatType | T.DoubleType):
        return F.lit(float("inf") if top else float("-inf")).cast(dtype)
    raise TypeError(f"{dtype.simpleString()} has no bounds to stand for an empty list; use mask_identity=True")


@dataclass(frozen=True)
class Reducer:
    """inner: a list's value (dtype of its elements given); empty: its identity, None where that is missing; total: the
    same as an aggregate of rows."""

    name: str
    inner: Callable[[Column, T.DataType], Column]
    total: Callable[[Column, T.DataType], Column]
    empty: Callable[[T.DataType], Column] | None
    masked: bool
    needs: bool = False


def _sum(a: Column, dtype: T.DataType) -> Column:
    return F.aggregate(a, _zero(dtype, 0), lambda acc, v: F.when(v.isNull(), acc).otherwise(acc + _numeric(v, dtype)))


def _prod(a: Column, dtype: T.DataType) -> Column:
    times = _times if isinstance(dtype, _WHOLE) else lambda x, y: x * y
    return F.aggregate(a, _zero(dtype, 1), lambda acc, v: F.when(v.isNull(), acc).otherwise(times(acc, _numeric(v, dtype))))


def _times(x: Column, y: Column) -> Column:
    """The low 64 bits of a product of whole numbers; past 63 bits it is worked out in decimals, which hold all of it."""
    whole = x.cast("decimal(20,0)") * y.cast("decimal(20,0)") + F.lit(Decimal(2**63))
    return F.coalesce(F.try_multiply(x, y), (F.pmod(whole, F.lit(Decimal(2**64))) - F.lit(Decimal(2**63))).cast("bigint"))


def _totals(r: Reducer, df: DataFrame, keys: list[str], v: str, dtype: T.DataType) -> DataFrame:
    """By keys t, the aggregate of column v, and n, the number of its present values."""
    if r.name == "prod" and isinstance(dtype, _WHOLE):
        return _products(df, keys, v)
    return df.groupBy(*keys).agg(r.total(F.col(v), dtype).alias("t"), F.count(v).alias("n"))


def _products(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """_totals for products of whole numbers. Spark's own product is one of doubles, which rounds from 2 ** 53 on. Here
    each task multiplies its rows up in Arrow, batch by batch, and hands on a row for each key; values don't shuffle."""
    cols = [*keys, "t", "n"]
    each = df.select(*keys, F.col(v).cast("bigint").alias("t"), F.col(v).isNotNull().cast("bigint").alias("n"))

    def run(batches):
        held = None
        for b in batches:
            table = pa.Table.from_arrays(b.columns, names=cols)
            table = table if held is None else pa.concat_tables([held, table])
            made = table.group_by(keys, use_threads=False).aggregate([("t", "product"), ("n", "sum")])
            held = pa.Table.from_arrays([made.column(c) for c in (*keys, "t_product", "n_sum")], names=cols)
            if held.num_rows > _HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    some = each.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in each.schema])).groupBy(*keys)
    return some.agg(_prod(F.collect_list("t"), T.LongType()).alias("t"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _where(v: Column, dtype: T.DataType) -> Column:
    return v if isinstance(dtype, T.BooleanType) else v != F.lit(0).cast(dtype) if not isinstance(dtype, T.StringType) else F.length(v) > 0


_ALL = {
    r.name: r
    for r in (
        Reducer("all", lambda a, t: F.forall(a, lambda v: F.coalesce(_where(v, t), F.lit(True))), lambda v, t: F.bool_and(_where(v, t)), lambda t: F.lit(True), False),
        Reducer("any", lambda a, t: F.exists(a, lambda v: F.coalesce(_where(v, t), F.lit(False))), lambda v, t: F.bool_or(_where(v, t)), lambda t: F.lit(False), False),
        Reducer("argmax", lambda a, t: F.array_position(a, F.array_max(a)) - 1, None, None, True, True),
        Reducer("argmin", lambda a, t: F.array_position(a, F.array_min(a)) - 1, None, None, True, True),
        Reducer("count", lambda a, t: F.size(_present(a)).cast("bigint"), lambda v, t: F.count(v), lambda t: F.lit(0).cast("bigint"), False),
        Reducer("count_nonzero", lambda a, t: F.size(F.filter(a, lambda v: _where(v, t))).cast("bigint"), lambda v, t: F.count_if(_where(v, t)), lambda t: F.lit(0).cast("bigint"), False),
        Reducer("max", lambda a, t: F.array_max(a), lambda v, t: F.max(v), lambda t: _bound(t, False), True, True),
        Reducer("min", lambda a, t: F.array_min(a), lambda v, t: F.min(v), lambda t: _bound(t, True), True, True),
        Reducer("prod", _prod, lambda v, t: F.product(v), lambda t: _zero(t, 1), False),
        Reducer("sum", _sum, lambda v, t: F.sum(_numeric(v, t)), lambda t: _zero(t, 0), False),
    )
}


def along(fn: Callable[[Column], Column], a: Column, nested: int) -> Column:
    """fn on lists of the values that stand at the same place of the lists in a, which lie `nested` levels deeper."""
    if nested == 0:
        return fn(a)

    def made(lists: Column) -> Column:
        longest = F.coalesce(F.array_max(F.transform(lists, lambda x: F.size(x))), F.lit(0))
        places = F.transform(F.array_repeat(F.lit(0), longest), lambda _, j: j)
        return F.transform(places, lambda j: along(fn, F.transform(F.filter(lists, lambda x: F.size(x) > j), lambda x: F.get(x, j)), nested - 1))

    return let([_present(a)], lambda lists: F.when(lists.isNotNull(), made(lists)))


def _list_value(r: Reducer, dtype: T.DataType, mask: bool) -> Callable[[Column], Column]:
    def fn(a: Column) -> Column:
        value = r.inner(a, dtype)
        if mask and r.empty is not None and not r.needs:
            return F.when(F.size(_present(a)) > 0, value)
        if not mask and r.needs:
            return F.when(a.isNotNull(), F.coalesce(value, F.lit(-1).cast("bigint") if r.empty is None else r.empty(dtype)))
        return value

    return once(fn)


def _run(name: str, array: Array, axis: int | None, keepdims: bool, mask_identity: bool, initial=None):
    if not isinstance(array, Array):
        raise TypeError(f"{name}: a lazy array is needed")
    if isinstance(array.node, Rec):
        if name == "count":
            return array.of(Rec(array.depth - 1, {n: _run(name, array.field(n), axis, keepdims, mask_identity).node for n in array.fields}, array.node.skel[:-1]))
        raise TypeError(f"{name} isn't defined for records; fields: {array.fields}")
    r, dtype = _ALL[name], array.scalar_type
    if initial is not None:
        bound = F.lit(initial).cast(dtype)
        pick = F.greatest if name == "max" else F.least
        old, total = r.inner, r.total
        r = replace(r, inner=lambda a, t: F.when(a.isNotNull(), pick(old(a, t), bound)), total=lambda v, t: pick(total(v, t), bound), empty=lambda t: bound)
    if axis is None:
        return _whole(r, array, dtype, keepdims, mask_identity)
    level = axis_level(array, axis)
    if level == 0:
        return _across(r, array, dtype, keepdims, mask_identity)
    fn = _list_value(r, dtype, mask_identity)
    nested = array.depth - level
    col = below(lambda a: along(fn, a, nested), array.node.col, level - 1)
    kept = array.node.skel[: level - 1]
    if not keepdims:
        return array.leaf(col, array.depth - 1, kept + fresh(array.depth - level))
    return array.leaf(below(lambda v: F.when(v.isNotNull(), F.array(v)) if nested else F.array(v), col, level - 1), array.depth, kept + fresh(array.depth - level + 1))


def flat_values(array: Array, ordered: bool = True) -> Array:
    """A row for each value of the innermost lists."""
    while array.depth > 1:
        array = array.leaf(F.flatten(_present(array.node.col)), array.depth - 1)
    return exploded(array, ordered=ordered) if array.depth else array


def _whole(r: Reducer, array: Array, dtype: T.DataType, keepdims: bool, mask: bool):
    values = flat_values(array, ordered=r.total is None)
    if r.total is None:
        # The position among all values in row order; missing values have places, too.
        values = carried(values, lambda df: df)
        at = values.frame.ranked()
        v = values.node.col
        pick = F.max if r.name == "argmax" else F.min
        best = values.frame.df.where(v.isNotNull()).agg((F.max if r.name == "argmax" else F.min)(F.struct(v.alias("v"), (-F.col(at) if r.name == "argmax" else F.col(at)).alias("i"))).alias("b"))
        out = F.abs(F.col("b.i"))
        del pick
    else:
        v = hidden("v")
        best = _totals(r, values.frame.df.select(values.node.col.alias(v)), [], v, dtype)
        out = F.when(F.col("n") > 0, F.col("t")) if mask else F.coalesce(F.col("t"), r.empty(dtype)) if r.empty else F.col("t")
    for _ in range(array.ndim if keepdims else 0):
        out = F.array(out)
    done = best.select(out.alias("value"))
    if keepdims:
        frame = Frame(done.select(F.explode("value").alias("value"), F.lit(0).alias("__rt_o")), ("__rt_o",), parts=1)
        return Array(frame, Leaf(F.col("value"), array.depth, fresh(array.depth)))
    return Scalar(done)


def _across(r: Reducer, array: Array, dtype: T.DataType, keepdims: bool, mask: bool):
    if array.depth == 0:
        out = _whole(r, array, dtype, False, mask)
        if not keepdims:
            return out
        return Array(Frame(out.df.select("value", F.lit(0).alias("__rt_o")), ("__rt_o",), parts=1), Leaf(F.col("value")))
    # A row for each value with its places in all lists: groups are those places, so their number is bounded by the lists'.
    values, places = carried(array, lambda df: df) if r.total is None else array, []
    row = values.frame.ranked() if r.total is None else None
    while values.depth:
        values = exploded(values, keep=tuple([*places, *([row] if row else [])]), ordered=False)
        places.append(values.frame.order[-1])
    v = values.node.col
    df = values.frame.df
    if row:
        pick = F.struct(v.alias("v"), (-F.col(row) if r.name == "argmax" else F.col(row)).alias("i"))
        total = F.abs((F.max if r.name == "argmax" else F.min)(F.when(v.isNotNull(), pick)).getField("i"))
        df = df.groupBy(*places).agg(total.alias("t"), F.count(v).alias("n"))
    else:
        name = hidden("v")
        df = _totals(r, df.select(*places, v.alias(name)), places, name, dtype)
    out = F.when(F.col("n") > 0, F.col("t")) if mask else F.coalesce(F.col("t"), r.empty(dtype)) if r.empty else F.col("t")
    df = df.select(*places, out.alias("value"))
    for k in range(len(places) - 1, 0, -1):
        df = df.groupBy(*places[:k]).agg(F.array_sort(F.collect_list(F.struct(F.col(places[k]).alias("i"), F.col("value").alias("v")))).alias("l")).select(*places[:k], F.col("l.v").alias("value"))
    if keepdims:
        df = df.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(places[0]).alias("i"), F.col("value").alias("v")))).alias("l")).select(F.col("l.v").alias("value"), F.lit(0).alias(places[0]))
    return Array(Frame(df, (places[0],), parts=1), Leaf(F.col("value"), array.depth - 1 + keepdims, fresh(array.depth - 1 + keepdims)))


def all(array, axis=None, keepdims=False, mask_identity=False):
    return _run("all", array, axis, keepdims, mask_identity)


def any(array, axis=None, keepdims=False, mask_identity=False):
    return _run("any", array, axis, keepdims, mask_identity)


def argmax(array, axis=None, keepdims=False, mask_identity=True):
    return _run("argmax", array, axis, keepdims, mask_identity)


def argmin(array, axis=None, keepdims=False, mask_identity=True):
    return _run("argmin", array, axis, keepdims, mask_identity)


def count(array, axis=None, keepdims=False, mask_identity=False):
    return _run("count", array, axis, keepdims, mask_identity)


def count_nonzero(array, axis=None, keepdims=False, mask_identity=False):
    return _run("count_nonzero", array, axis, keepdims, mask_identity)


def max(array, axis=None, keepdims=False, initial=None, mask_identity=True):
    return _run("max", array, axis, keepdims, mask_identity, initial)


def min(array, axis=None, keepdims=False, initial=None, mask_identity=True):
    return _run("min", array, axis, keepdims, mask_identity, initial)


def prod(array, axis=None, keepdims=False, mask_identity=False):
    return _run("prod", array, axis, keepdims, mask_identity)


def sum(array, axis=None, keepdims=False, mask_identity=False):
    return _run("sum", array, axis, keepdims, mask_identity)


# Moments: of lists within rows from two passes over each, so that large values with small spread keep their digits;
# across rows from Spark's own aggregates, which merge partial moments in the same stable way.


def _pairs(a: Column, w: Column | None) -> Column:
    """Present values as structs of x and weight w."""
    if w is None:
        return F.transform(_present(a), lambda v: F.struct(v.cast("double").alias("x"), F.lit(1.0).alias("w")))
    return F.filter(F.zip_with(a, w, lambda v, k: F.struct(v.cast("double").alias("x"), k.cast("double").alias("w"))), lambda s: s["x"].isNotNull() & s["w"].isNotNull())


def _total(a: Column, fn: Callable[[Column], Column]) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, s: acc + fn(s))


def _ratio(x: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, n))


def _over(pairs: Column, fn: Callable[[Column], Column]) -> Column:
    """Lets an expression be used several times but worked out once."""
    return F.get(F.transform(F.array(pairs), fn), F.lit(0))


def _mean_of(p: Column) -> Column:
    return _ratio(_total(p, lambda s: s["x"] * s["w"]), _total(p, lambda s: s["w"]))


def _moment_of(p: Column, n: int, ddof: int = 0, central: bool = True) -> Column:
    def given(m: Column) -> Column:
        top = _total(p, lambda s: s["w"] * F.pow(s["x"] - m, F.lit(float(n))))
        whole = _total(p, lambda s: s["w"])
        return _ratio(top, whole if not ddof else whole * (1 - F.lit(float(ddof)) / F.size(p)))

    return _over(_mean_of(p), given) if central else given(F.lit(0.0))


def _moments(array: Array, weight: Array | None, axis: int | None, keepdims: bool, mask: bool, of_list: Callable[[Column], Column], of_rows: Callable[[Column, Column | None], Column], name: str):
    if isinstance(array.node, Rec):
        raise TypeError(f"{name} isn't defined for records; fields: {array.fields}")
    if axis is None or axis_level(array, axis) == 0:
        if axis == 0 and array.depth or keepdims:
            raise NotImplementedError(f"{name} at axis 0 of nested lists")
        if weight is None:
            values = flat_values(array, ordered=False)
            x, w, df = values.node.col.cast("double"), None, values.frame.df
        else:
            both = elementwise(lambda v, k: F.struct(v.cast("double").alias("x"), k.cast("double").alias("w")), array, weight, name=name)
            values = flat_values(both, ordered=False)
            x, w, df = values.node.col.getField("x"), values.node.col.getField("w"), values.frame.df
        df = df.select(x.alias("x"), *([w.alias("w")] if w is not None else [])).dropna()
        out = df.agg(of_rows(F.col("x"), F.col("w") if w is not None else None).alias("v"), F.count("x").alias("n"))
        empty = F.lit(None).cast("double") if mask else F.lit(float("nan"))
        return Scalar(out.select(F.when(F.col("n") > 0, F.col("v")).otherwise(empty).alias("value")))
    level = axis_level(array, axis)
    nested = array.depth - level
    if weight is not None and nested:
        raise NotImplementedError(f"{name} with weights is for the innermost axis")

    def fn(a: Column, w: Column | None = None) -> Column:
        pairs = _pairs(a, w)
        value = _over(pairs, of_list)
        value = F.when(F.size(pairs) > 0, value) if mask else F.when(a.isNotNull(), value)
        return F.array(value) if keepdims else value

    if weight is None:
        col = below(lambda a: along(fn, a, nested), array.node.col, level - 1)
        return array.leaf(col, array.depth - 1 + keepdims, array.node.skel[: level - 1] + fresh(nested + keepdims))
    from ragtide.operators.array import aligned
    from ragtide.operators.node import lift

    frame, (a, w) = aligned(array, weight, name=name)
    col = lift(fn, [a.node.col, w.node.col], [level - 1, level - 1], [a.node.skel, w.node.skel])
    return Array(frame, Leaf(col, array.depth - 1 + keepdims, fresh(array.depth - 1 + keepdims)))


def mean(array, weight=None, axis=None, keepdims=False, mask_identity=False):
    def of_rows(x, w):
        return F.avg(x) if w is None else F.try_divide(F.sum(x * w), F.sum(w))

    return _moments(array, weight, axis, keepdims, mask_identity, _mean_of, of_rows, "mean")


def var(x, weight=None, ddof=0, axis=None, keepdims=False, mask_identity=False):
    def of_rows(v, w):
        if w is not None:
            raise NotImplementedError("var over all rows takes no weights")
        n = F.count(v)
        return F.var_pop(v) if not ddof else F.try_divide(F.var_pop(v) * n, n - ddof)

    return _moments(x, weight, axis, keepdims, mask_identity, lambda p: _moment_of(p, 2, ddof), of_rows, "var")


def std(x, weight=None, ddof=0, axis=None, keepdims=False, mask_identity=False):
    out = var(x, weight, ddof, axis, keepdims, mask_identity)
    return ufuncs.by_name("sqrt")(out)


def moment(x, n, weight=None, axis=None, keepdims=False, mask_identity=False):
    """The n-th moment about zero."""

    def of_rows(v, w):
        return F.avg(F.pow(v, F.lit(float(n)))) if w is None else F.try_divide(F.sum(w * F.pow(v, F.lit(float(n)))), F.sum(w))

    return _moments(x, weight, axis, keepdims, mask_identity, lambda p: _moment_of(p, n, central=False), of_rows, "moment")


def ptp(arr, axis=None, keepdims=False, mask_identity=True):
    """Largest less smallest value."""
    return max(arr, axis, keepdims, mask_identity=mask_identity) - min(arr, axis, keepdims, mask_identity=mask_identity)


def _two(name: str, x: Array, y: Array, axis: int | None, of_rows: Callable[[Column, Column], Column], of_list: Callable[[Column], Column], weight=None):
    if weight is not None:
        raise NotImplementedError(f"{name} takes no weights")
    if axis is not None and axis_level(x, axis) == x.depth and x.depth:
        from ragtide.operators.array import aligned
        from ragtide.operators.node import lift

        frame, (a, b) = aligned(x, y, name=name)

        def fn(p: Column, q: Column) -> Column:
            rows = F.filter(F.zip_with(p, q, lambda u, v: F.struct(u.cast("double").alias("x"), v.cast("double").alias("y"))), lambda s: s["x"].isNotNull() & s["y"].isNotNull())
            return F.when(F.size(p) == F.size(q), _over(rows, of_list))

        made = Array(frame, Leaf(lift(fn, [a.node.col, b.node.col], [x.depth - 1] * 2), x.depth - 1, fresh(x.depth - 1)))
        return made.of(of_type(made.node.col, made.dtype)) if name == "linear_fit" else made
    if axis is not None and not (axis == 0 and x.depth == 0):
        raise NotImplementedError(f"{name} takes axis None or the innermost one")
    both = flat_values(elementwise(lambda u, v: F.struct(u.cast("double").alias("x"), v.cast("double").alias("y")), x, y, name=name), ordered=False)
    df = both.frame.df.select(both.node.col.getField("x").alias("x"), both.node.col.getField("y").alias("y")).dropna()
    return Scalar(df.agg(of_rows(F.col("x"), F.col("y")).alias("value")))


def _sums(p: Column, fn: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """fn of the number of pairs and of the sums of squares xx, xy and yy about the means."""
    n = F.size(p).cast("double")
    mx, my = _ratio(_total(p, lambda s: s["x"]), n), _ratio(_total(p, lambda s: s["y"]), n)
    means = F.struct(mx.alias("x"), my.alias("y"))

    def about(m: Column) -> Column:
        sums = F.struct(*[_total(p, lambda s, a=a, b=b: (s[a] - m[a]) * (s[b] - m[b])).alias(a + b) for a, b in ("xx", "xy", "yy")], m.alias("m"))
        return _over(sums, lambda s: fn(n, s))

    return _over(means, about)


def corr(x, y, weight=None, axis=None, keepdims=False, mask_identity=False):
    return _two("corr", x, y, axis, lambda a, b: F.corr(a, b), lambda p: _sums(p, lambda n, s: _ratio(s["xy"], F.sqrt(s["xx"] * s["yy"]))), weight)


def covar(x, y, weight=None, axis=None, keepdims=False, mask_identity=False):
    return _two("covar", x, y, axis, lambda a, b: F.covar_pop(a, b), lambda p: _sums(p, lambda n, s: _ratio(s["xy"], n)), weight)


def linear_fit(x, y, weight=None, axis=None, keepdims=False, mask_identity=False):
    """Records of intercept and slope."""

    def of_list(p):
        slope = lambda s: _ratio(s["xy"], s["xx"])
        return _sums(p, lambda n, s: F.struct((s["m"]["y"] - slope(s) * s["m"]["x"]).alias("intercept"), slope(s).alias("slope")))

    return _two("linear_fit", x, y, axis, lambda a, b: F.struct(F.regr_intercept(b, a).alias("intercept"), F.regr_slope(b, a).alias("slope")), of_list, weight)


def softmax(x, axis=None, keepdims=False, mask_identity=False):
    """Exponentials that sum up to 1 in each innermost list."""
    if axis is None or not x.depth or axis_level(x, axis) != x.depth:
        raise NotImplementedError("softmax is for the innermost axis of nested lists")

    def fn(a: Column) -> Column:
        def given(e: Column) -> Column:
            return _over(_total(e, lambda v: F.coalesce(v, F.lit(0.0))), lambda t: F.transform(e, lambda v: v / t))

        return _over(F.array_max(a), lambda m: _over(F.transform(a, lambda v: F.exp(v.cast("double") - m)), given))

    return x.leaf(below(fn, x.node.col, x.depth - 1), x.depth, x.node.skel)

