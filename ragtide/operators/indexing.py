"""What stands in array[...]."""

from __future__ import annotations

import numbers
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.array import Array, aligned, single
from ragtide.operators.structure import _masked
from ragtide.operators.node import Rec, fresh, lift, mapped, once


def getitem(array: Array, where: Any) -> Any:
    """Fields (a name, a list of names), rows (a number, a slice), lazy arrays of truth values or places, or a tuple of
    such: fields in a tuple are looked up first, wherever they stand."""
    if isinstance(where, tuple):
        return _tuple(array, where)
    if isinstance(where, str):
        return array.field(where)
    if isinstance(where, list):
        if all(isinstance(x, str) for x in where):
            return _some(array, where)
        if any(isinstance(x, numbers.Number) for x in where):
            raise NotImplementedError("lists of places can't be used; make a lazy array of them")
        raise TypeError("a list of field names is meant")
    if isinstance(where, Array):
        return _by_array(array, where)
    if isinstance(where, slice):
        return rows_slice(array, where)
    if isinstance(where, numbers.Integral) and not isinstance(where, bool):
        return _row(array, int(where))
    if where is Ellipsis:
        return array
    raise TypeError(f"{type(where).__name__} can't be used as an index")


def _some(array: Array, names: list[str]) -> Array:
    if not isinstance(array.node, Rec):
        raise TypeError("the array has no fields")
    fields = {n: array.field(n).node for n in names}
    return array.of(Rec(array.depth, fields, array.node.skel, None, array.node.attrs))


def _tuple(array: Array, where: tuple) -> Any:
    fields = [w for w in where if isinstance(w, str) or isinstance(w, list) and w and all(isinstance(x, str) for x in w)]
    rest = [w for w in where if not any(w is f for f in fields)]
    for f in fields:
        array = getitem(array, f)
    if not rest:
        return array
    if sum(w is Ellipsis for w in rest) > 1:
        raise ValueError("only one ... can be used")
    if rest[0] is Ellipsis:
        after = rest[1:]
        if len(after) >= array.ndim:
            raise NotImplementedError("too many axes after ...")
        rest = [slice(None)] * (array.ndim - len(after)) + after
    elif any(w is Ellipsis for w in rest):
        at = next(i for i, w in enumerate(rest) if w is Ellipsis)
        rest = [*rest[:at], *[slice(None)] * (array.ndim - len(rest) + 1), *rest[at + 1 :]]
    if any(isinstance(w, Array) for w in rest[1:]) or isinstance(rest[0], Array) and len(rest) > 1:
        raise NotImplementedError("lazy arrays can't stand among other indexes")
    if len(rest) > array.ndim:
        raise IndexError(f"too many indexes for {array.ndim} dimensions")
    level = 1
    for w in rest[1:]:
        if isinstance(w, slice):
            if w != slice(None):
                array = array.moved(lambda a, w=w: list_slice(a, w), level - 1)
            level += 1
        elif isinstance(w, numbers.Integral):
            at = int(w)
            array = array.moved(lambda a, at=at: _element(a, at), level - 1, -1)
        else:
            raise TypeError(f"{type(w).__name__} can't be used on an inner axis")
    return array if rest[0] == slice(None) else getitem(array, rest[0])


def _element(a: Column, at: int) -> Column:
    place = F.lit(at) if at >= 0 else F.size(a) + at
    return F.when(a.isNull() | (F.size(a) > (at if at >= 0 else -at - 1)), F.get(a, place)).otherwise(F.raise_error(F.lit(f"index {at} is beyond the end of a list")))


def list_slice(a: Column, s: slice) -> Column:
    """Python's slices of a list."""
    step = 1 if s.step is None else s.step
    if step == 0:
        raise ValueError("a slice's step can't be 0")
    n = F.size(a)

    def place(x: int | None, default: Column, low: Column, high: Column) -> Column:
        return default if x is None else F.greatest(low, F.least(high, F.lit(x) if x >= 0 else n + x))

    if step > 0:
        start, stop = place(s.start, F.lit(0), F.lit(0), n), place(s.stop, n, F.lit(0), n)
        out = F.slice(a, start + 1, F.greatest(F.lit(0), stop - start))
        return out if step == 1 else F.filter(out, lambda v, i: i % step == 0)
    start, stop = place(s.start, n - 1, F.lit(-1), n - 1), place(s.stop, F.lit(-1), F.lit(-1), n - 1)
    out = F.reverse(F.slice(a, stop + 2, F.greatest(F.lit(0), start - stop)))
    return out if step == -1 else F.filter(out, lambda v, i: i % -step == 0)


def _by_array(array: Array, where: Array) -> Array:
    if where.fields:
        raise TypeError("an index is made of truth values or whole numbers")
    frame, (array, where) = aligned(array, where, name="getitem")
    if isinstance(where.scalar_type, T.BooleanType):
        if where.depth == 0:
            return array.over(frame.where(where.node.col))
        if where.depth > array.depth:
            raise ValueError("the selection is deeper than the array")
        return _masked(array, where.node.col, where.depth)
    if where.depth == 0:
        raise NotImplementedError("rows can't be gathered by a lazy array of numbers")
    level = where.depth
    if level > array.depth:
        raise ValueError("the places are deeper than the array")

    def gather(a: Column, places: Column) -> Column:
        n = F.size(a)
        one = lambda i: F.when(i.isNull() | ((i < n) & (i >= -n)), F.get(a, F.when(i < 0, i + n).otherwise(i).cast("int"))).otherwise(F.raise_error(F.lit("a place is beyond the end of a list")))
        return F.transform(places, one)

    skel = array.node.skel[: level - 1] + where.node.skel[level - 1 : level] + fresh(array.depth - level)
    return Array(frame, mapped(array.node, lambda c: lift(once(gather), [c, where.node.col], [level - 1, level - 1]), 0, skel))


def _row(array: Array, i: int) -> Any:
    """One row. The first is found without numbering the others."""
    frame = array.frame
    if i == 0:
        one = frame.first_rows(1)
    else:
        row = frame.ranked()
        if i < 0:
            total = frame.df.agg(F.count("*").alias("n"))
            wanted = F.col(row) == total.scalar() + i
        else:
            wanted = F.col(row) == i
        one = frame.derived(frame.df.where(wanted), parts=1)
    return single(array.over(one))


def rows_slice(array: Array, s: slice) -> Array:
    """Rows from start to stop by step, which is positive."""
    step = 1 if s.step is None else s.step
    if step <= 0:
        raise ValueError("rows can't be sliced with a step that isn't positive")
    if s == slice(None):
        return array
    frame = array.frame
    start, stop = s.start or 0, s.stop
    if start == 0 and step == 1 and stop is not None and stop >= 0:
        return array.over(frame.first_rows(stop))
    row = F.col(frame.ranked())
    n = None
    if start < 0 or stop is not None and stop < 0:
        n = frame.bind(frame.df.agg(F.count("*").alias("n")).scalar(), "n")
    first = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    keep = row >= first
    if stop is not None:
        keep = keep & (row < (n + stop if stop < 0 else F.lit(stop)))
    if step != 1:
        keep = keep & ((row - first) % step == 0)
    return array.over(frame.derived(frame.df.where(keep)))

