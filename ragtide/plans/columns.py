"""What a plan reads: leaves of each source, as Catalyst has pruned them, and narrowing a source by hand."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.array import Array, Record, Scalar
from ragtide.operators.frame import HIDDEN
from ragtide.operators.node import Leaf, Rec, Value, below


def _frame(x: Any) -> DataFrame:
    return x if isinstance(x, DataFrame) else x.to_spark()


def scans(df: DataFrame) -> list[tuple[str, T.StructType]]:
    """(location, schema read) of each file scan in the plan, in the plan's order."""
    plan = df._jdf.queryExecution().sparkPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        for kind in ("children", "subqueries"):
            more = getattr(node, kind)()
            todo += [more.apply(i) for i in range(more.size() - 1, -1, -1)]
        if node.nodeName().startswith("Scan") and "FileSourceScanExec" in node.getClass().getName():
            schema = T.StructType.fromJson(json.loads(node.requiredSchema().json()))
            schema = T.StructType([f for f in schema.fields if not f.name.startswith("_tmp_metadata")])
            paths = node.relation().location().rootPaths()
            found.append((", ".join(paths.apply(i).toString() for i in range(paths.size())), schema))
    return found


def leaf_paths(dtype: T.DataType, prefix: str = "") -> list[str]:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    if isinstance(dtype, T.StructType):
        return [p for f in dtype.fields for p in leaf_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return [prefix]


def report_necessary_columns(*args: Any, traverse: bool = True) -> dict[str, list[str]]:
    """For each source (by its location) the leaves that the given arrays, records or scalars read."""
    out: dict[str, set[str]] = {}
    for x in _found(args, traverse):
        for where, schema in scans(_frame(x)):
            out.setdefault(where, set()).update(leaf_paths(schema))
    return {k: sorted(v) for k, v in out.items()}


necessary_columns = report_necessary_columns


def report_necessary_buffers(*args: Any, traverse: bool = True) -> dict[str, dict[str, list[str]]]:
    """The like, by what is read of each leaf: its values, or (shape) only list lengths and missing values. A leaf is shape
    only if the plan uses it under size() or a test for null alone."""
    out: dict[str, dict[str, set[str]]] = {}
    for x in _found(args, traverse):
        df = _frame(x)
        text = df._jdf.queryExecution().optimizedPlan().toString()
        for where, schema in scans(df):
            kinds = out.setdefault(where, {"data": set(), "shape": set()})
            for path in leaf_paths(schema):
                kinds["shape" if _shape_only(text, path) else "data"].add(path)
    return {k: {n: sorted(s - (v["data"] if n == "shape" else set())) for n, s in v.items()} for k, v in out.items()}


def _shape_only(plan: str, path: str) -> bool:
    import re

    top, *inner = path.split(".")
    name = re.escape(top) + r"#\d+L?" + "".join(rf"\.{re.escape(p)}" for p in inner)
    body = "\n".join(line for line in plan.splitlines() if "Relation [" not in line)
    uses = re.findall(rf"(size\(|isnull\(|isnotnull\(|[^\n]?){name}(?![\w.])", body)
    return bool(uses) and all(u in ("size(", "isnull(", "isnotnull(") for u in uses)


def _found(args: Any, traverse: bool) -> list:
    out = []
    for x in args:
        if isinstance(x, Array | Record | Scalar | DataFrame):
            if not (isinstance(x, Scalar) and x.is_known):
                out.append(x)
        elif traverse and isinstance(x, list | tuple):
            out += _found(x, traverse)
        elif traverse and isinstance(x, dict):
            out += _found(x.values(), traverse)
    return out


def optimize_columns(array: Array, columns: list[str]) -> Array:
    """The array with only the named leaves (dotted paths; a record's name stands for all its leaves) read: the others
    stay in its type but are missing everywhere."""
    wanted = set(columns)

    def kept(path: str) -> bool:
        return any(path == w or path.startswith(f"{w}.") for w in wanted)

    def keep(v: Value, path: str, shape: Leaf | None) -> Value:
        if isinstance(v, Rec):
            own = next((x for n, x in v.fields.items() if isinstance(x, Leaf) and x.depth >= v.depth and kept(f"{path}.{n}" if path else n)), None)
            shape = own if v.depth and own else shape if shape and v.depth and shape.skel[: v.depth] == v.skel else None
            return Rec(v.depth, {n: keep(x, f"{path}.{n}" if path else n, shape) for n, x in v.fields.items()}, v.skel, None, v.attrs)
        if kept(path):
            return v
        # Lists of the records around a leaf stay as long as a leaf beside it says, where one is read.
        levels = shape.depth if shape is not None and v.skel[: shape.depth] == shape.skel else 0
        inner = Array(array.frame, v).dtype
        for _ in range(levels):
            inner = inner.elementType
        none = F.lit(None).cast(inner)
        return Leaf(below(lambda _: none, shape.col, levels) if levels else none, v.depth, v.skel, v.dtype, v.attrs)

    return array.of(keep(array.node, "", None))


def schema_of(array: Array) -> T.StructType:
    return T.StructType([f for f in array.to_spark().schema.fields if not f.name.startswith(HIDDEN)])

