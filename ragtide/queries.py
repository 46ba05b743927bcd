"""Queries over the test tables, one for each operator at least, and the same in SQL.

Most run over orders with their lines: records of a key, a few values and lists of the lines' values, empty where an order
has no line. A result has the key k and a value v, or, where v is a list, a row for each of its elements with its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import ragtide as rt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LINE = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


def orders(spark: SparkSession, sf_dir: str) -> rt.Array:
    """k, cust, total, pri and lists n, q, p, d and v (q, or none where d is 0.05)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE))).alias("l"))
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    l, none = F.col("l"), lambda kind: F.array().cast(f"array<{kind}>")  # noqa: E741
    cols = {
        "n": F.coalesce(l["l_linenumber"], none("int")),
        "q": F.coalesce(F.transform(l["l_quantity"], lambda x: x.cast("bigint")), none("bigint")),
        "p": F.coalesce(l["l_extendedprice"], none("double")),
        "d": F.coalesce(l["l_discount"], none("double")),
        "v": F.coalesce(F.transform(l, lambda x: F.when(x["l_discount"] != 0.05, x["l_quantity"].cast("bigint"))), none("bigint")),
    }
    df = made.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("pri"), *[c.alias(n) for n, c in cols.items()])
    return rt.from_dataframe(df, order_by="k")


_ORDERS = """WITH l AS (SELECT l_orderkey AS k, list({'n': l_linenumber, 'q': l_quantity, 'p': l_extendedprice, 'd': l_discount} ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount) AS l FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_custkey AS cust, o_totalprice AS total, o_orderpriority AS pri, [x.n FOR x IN coalesce(l, [])] AS n, [CAST(x.q AS BIGINT) FOR x IN coalesce(l, [])] AS q, [x.p FOR x IN coalesce(l, [])] AS p,
  [x.d FOR x IN coalesce(l, [])] AS d, [CASE WHEN x.d <> 0.05 THEN CAST(x.q AS BIGINT) END FOR x IN coalesce(l, [])] AS v FROM orders LEFT JOIN l ON k = o_orderkey)
"""


def _scalars(name: str, fn: Callable, sql: str, source: Callable = orders, base: str = _ORDERS, table: str = "o") -> None:
    """Values v by k."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = source(spark, sf_dir)
        return rt.zip({"k": o.k, "v": fn(o)}, depth_limit=1).to_spark()

    QUERIES[name] = query
    SQL[name] = f"{base} SELECT k, {sql} AS v FROM {table}"


def _lists(name: str, fn: Callable, sql: str, source: Callable = orders, base: str = _ORDERS, table: str = "o") -> None:
    """A row for each element of a list, by k and place; records' fields as columns."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = source(spark, sf_dir)
        made = fn(o)
        df = rt.zip({"k": o.k, "v": made}, depth_limit=1).to_spark().select("k", F.posexplode("v").alias("pos", "v"))
        df = df.withColumn("pos", F.col("pos").cast("bigint"))
        return df.select("k", "pos", *[F.col("v").getField(f).alias(f"f{f}") for f in made.fields]) if made.fields else df

    QUERIES[name] = query
    SQL[name] = f"{base} SELECT k, CAST(unnest(range(len(l))) AS BIGINT) AS pos, {'unnest(l) AS v' if ' f0' not in sql and chr(39) + 'f' not in sql else 'unnest(l, max_depth := 2)'} FROM (SELECT k, {sql} AS l FROM {table})"


def _one(name: str, fn: Callable, sql: str, source: Callable = orders, base: str = _ORDERS, table: str = "o") -> None:
    """A single value v."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(source(spark, sf_dir)).to_spark().withColumnRenamed("value", "v")

    QUERIES[name] = query
    SQL[name] = f"{base} SELECT {sql} AS v FROM {table}"


def _frame(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


def _cents(array: rt.Array) -> rt.Array:
    """Prices as whole cents, so that sums don't depend on their order."""
    return rt.values_astype(rt.ufuncs.rint(array * 100), "int64")


_C = "[CAST(round(x * 100) AS BIGINT) FOR x IN p]"

# Reducers, within rows.
_scalars("sum_axis1", lambda o: rt.sum(o.v, axis=1), "CAST(coalesce(list_sum(v), 0) AS BIGINT)")
_scalars("prod_axis1", lambda o: rt.prod(o.n, axis=1), "CAST(coalesce(list_product(n), 1) AS BIGINT)")
_scalars("max_axis1", lambda o: rt.max(o.p, axis=-1), "list_max(p)")
_scalars("max_initial", lambda o: rt.max(o.q, axis=1, initial=20), "greatest(20, coalesce(list_max(q), 20))")
_scalars("max_no_mask", lambda o: rt.max(o.n, axis=1, mask_identity=False), "CAST(coalesce(list_max(n), -2147483648) AS INTEGER)")
_scalars("min_axis1", lambda o: rt.min(o.p, axis=1), "list_min(p)")
_scalars("argmax_axis1", lambda o: rt.argmax(o.p, axis=1), "CAST(list_position(p, list_max(p)) - 1 AS BIGINT)")
_scalars("argmin_axis1", lambda o: rt.argmin(o.p, axis=1), "CAST(list_position(p, list_min(p)) - 1 AS BIGINT)")
_scalars("count_axis1", lambda o: rt.count(o.v, axis=1), "CAST(list_count(v) AS BIGINT)")
_scalars("count_nonzero_axis1", lambda o: rt.count_nonzero(o.d, axis=1), "CAST(len([x FOR x IN d IF x <> 0]) AS BIGINT)")
_scalars("any_axis1", lambda o: rt.any(o.q > 45, axis=1), "len([x FOR x IN q IF x > 45]) > 0")
_scalars("all_axis1", lambda o: rt.all(o.q > 5, axis=1), "len([x FOR x IN q IF x <= 5]) = 0")
_scalars("mean_axis1", lambda o: rt.ufuncs.rint(rt.mean(o.v, axis=1, mask_identity=True) * 1e6), "round(list_avg(v) * 1e6)")
_scalars("var_axis1", lambda o: rt.ufuncs.rint(rt.var(o.q, axis=1, mask_identity=True) * 1e4), "round(list_var_pop(q) * 1e4)")
_scalars("std_axis1", lambda o: rt.ufuncs.rint(rt.std(o.q, axis=1, ddof=1, mask_identity=True) * 1e4) * rt.where(rt.num(o.q) > 1, 1, None), "CASE WHEN len(q) > 1 THEN round(list_stddev_samp(q) * 1e4) END")
_scalars("ptp_axis1", lambda o: rt.ptp(o.q, axis=1), "list_max(q) - list_min(q)")
_scalars("moment_axis1", lambda o: rt.ufuncs.rint(rt.moment(o.q, 2, axis=1, mask_identity=True) * 1e4), "round(list_avg([x * x FOR x IN q]) * 1e4)")
_lists("softmax_axis1", lambda o: rt.ufuncs.rint(rt.softmax(o.n, axis=1) * 1e6), "[round(exp(x) / list_sum([exp(y) FOR y IN n]) * 1e6) FOR x IN n]")
_lists("sum_keepdims", lambda o: rt.sum(o.q, axis=1, keepdims=True), "[CAST(coalesce(list_sum(q), 0) AS BIGINT)]")
_scalars("covar_axis1", lambda o: rt.ufuncs.rint(rt.covar(o.n, o.q, axis=1) * rt.where(rt.num(o.q) > 0, 10**6, None)), "(SELECT round(covar_pop(a, b) * 1000000) FROM (SELECT unnest(q) AS a, unnest(n) AS b))")

# Reducers, over everything and across rows.
_one("sum_none", lambda o: rt.sum(_cents(o.p)), f"CAST(sum(coalesce(list_sum({_C}), 0)) AS BIGINT)")
_one("max_none", lambda o: rt.max(o.p), "max(list_max(p))")
_one("min_none", lambda o: rt.min(o.p), "min(list_min(p))")
_one("count_none", lambda o: rt.count(o.v), "CAST(sum(list_count(v)) AS BIGINT)")
_one("count_nonzero_none", lambda o: rt.count_nonzero(o.d), "CAST(sum(len([x FOR x IN d IF x <> 0])) AS BIGINT)")
_one("any_none", lambda o: rt.any(o.q > 49), "bool_or(len([x FOR x IN q IF x > 49]) > 0)")
_one("all_none", lambda o: rt.all(o.q > 0), "bool_and(len([x FOR x IN q IF x <= 0]) = 0)")
_one("prod_none", lambda o: rt.prod(rt.where(o.k % 1000 == 0, rt.values_astype(o.k / 1000, "int64") % 2 + 1, 1)), "CAST(product(CASE WHEN k % 1000 = 0 THEN k // 1000 % 2 + 1 ELSE 1 END) AS BIGINT)")
_one("mean_none", lambda o: rt.ufuncs.rint(rt.mean(o.q) * 1e6), "round(sum(coalesce(list_sum(q), 0)) / sum(len(q)) * 1e6)")
_one("std_none", lambda o: rt.ufuncs.rint(rt.std(o.q) * 1e6), "(SELECT round(stddev_pop(x) * 1e6) FROM (SELECT unnest(q) AS x FROM o))", table="(SELECT 1)")
_one("corr_none", lambda o: rt.ufuncs.rint(rt.corr(o.q, o.p) * 1e6), "(SELECT round(corr(y, x) * 1e6) FROM (SELECT unnest(q) AS x, unnest(p) AS y FROM o))", table="(SELECT 1)")


def _across(name: str, fn: Callable, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(orders(spark, sf_dir))
        return rt.zip({"pos": rt.local_index(out, axis=0), "v": out}, depth_limit=1).to_spark()

    QUERIES[name] = query
    SQL[name] = f"{_ORDERS}, u AS (SELECT k, CAST(unnest(range(len(q))) AS BIGINT) AS pos, unnest(q) AS q, unnest(v) AS v, unnest(p) AS p FROM o) SELECT pos, {sql} AS v FROM u GROUP BY pos"


_across("sum_axis0", lambda o: rt.sum(o.v, axis=0), "CAST(coalesce(sum(v), 0) AS BIGINT)")
_across("max_axis0", lambda o: rt.max(o.p, axis=0), "max(p)")
_across("min_axis0", lambda o: rt.min(o.p, axis=0), "min(p)")
_across("count_axis0", lambda o: rt.count(o.v, axis=0), "count(v)")
_across("any_axis0", lambda o: rt.any(o.q > 49, axis=0), "bool_or(q > 49)")
_across("all_axis0", lambda o: rt.all(o.q > 1, axis=0), "bool_and(q > 1)")
_across("count_nonzero_axis0", lambda o: rt.count_nonzero(o.q, axis=0), "count(*)")
_across("argmax_axis0", lambda o: rt.argmax(o.p, axis=0), "(SELECT CAST(count(*) AS BIGINT) FROM o WHERE o.k < arg_max(u.k, (u.p, -u.k)))")

# Structure.
_scalars("num_axis1", lambda o: rt.num(o.p), "CAST(len(p) AS BIGINT)")
_one("num_axis0", lambda o: rt.num(o, axis=0), "count(*)")
_lists("local_index", lambda o: rt.local_index(o.p), "range(len(p))")
_scalars("firsts", lambda o: rt.firsts(o.p), "p[1]")
_lists("singletons", lambda o: rt.singletons(rt.where(o.cust % 2 == 0, o.cust, None)), "CASE WHEN cust % 2 = 0 THEN [cust] ELSE [] END")
_lists("pad_none", lambda o: rt.pad_none(o.q, 4), "list_resize(q, greatest(len(q), 4))")
_lists("pad_none_clip", lambda o: rt.pad_none(o.q, 3, clip=True), "list_resize(q, 3)")
_lists("sort", lambda o: rt.sort(o.q), "list_sort(q)")
_lists("sort_descending", lambda o: rt.sort(o.v, ascending=False), "list_sort(v, 'DESC', 'NULLS LAST')")
_lists("argsort", lambda o: rt.argsort(o.p), "[CAST(i - 1 AS BIGINT) FOR i IN list_grade_up(p)]")
_lists("run_lengths", lambda o: rt.run_lengths(rt.sort(o.n)), "[CAST(len([y FOR y IN n IF y = x]) AS BIGINT) FOR x IN list_sort(list_distinct(n))]")
_lists("unflatten_inner", lambda o: rt.sum(rt.unflatten(rt.pad_none(o.q, 6, clip=True), 2, axis=1), axis=2), "[CAST(coalesce(a[1], 0) + coalesce(a[2], 0) AS BIGINT) FOR a IN [list_resize(q, 6)[1:2], list_resize(q, 6)[3:4], list_resize(q, 6)[5:6]]]")
_lists("fill_none", lambda o: rt.fill_none(o.v, -1), "[coalesce(x, -1) FOR x IN v]")
_lists("drop_none", lambda o: rt.drop_none(o.v, axis=1), "[x FOR x IN v IF x IS NOT NULL]")
_lists("is_none", lambda o: rt.is_none(o.v, axis=1), "[x IS NULL FOR x IN v]")
_lists("mask", lambda o: rt.mask(o.q, o.p > 50000.0), "list_transform(list_zip(q, p), lambda z: CASE WHEN z[2] > 50000.0 THEN z[1] END)")
_lists("array_mask", lambda o: o.q.mask[o.q > 25], "[CASE WHEN x > 25 THEN x END FOR x IN q]")
_lists("nan_to_num", lambda o: rt.nan_to_num(o.d / o.d, nan=-1.0), "[CASE WHEN x = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END FOR x IN d]")
_lists("isclose", lambda o: rt.isclose(o.p, rt.max(o.p, axis=1), rtol=0.2), "[abs(x - list_max(p)) <= 1e-8 + 0.2 * abs(list_max(p)) FOR x IN p]")
_lists("full_like", lambda o: rt.full_like(o.q, 7), "[CAST(7 AS BIGINT) FOR x IN q]")
_lists("ones_like", lambda o: rt.ones_like(o.q), "[CAST(1 AS BIGINT) FOR x IN q]")
_lists("zeros_like", lambda o: rt.zeros_like(o.p), "[CAST(0 AS DOUBLE) FOR x IN p]")
_lists("values_astype", lambda o: rt.values_astype(o.p, "int64"), "[CAST(trunc(x) AS BIGINT) FOR x IN p]")
_lists("where", lambda o: rt.where(o.q > 25, o.q, -o.q), "[CASE WHEN x > 25 THEN x ELSE -x END FOR x IN q]")
_lists("broadcast_arrays", lambda o: rt.broadcast_arrays(o.cust, o.q)[0], "[cust FOR x IN q]")
_lists("concatenate_axis1", lambda o: rt.concatenate([o.q, o.v], axis=1), "list_concat(q, v)")
_lists("cartesian", lambda o: rt.cartesian({"0": o.n, "1": o.q}), "flatten([[{'f0': a, 'f1': b} FOR b IN q] FOR a IN n])")
_lists("argcartesian", lambda o: rt.argcartesian({"0": o.n, "1": o.q}), "flatten([[{'f0': CAST(a AS BIGINT), 'f1': CAST(b AS BIGINT)} FOR b IN range(len(q))] FOR a IN range(len(n))])")
_lists("cartesian_nested", lambda o: rt.sum(rt.cartesian([o.n, o.q], nested=True)["1"], axis=2), "[CAST(list_sum(q) AS BIGINT) FOR a IN n]")
_lists("combinations", lambda o: rt.combinations(o.q, 2), "flatten([[{'f0': q[i], 'f1': q[j]} FOR j IN range(i + 1, len(q) + 1)] FOR i IN range(1, len(q) + 1)])")
_lists("combinations_replacement", lambda o: rt.combinations(o.q, 2, replacement=True), "flatten([[{'f0': q[i], 'f1': q[j]} FOR j IN range(i, len(q) + 1)] FOR i IN range(1, len(q) + 1)])")
_lists("combinations_three", lambda o: rt.combinations(o.q, 3), "flatten(flatten([[[{'f0': q[i], 'f1': q[j], 'f2': q[m]} FOR m IN range(j + 1, len(q) + 1)] FOR j IN range(i + 1, len(q) + 1)] FOR i IN range(1, len(q) + 1)]))")
_lists("argcombinations", lambda o: rt.argcombinations(o.q, 2), "flatten([[{'f0': CAST(i AS BIGINT), 'f1': CAST(j AS BIGINT)} FOR j IN range(i + 1, len(q))] FOR i IN range(len(q))])")
_lists("zip", lambda o: rt.zip({"0": o.n, "1": o.p}), "list_transform(list_zip(n, p), lambda z: {'f0': z[1], 'f1': z[2]})")
_lists("zip_broadcast", lambda o: rt.zip({"0": o.cust, "1": o.q}), "[{'f0': cust, 'f1': x} FOR x IN q]")
_lists("unzip", lambda o: rt.unzip(rt.zip([o.n, o.q]))[1], "q")
_lists("with_field", lambda o: rt.with_field(rt.zip({"0": o.n}), o.q * 2, "1"), "list_transform(list_zip(n, q), lambda z: {'f0': z[1], 'f1': z[2] * 2})")
_lists("without_field", lambda o: rt.without_field(rt.zip({"0": o.n, "1": o.q, "2": o.p}), "2"), "list_transform(list_zip(n, q), lambda z: {'f0': z[1], 'f1': z[2]})")
_lists("to_regular", lambda o: rt.from_regular(rt.to_regular(rt.pad_none(o.q, 2, clip=True))), "list_resize(q, 2)")
_lists("enforce_type", lambda o: rt.enforce_type(rt.zip({"0": o.n, "1": o.q}), "array<struct<`1`:double,`2`:string>>"), "[{'f1': CAST(x AS DOUBLE), 'f2': CAST(NULL AS VARCHAR)} FOR x IN q]")
_lists("sort_by_argsort", lambda o: o.q[rt.argsort(o.p)], "[q[i] FOR i IN list_grade_up(p)]")

# Access.
_lists("inner_filter", lambda o: o.q[o.d > 0.05], "[z[1] FOR z IN list_zip(q, d) IF z[2] > 0.05]")
_lists("inner_slice", lambda o: o.q[:, 1:3], "q[2:3]")
_lists("inner_slice_step", lambda o: o.q[:, ::2], "[q[i] FOR i IN range(1, len(q) + 1, 2)]")
_lists("inner_slice_back", lambda o: o.q[:, ::-1], "list_reverse(q)")
_scalars("inner_index", lambda o: rt.firsts(o.q[:, -1:]), "q[-1]")
_lists("fields", lambda o: rt.zip({"0": o.n, "1": o.q, "2": o.p})[["0", "2"]], "list_transform(list_zip(n, p), lambda z: {'f0': z[1], 'f2': z[2]})")
_frame("row_filter", lambda s, d: (lambda o: o[o.total > 250000.0][["k", "total"]].to_spark())(orders(s, d)), "SELECT o_orderkey AS k, o_totalprice AS total FROM orders WHERE o_totalprice > 250000.0")
_frame("row_slice", lambda s, d: orders(s, d)[10:500:7][["k", "total"]].to_spark(), "SELECT k, total FROM (SELECT o_orderkey AS k, o_totalprice AS total, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 10 AND r < 500 AND (r - 10) % 7 = 0")
_frame("row_slice_negative", lambda s, d: orders(s, d)[-25:][["k", "total"]].to_spark(), "SELECT o_orderkey AS k, o_totalprice AS total FROM orders ORDER BY o_orderkey DESC LIMIT 25")
_frame("row_index", lambda s, d: orders(s, d)[["k", "total"]][123].to_spark(), "SELECT k, total FROM (SELECT o_orderkey AS k, o_totalprice AS total, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r = 123")
_frame("head", lambda s, d: orders(s, d)[["k", "total"]].head(15, compute=False).to_spark(), "SELECT o_orderkey AS k, o_totalprice AS total FROM orders ORDER BY o_orderkey LIMIT 15")
_frame("set_and_delete_field", lambda s, d: _changed(orders(s, d)[["k", "total", "cust"]]).to_spark(), "SELECT o_orderkey AS k, o_totalprice AS total, o_totalprice * 2 AS twice FROM orders")


def _changed(a: rt.Array) -> rt.Array:
    a["twice"] = a.total * 2
    del a["cust"]
    return a


# Element-wise functions.
_UFUNCS = {
    "add": (lambda o: o.q + o.n, "[z[1] + z[2] FOR z IN list_zip(q, n)]"),
    "subtract": (lambda o: o.q - rt.min(o.q, axis=1), "[x - list_min(q) FOR x IN q]"),
    "multiply": (lambda o: o.q * o.cust, "[x * cust FOR x IN q]"),
    "divide": (lambda o: o.q / o.n, "[CAST(z[1] AS DOUBLE) / z[2] FOR z IN list_zip(q, n)]"),
    "floor_divide": (lambda o: (20 - o.q) // o.n, "[CAST(floor(CAST(20 - z[1] AS DOUBLE) / z[2]) AS BIGINT) FOR z IN list_zip(q, n)]"),
    "mod": (lambda o: (20 - o.q) % o.n, "[(((20 - z[1]) % z[2]) + z[2]) % z[2] FOR z IN list_zip(q, n)]"),
    "power": (lambda o: rt.values_astype(o.n**2, "int64"), "[CAST(x * x AS BIGINT) FOR x IN n]"),
    "comparisons": (lambda o: (o.q >= 10) & (o.q < 30) | ~(o.n != 1), "[(z[1] >= 10 AND z[1] < 30) OR z[2] = 1 FOR z IN list_zip(q, n)]"),
    "bitwise": (lambda o: (o.q & 12) | (o.q ^ 5) << 1, "[(x & 12) | (xor(x, 5) << 1) FOR x IN q]"),
    "sqrt": (lambda o: rt.ufuncs.rint(rt.ufuncs.sqrt(o.p) * 1000), "[round_even(sqrt(x) * 1000, 0) FOR x IN p]"),
    "log": (lambda o: rt.ufuncs.rint(rt.ufuncs.log(o.q) * 1e6), "[round_even(ln(x) * 1e6, 0) FOR x IN q]"),
    "absolute": (lambda o: abs(o.q - 25), "[abs(x - 25) FOR x IN q]"),
    "maximum": (lambda o: rt.ufuncs.maximum(o.q, o.n * 10), "[greatest(z[1], z[2] * 10) FOR z IN list_zip(q, n)]"),
    "floor": (lambda o: rt.ufuncs.floor(o.p), "[floor(x) FOR x IN p]"),
    "isfinite": (lambda o: rt.ufuncs.isfinite(o.q / o.d), "[x <> 0 FOR x IN d]"),
}
for _name, (_fn, _sql) in _UFUNCS.items():
    _lists(f"ufunc_{_name}", _fn, _sql)
_lists("scalar_broadcast", lambda o: o.q - rt.max(o.q), "[x - m FOR x IN q]", table="(SELECT k, q, (SELECT max(list_max(q)) FROM o) AS m FROM o)")
_one("scalar_operators", lambda o: (rt.max(o.q) - rt.min(o.q)) * 2, "(max(list_max(q)) - min(list_min(q))) * 2")

# Whole rows.
_frame("flatten", lambda s, d: rt.zip({"v": rt.flatten(orders(s, d).q)}).to_spark(), f"{_ORDERS} SELECT unnest(q) AS v FROM o")
_frame("flatten_records", lambda s, d: (lambda o: rt.flatten(rt.zip({"k": o.k, "q": o.q, "p": o.p})).to_spark())(orders(s, d)), f"{_ORDERS} SELECT k, unnest(q) AS q, unnest(p) AS p FROM o")
_frame("flatten_none", lambda s, d: rt.zip({"v": rt.flatten(orders(s, d).v, axis=None)}).to_spark(), f"{_ORDERS} SELECT v FROM (SELECT unnest(v) AS v FROM o) WHERE v IS NOT NULL")
_frame("ravel", lambda s, d: rt.zip({"v": rt.ravel(orders(s, d).v)}).to_spark(), f"{_ORDERS} SELECT unnest(v) AS v FROM o")
_frame("flatten_inner", lambda s, d: (lambda o: rt.zip({"k": o.k, "v": rt.num(rt.flatten(rt.cartesian([o.n, o.q], nested=True)["0"], axis=2))}, depth_limit=1).to_spark())(orders(s, d)), f"{_ORDERS} SELECT k, CAST(len(q) * len(n) AS BIGINT) AS v FROM o")
_frame("to_dataframe", lambda s, d: (lambda o: rt.to_dataframe(rt.zip({"k": o.k, "q": o.q})))(orders(s, d)), f"{_ORDERS}, r AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS entry FROM o) SELECT entry, CAST(unnest(range(len(q))) AS BIGINT) AS subentry, k, unnest(q) AS q FROM r")
_frame("concatenate_axis0", lambda s, d: rt.concatenate([_customers(s, d), _suppliers(s, d)]).to_spark(), "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
_frame("concatenate_order", lambda s, d: rt.concatenate([_customers(s, d), _suppliers(s, d)])[100:160][["k", "name"]].to_spark(), "SELECT k, name FROM (SELECT k, name, row_number() OVER (ORDER BY s, k) - 1 AS r FROM (SELECT 0 AS s, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)) WHERE r >= 100 AND r < 160")
_frame("run_lengths_axis0", lambda s, d: rt.zip({"v": rt.run_lengths(_events(s, d).event_type)}).to_spark(), "SELECT count(*) AS v FROM (SELECT sum(c) OVER (ORDER BY event_id) AS g FROM (SELECT event_id, CASE WHEN event_type = lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events)) GROUP BY g")
_frame("unflatten_axis0", lambda s, d: (lambda u: rt.zip({"v": rt.sum(u, axis=1)}).to_spark())(rt.unflatten(_nations(s, d).k, 5)), "SELECT CAST(sum(n_nationkey) AS BIGINT) AS v FROM (SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1) // 5 AS g FROM nation) GROUP BY g")
_frame("unflatten_counts", lambda s, d: (lambda o: (lambda u: rt.zip({"k": o.k, "v": rt.sum(u, axis=1)}, depth_limit=1).to_spark())(rt.unflatten(rt.flatten(o.q), rt.num(o.q))))(orders(s, d)), f"{_ORDERS} SELECT k, CAST(coalesce(list_sum(q), 0) AS BIGINT) AS v FROM o")
_frame("repartition", lambda s, d: (lambda a: rt.zip({"k": a.k, "part": a.leaf(F.col(a.frame.part), 0)}).to_spark())(orders(s, d)[["k", "total"]].repartition(rows_per_partition=1000)), "SELECT o_orderkey AS k, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS INTEGER) AS part FROM orders")
_frame("partitions", lambda s, d: orders(s, d)[["k", "total"]].repartition(rows_per_partition=1000).partitions[1].to_spark(), "SELECT k, total FROM (SELECT o_orderkey AS k, o_totalprice AS total, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 1000 AND r < 2000")
_frame("sample_factor", lambda s, d: rt.sample(orders(s, d)[["k", "total"]].repartition(rows_per_partition=1000), factor=7).to_spark(), "SELECT k, total FROM (SELECT o_orderkey AS k, o_totalprice AS total, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 1000 % 7 = 0")
_frame("drop_none_axis0", lambda s, d: (lambda o: rt.drop_none(rt.zip({"v": rt.where(o.total > 100000.0, o.k, None)}).v, axis=0).to_spark("v"))(orders(s, d)), "SELECT o_orderkey AS v FROM orders WHERE o_totalprice > 100000.0")
_frame("local_index_axis0", lambda s, d: (lambda o: rt.zip({"k": o.k, "v": rt.local_index(o, axis=0)}).to_spark())(orders(s, d)), "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS v FROM orders")
_frame("side_by_side", lambda s, d: (lambda a, b: rt.zip({"k": a.k, "v": a.k * 1000 + b.k}).to_spark())(_nations(s, d), _nations(s, d, down=True)), "SELECT a.k, a.k * 1000 + b.k AS v FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) a JOIN (SELECT CAST(n_nationkey AS BIGINT) AS k, row_number() OVER (ORDER BY n_nationkey DESC) AS r FROM nation) b USING (r)")


def _customers(spark: SparkSession, sf_dir: str) -> rt.Array:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    return rt.from_dataframe(df, order_by="k")


def _suppliers(spark: SparkSession, sf_dir: str) -> rt.Array:
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return rt.from_dataframe(df, order_by="k")


def _nations(spark: SparkSession, sf_dir: str, down: bool = False) -> rt.Array:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))
    df = df.withColumn("o", F.col("k") * (-1 if down else 1))
    return rt.from_dataframe(df, ["k", "name"], order_by="o")


def _events(spark: SparkSession, sf_dir: str) -> rt.Array:
    return rt.from_dataframe(spark.read.parquet(f"{sf_dir}/events.parquet"), order_by="event_id")


# Sources and sinks.
_frame("from_parquet", lambda s, d: rt.from_parquet(f"{d}/events.parquet", columns=["event_id", "val*"], spark=s).to_spark(), "SELECT event_id, value FROM events")
_frame("from_parquet_nested", lambda s, d: (lambda e: rt.zip({"k": e.vec_id, "v": rt.ufuncs.rint(rt.sum(e.embedding, axis=1) * 1000), "n": rt.num(e.embedding)}, depth_limit=1).to_spark())(rt.from_parquet(f"{d}/embeddings.parquet", spark=s)), "SELECT vec_id AS k, round_even(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]) * 1000, 0) AS v, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
_frame("from_parquet_rows", lambda s, d: rt.from_parquet(f"{d}/events.parquet", spark=s)[100:200][["event_id", "event_type"]].to_spark(), "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) WHERE r >= 100 AND r < 200")
_frame("map_partitions", lambda s, d: _doubled(s, d), "SELECT o_orderkey AS k, o_orderkey * 2 AS v FROM orders")
_frame("from_map", lambda s, d: rt.from_map(_squares, [0, 10, 20], meta="struct<i:bigint,s:bigint>", spark=s).to_spark(), "SELECT i, i * i AS s FROM (SELECT CAST(unnest(range(30)) AS BIGINT) AS i)")
_frame("from_lists", lambda s, d: (lambda a: rt.zip({"v": rt.sum(a, axis=1)}).to_spark())(rt.from_lists([[[1, 2], []], [[3]]], spark=s)), "SELECT CAST(unnest([3, 0, 3]) AS BIGINT) AS v")
_frame("parquet_round_trip", lambda s, d: _through_parquet(s, d), f"{_ORDERS} SELECT k, CAST(unnest(range(len(q))) AS BIGINT) AS pos, unnest(q) AS v FROM o")
_frame("json_round_trip", lambda s, d: _through_json(s, d), f"{_ORDERS} SELECT k, CAST(unnest(range(len(v))) AS BIGINT) AS pos, unnest(v) AS v FROM o")
_frame("behavior", lambda s, d: (lambda o: rt.zip({"k": o.k, "v": rt.with_name(rt.zip({"q": o.q, "p": o.p}, depth_limit=1), "order_lines").total_quantity}, depth_limit=1).to_spark())(orders(s, d)), f"{_ORDERS} SELECT k, CAST(coalesce(list_sum(q), 0) AS BIGINT) AS v FROM o")


@rt.register("order_lines")
class OrderLines:
    @property
    def total_quantity(self):
        return rt.sum(self.q, axis=1)


def _squares(start: int) -> list[dict]:
    return [{"i": i, "s": i * i} for i in range(start, start + 10)]


def _twice(keys):
    import pyarrow.compute as pc

    return pc.multiply(keys, 2)


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return rt.zip({"k": o.k, "v": rt.map_partitions(_twice, o.k, meta="bigint", output_divisions=1)}).to_spark()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that all executors share."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='ragtide-')}/{what}-{uuid.uuid4().hex}"


def _through_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    path = rt.to_parquet(o[["k", "q"]], scratch(spark, "parquet"))
    a = rt.from_parquet(path, spark=spark)
    return rt.zip({"k": a.k, "v": a.q}, depth_limit=1).to_spark().select("k", F.posexplode("v").alias("pos", "v")).withColumn("pos", F.col("pos").cast("bigint"))


def _through_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    path = rt.to_json(o[["k", "v"]], scratch(spark, "json"), compression="gzip")
    a = rt.from_json(path, schema="k bigint, v array<bigint>", compression="gzip", spark=spark)
    return rt.zip({"k": a.k, "v": a.v}, depth_limit=1).to_spark().select("k", F.posexplode("v").alias("pos", "v")).withColumn("pos", F.col("pos").cast("bigint"))


# Strings: names of parts, which are ASCII; texts of documents where characters beyond matter.
def parts(spark: SparkSession, sf_dir: str) -> rt.Array:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("s"), F.col("p_type").alias("t"))
    return rt.from_dataframe(df, order_by="k")


def texts(spark: SparkSession, sf_dir: str) -> rt.Array:
    return rt.from_dataframe(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("k"), F.col("text").alias("s")), order_by="k")


_PARTS, _TEXTS = "WITH o AS (SELECT p_partkey AS k, p_name AS s, p_type AS t FROM part)", "WITH o AS (SELECT doc_id AS k, text AS s FROM documents)"
_S = rt.str
_STRINGS: dict[str, tuple[Callable, str]] = {
    "capitalize": (lambda o: _S.capitalize(o.s), "upper(s[1]) || lower(s[2:])"),
    "center": (lambda o: _S.center(o.s, 21, "*"), "CASE WHEN length(s) >= 21 THEN s ELSE repeat('*', CAST(floor((21 - length(s)) / 2) AS INTEGER)) || s || repeat('*', CAST(ceil((21 - length(s)) / 2) AS INTEGER)) END"),
    "count_substring": (lambda o: _S.count_substring(o.s, "a"), "length(s) - length(replace(s, 'a', ''))"),
    "count_substring_regex": (lambda o: _S.count_substring_regex(o.s, "[aeiou]+"), "CAST(len(regexp_extract_all(s, '[aeiou]+')) AS BIGINT)"),
    "ends_with": (lambda o: _S.ends_with(o.s, "1"), "suffix(s, '1')"),
    "find_substring": (lambda o: _S.find_substring(o.s, "e"), "CAST(instr(s, 'e') - 1 AS BIGINT)"),
    "find_substring_regex": (lambda o: _S.find_substring_regex(o.s, "[0-9]+"), "CAST(coalesce(instr(s, nullif(regexp_extract(s, '[0-9]+'), '')) - 1, -1) AS BIGINT)"),
    "index_in": (lambda o: _S.index_in(o.t, ["nothing", "PROMO", "SMALL", "STANDARD"]), "CASE t WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'STANDARD' THEN 3 END::BIGINT"),
    "is_in": (lambda o: _S.is_in(o.t, ["PROMO", "SMALL"]), "t IN ('PROMO', 'SMALL')"),
    "is_alnum": (lambda o: _S.is_alnum(o.s), "regexp_full_match(s, '[A-Za-z0-9]+')"),
    "is_alpha": (lambda o: _S.is_alpha(o.t), "regexp_full_match(t, '[A-Za-z]+')"),
    "is_ascii": (lambda o: _S.is_ascii(o.s), "regexp_full_match(s, '[\\x00-\\x7F]*')"),
    "is_decimal": (lambda o: _S.is_decimal(_S.slice(o.s, -1)), "regexp_full_match(right(s, 1), '[0-9]+')"),
    "is_digit": (lambda o: _S.is_digit(_S.slice(o.s, -1)), "regexp_full_match(right(s, 1), '[0-9]+')"),
    "is_numeric": (lambda o: _S.is_numeric(_S.slice(o.s, -1)), "regexp_full_match(right(s, 1), '[0-9]+')"),
    "is_lower": (lambda o: _S.is_lower(o.s), "s = lower(s) AND regexp_matches(s, '[a-z]')"),
    "is_upper": (lambda o: _S.is_upper(o.t), "t = upper(t) AND regexp_matches(t, '[A-Z]')"),
    "is_printable": (lambda o: _S.is_printable(o.s), "true"),
    "is_space": (lambda o: _S.is_space(_S.slice(o.s, 5, 6)), "regexp_full_match(s[6:6], '\\s+')"),
    "is_title": (lambda o: _S.is_title(_S.capitalize(o.t)), "regexp_full_match(upper(t[1]) || lower(t[2:]), '[^A-Za-z]*([A-Z][a-z]*[^A-Za-z]*)+')"),
    "join": (lambda o: _S.join(_S.split_pattern(o.s, " "), "+"), "replace(s, ' ', '+')"),
    "join_element_wise": (lambda o: _S.join_element_wise(o.s, o.t, "/"), "s || '/' || t"),
    "length": (lambda o: _S.length(o.s), "length(s)"),
    "lower": (lambda o: _S.lower(o.t), "lower(t)"),
    "upper": (lambda o: _S.upper(o.s), "upper(s)"),
    "lpad": (lambda o: _S.lpad(o.s, 15, "-"), "CASE WHEN length(s) >= 15 THEN s ELSE lpad(s, 15, '-') END"),
    "rpad": (lambda o: _S.rpad(o.s, 15, "-"), "CASE WHEN length(s) >= 15 THEN s ELSE rpad(s, 15, '-') END"),
    "trim": (lambda o: _S.trim(o.s, "p1a"), "trim(s, 'p1a')"),
    "ltrim": (lambda o: _S.ltrim(o.s, "part "), "ltrim(s, 'part ')"),
    "rtrim": (lambda o: _S.rtrim(o.s, "0123456789"), "rtrim(s, '0123456789')"),
    "trim_whitespace": (lambda o: _S.trim_whitespace(_S.center(o.s, 30)), "trim(s)"),
    "ltrim_whitespace": (lambda o: _S.ltrim_whitespace(_S.lpad(o.s, 30)), "ltrim(s)"),
    "rtrim_whitespace": (lambda o: _S.rtrim_whitespace(_S.rpad(o.s, 30)), "rtrim(s)"),
    "match_like": (lambda o: _S.match_like(o.s, "%a%1_"), "s LIKE '%a%1_'"),
    "match_substring": (lambda o: _S.match_substring(o.s, "AR", ignore_case=True), "contains(lower(s), 'ar')"),
    "match_substring_regex": (lambda o: _S.match_substring_regex(o.s, "[a-d] ?[0-4]"), "regexp_matches(s, '[a-d] ?[0-4]')"),
    "repeat": (lambda o: _S.repeat(o.s, o.k % 3), "repeat(s, CAST(k % 3 AS INTEGER))"),
    "replace_slice": (lambda o: _S.replace_slice(o.s, 2, 4, "##"), "s[1:2] || '##' || s[5:]"),
    "replace_substring": (lambda o: _S.replace_substring(o.s, "a", "<>"), "replace(s, 'a', '<>')"),
    "replace_substring_max": (lambda o: _S.replace_substring(o.s, "e", "<>", max_replacements=1), "regexp_replace(s, 'e', '<>')"),
    "replace_substring_regex": (lambda o: _S.replace_substring_regex(o.s, "[aeiou]", "."), "regexp_replace(s, '[aeiou]', '.', 'g')"),
    "replace_substring_regex_max": (lambda o: _S.replace_substring_regex(o.s, "[aeiou]", ".", max_replacements=1), "regexp_replace(s, '[aeiou]', '.')"),
    "reverse": (lambda o: _S.reverse(o.s), "reverse(s)"),
    "slice": (lambda o: _S.slice(o.s, 1, -1), "s[2:-2]"),
    "slice_step": (lambda o: _S.slice(o.s, 0, None, 2), "array_to_string([s[i] FOR i IN range(1, length(s) + 1, 2)], '')"),
    "starts_with": (lambda o: _S.starts_with(o.s, "p"), "starts_with(s, 'p')"),
    "swapcase": (lambda o: _S.swapcase(_S.capitalize(o.t)), "lower(t[1]) || upper(t[2:])"),
    "title": (lambda o: _S.title(o.s), "array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+')], '')"),
    "to_categorical": (lambda o: _S.to_categorical(o.t), "t"),
    "strings_astype": (lambda o: rt.strings_astype(_S.slice(o.s, -2), "int64"), "TRY_CAST(right(s, 2) AS BIGINT)"),
}
for _name, (_fn, _sql) in _STRINGS.items():
    _scalars(f"str_{_name}", _fn, _sql, parts, _PARTS)
_lists("str_split_pattern", lambda o: _S.split_pattern(o.s, " "), "string_split(s, ' ')", parts, _PARTS)
_lists("str_split_pattern_regex", lambda o: _S.split_pattern_regex(o.s, "[ae]"), "regexp_split_to_array(s, '[ae]')", parts, _PARTS)
_lists("str_split_whitespace", lambda o: _S.split_whitespace(o.s), "regexp_split_to_array(s, '\\s+')", parts, _PARTS)
_frame("str_extract_regex", lambda s, d: (lambda o: rt.zip({"k": o.k, **dict(zip("ab", rt.unzip(_S.extract_regex(o.s, "(?P<a>[a-z]+) (?P<b>[a-z]+)"))))}).to_spark())(parts(s, d)), f"{_PARTS} SELECT k, CASE WHEN regexp_matches(s, '[a-z]+ [a-z]+') THEN regexp_extract(s, '([a-z]+) ([a-z]+)', 1) END AS a, CASE WHEN regexp_matches(s, '[a-z]+ [a-z]+') THEN regexp_extract(s, '([a-z]+) ([a-z]+)', 2) END AS b FROM o")
_scalars("str_length_texts", lambda o: _S.length(o.s), "length(s)", texts, _TEXTS)
_scalars("str_reverse_texts", lambda o: _S.reverse(o.s), "reverse(s)", texts, _TEXTS)
_scalars("str_words_texts", lambda o: rt.num(_S.split_pattern(o.s, " ")), "CAST(len(string_split(s, ' ')) AS BIGINT)", texts, _TEXTS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' discounted lines: their number, highest price and its place, quantity, and pairs of lines."""
    o = orders(spark, sf_dir)
    kept = rt.zip({"q": o.q, "p": o.p})[o.d > 0.05]
    pairs = rt.combinations(kept, 2, fields=["a", "b"])
    made = {"k": o.k, "n": rt.num(kept.q), "top": rt.max(kept.p, axis=1), "at": rt.argmax(kept.p, axis=1), "quantity": rt.sum(kept.q, axis=1), "pairs": rt.num(pairs.a.q), "product": rt.sum(pairs.a.q * pairs.b.q, axis=1)}
    return rt.zip(made, depth_limit=1).to_spark()


_frame("order_lines", flagship, f"""{_ORDERS}, f AS (SELECT k, [z FOR z IN list_zip(q, p, d) IF z[3] > 0.05] AS z FROM o), g AS (SELECT k, [x[1] FOR x IN z] AS q, [x[2] FOR x IN z] AS p FROM f)
SELECT k, CAST(len(q) AS BIGINT) AS n, list_max(p) AS top, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS at, CAST(coalesce(list_sum(q), 0) AS BIGINT) AS quantity, CAST(len(q) * (len(q) - 1) // 2 AS BIGINT) AS pairs,
CAST(coalesce(list_sum(flatten([[q[i] * q[j] FOR j IN range(i + 1, len(q) + 1)] FOR i IN range(1, len(q) + 1)])), 0) AS BIGINT) AS product FROM g""")


# Ways in and out by way of the driver's memory, over tables of fixed size.
def _names(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_name").collect()]


def _keys(spark: SparkSession, sf_dir: str) -> list[int]:
    return [int(r[0]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_nationkey").collect()]


_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation"


def _numbered(a: rt.Array) -> DataFrame:
    """Rows of a flat array with their numbers."""
    return rt.zip({"k": rt.local_index(a, axis=0), "v": a}, depth_limit=1).to_spark()


def _given(spark: SparkSession, values) -> DataFrame:
    """Values from the driver, numbered."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k bigint, v {'string' if values and isinstance(values[0], str) else 'bigint'}")


def _through_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat(p_partkey, '|', p_name)").write.text(path)
    a = rt.from_text(path, spark=spark)
    return rt.zip({"v": rt.str.upper(a), "n": rt.str.length(a)}).to_spark()


def _through_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut at another delimiter, in small blocks."""
    path = scratch(spark, "text")
    spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat(p_partkey, '|', p_name, '|')").write.option("lineSep", "|").text(path)
    a = rt.from_text(path, blocksize="64 KiB", delimiter="|", spark=spark)
    return rt.zip({"v": a[rt.str.length(a) > 0]}).to_spark()


class _Named:
    """A callable for a partition, which tasks call."""

    def __init__(self, start: int):
        self.start = start

    def __call__(self) -> list[dict]:
        return _squares(self.start)


def _facts(name: str, fn: Callable[[SparkSession, str], list], sql: str) -> None:
    """What an array says of itself: lines of text, numbered."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _given(spark, [str(x) for x in fn(spark, sf_dir)])

    _frame(name, query, f"SELECT CAST(i - 1 AS BIGINT) AS k, l[i] AS v FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {sql} AS l))")


_frame("from_text", _through_text, "SELECT upper(p_partkey || '|' || p_name) AS v, length(p_partkey || '|' || p_name) AS n FROM part")
_frame("from_text_delimiter", _through_text_parts, "SELECT unnest([CAST(p_partkey AS VARCHAR), p_name]) AS v FROM part UNION ALL SELECT chr(10) AS v FROM part WHERE false")
_frame("from_rows", lambda s, d: _numbered(rt.from_rows(_names(s, d), npartitions=4, spark=s)), "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_name AS v FROM nation")
_frame("from_delayed", lambda s, d: rt.from_delayed([_Named(k) for k in (0, 10, 20)], meta="struct<i:bigint,s:bigint>", spark=s).to_spark(), "SELECT i, i * i AS s FROM (SELECT CAST(unnest(range(30)) AS BIGINT) AS i)")
_frame("from_numpy", lambda s, d: _numbered(rt.sum(rt.from_numpy(_pairs(s, d), chunks=6, spark=s), axis=1)), "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, CAST(n_nationkey * 11 AS BIGINT) AS v FROM nation")
_frame("to_numpy", lambda s, d: _given(s, [int(x) for x in rt.to_numpy(_nations(s, d).k * 3)]), "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, CAST(n_nationkey * 3 AS BIGINT) AS v FROM nation")
_frame("to_list", lambda s, d: _given(s, rt.to_list(rt.str.lower(_nations(s, d).name))), "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, lower(n_name) AS v FROM nation")
_frame("to_bag", lambda s, d: _given(s, sorted(rt.to_bag(_nations(s, d).name))), "SELECT row_number() OVER (ORDER BY n_name) - 1 AS k, n_name AS v FROM nation")
_frame("to_delayed", lambda s, d: _given(s, [x for part in rt.to_delayed(_nations(s, d).name.repartition(npartitions=3)) for x in part()]), "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_name AS v FROM nation")
_frame("compute", lambda s, d: _given(s, [r["name"] for r in _nations(s, d)[["name"]].compute()]), "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_name AS v FROM nation")


def _pairs(spark: SparkSession, sf_dir: str):
    import numpy as np

    return np.array([[k, 10 * k] for k in _keys(spark, sf_dir)])


# Members that change nothing but what is known of an array.
_lists("copy", lambda o: rt.copy(o.v), "v")
_lists("to_packed", lambda o: rt.to_packed(o.q[o.q > 10]), "[x FOR x IN q IF x > 10]")
_lists("with_parameter", lambda o: rt.with_parameter(o.q, "unit", "pieces"), "q")
_lists("without_parameters", lambda o: rt.without_parameters(rt.with_parameter(o.v, "unit", "pieces")), "v")
_facts("parameters", lambda s, d: [rt.with_parameter(orders(s, d).q, "unit", "pieces").parameters["unit"], len(rt.without_parameters(rt.with_parameter(orders(s, d).q, "unit", "pieces")).parameters)], "['pieces', '0']")
_facts("array_type", lambda s, d: (lambda o: [o.q.type, o.q.ndim, o.k.ndim, rt.type(o.p).simpleString(), rt.type(rt.sum(o.q)).simpleString()])(orders(s, d)), "['?? * array<bigint>', '2', '1', 'array<double>', 'bigint']")
_facts("array_form", lambda s, d: (lambda o: [o.q.form["type"], o.q.form["elementType"], o.q.layout == o.q.form])(orders(s, d)), "['array', 'long', 'True']")
_facts("array_fields", lambda s, d: (lambda o: [*rt.fields(o), *rt.fields(o.q), rt.backend(o)])(orders(s, d)), "['k', 'cust', 'total', 'pri', 'n', 'q', 'p', 'd', 'v', 'spark']")
_facts("array_attrs", lambda s, d: (lambda a: [a.attrs["origin"], a.record_name, "order_lines" in a.behavior])(rt.with_name(rt.with_attrs(orders(s, d)[["q", "p"]], {"origin": "orders"}), "order_lines")), "['orders', 'order_lines', 'True']")
_facts("array_length", lambda s, d: (lambda a: [a.eager_compute_divisions() or len(a)])(orders(s, d)[["k"]]), "[(SELECT CAST(count(*) AS VARCHAR) FROM orders)]")
_facts("divisions", lambda s, d: _divided(s, d), "['4', 'True', '[0, 7, 14, 21, 25]', 'False', '[None, None, None, None, None]', '[0, 7, 14, 21, 25]']")
_facts("known_divisions", lambda s, d: list(rt.from_rows(_keys(s, d), npartitions=2, spark=s).divisions), "['0', '13', '25']")
_facts("repartition_simple", lambda s, d: (lambda a: [list(a.repartition(n_to_one=2).divisions), list(a.repartition(one_to_n=2).divisions), list(a.repartition(divisions=[0, 5, 20]).divisions)])(rt.from_rows(_keys(s, d), npartitions=4, spark=s)), "['[0, 14, 25]', '[0, 4, 7, 11, 14, 18, 21, 23, 25]', '[0, 5, 20]']")
_facts("outer_index", lambda s, d: [rt.normalize_single_outer_inner_index((0, 7, 14, 25), i) for i in (0, 6, 7, -1, 20)], "['(0, 0)', '(0, 6)', '(1, 0)', '(2, 10)', '(2, 6)']")
_facts("partition_compatibility", lambda s, d: _compatible(s, d), "['YES', 'NO', 'True', 'False']")
_facts("report_necessary_columns", lambda s, d: _read_leaves(rt.report_necessary_columns, s, d), "['events.parquet', 'event_type', 'value']")
_facts("report_necessary_buffers", lambda s, d: _read_leaves(rt.report_necessary_buffers, s, d), "['events.parquet', 'data', 'event_type', 'value', 'shape']")
_frame("optimize_columns", lambda s, d: rt.optimize_columns(rt.from_parquet(f"{d}/events.parquet", spark=s), ["event_id", "value"])[["event_id", "value", "event_type"]].to_spark(), "SELECT event_id, value, CAST(NULL AS VARCHAR) AS event_type FROM events")
_facts("layout_to_jsonschema", lambda s, d: (lambda x: [x["type"], x["items"]["type"], x["title"]])(rt.layout_to_jsonschema(orders(s, d).q)), "['array', 'integer', 'untitled']")
_facts("reset_meta", lambda s, d: (lambda q: [q.type, q.reset_meta(), q.type])(orders(s, d).q), "['?? * array<bigint>', 'None', '?? * array<bigint>']")

# Scalars and records.
_one("scalar_negative", lambda o: -rt.sum(o.q), "CAST(-sum(list_sum(q)) AS BIGINT)")
_one("scalar_absolute", lambda o: abs(rt.min(o.q) - rt.max(o.q)), "abs(min(list_min(q)) - max(list_max(q)))")
_frame("scalar_known", lambda s, d: (lambda o: rt.zip({"k": o.k, "v": o.k + rt.Scalar.from_known(5)}).to_spark())(orders(s, d)), "SELECT o_orderkey AS k, o_orderkey + 5 AS v FROM orders")
_facts("scalar_to_delayed", lambda s, d: [rt.sum(orders(s, d).q).to_delayed()()], "[(SELECT CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))]")
_one("record_field", lambda o: o[["k", "total"]][7].total, "(SELECT o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 7)", table="(SELECT 1)")
_scalars("linear_fit_axis1", lambda o: rt.ufuncs.rint(rt.linear_fit(o.q, o.p, axis=1).slope * rt.where(rt.max(o.q, axis=1) > rt.min(o.q, axis=1), 1, None) * 77.7), "CASE WHEN list_max(q) > list_min(q) THEN round(list_sum([(a.q - list_avg(q)) * (a.p - list_avg(p)) FOR a IN z]) / list_sum([(x - list_avg(q)) * (x - list_avg(q)) FOR x IN q]) * 77.7) END", table="(SELECT k, q, p, list_transform(list_zip(q, p), lambda y: {'q': y[1], 'p': y[2]}) AS z FROM o)")


@rt.register("measured_lines")
class MeasuredLines:
    @rt.lazy_method
    def scaled(self, by):
        return rt.sum(self.q, axis=1) * by


_scalars("behavior_method", lambda o: rt.with_name(rt.zip({"q": o.q, "p": o.p}, depth_limit=1), "measured_lines").scaled(3), "CAST(coalesce(list_sum(q), 0) * 3 AS BIGINT)")


def _plus(keys, more, by=1):
    import pyarrow.compute as pc

    return pc.add(keys, pc.multiply(more[0], by))


_frame("map_partitions_packed", lambda s, d: (lambda o: rt.zip({"k": o.k, "v": rt.map_partitions(_plus, o.k, [o.cust], by=2, meta="bigint", output_divisions=1)}).to_spark())(orders(s, d)), "SELECT o_orderkey AS k, o_orderkey + 2 * o_custkey AS v FROM orders")


def _divided(spark: SparkSession, sf_dir: str) -> list:
    a = rt.from_rows(_keys(spark, sf_dir), npartitions=4, spark=spark)
    out = [a.npartitions, a.known_divisions, list(a.divisions)]
    a.clear_divisions()
    out += [a.known_divisions, list(a.divisions)]
    a.eager_compute_divisions()
    return [*out, list(a.divisions)]


def _compatible(spark: SparkSession, sf_dir: str) -> list:
    keys = _keys(spark, sf_dir)
    a, b, c = (rt.from_rows(keys, npartitions=n, spark=spark) for n in (4, 4, 5))
    return [rt.partition_compatibility(a, b).name, rt.partition_compatibility(a, c).name, rt.compatible_partitions(a, b), rt.compatible_partitions(a, c)]


def _read_leaves(report: Callable, spark: SparkSession, sf_dir: str) -> list:
    """What a plan reads of a table, the source's name first."""
    e = rt.from_parquet(f"{sf_dir}/events.parquet", spark=spark)
    found = report(rt.zip({"t": e.event_type, "v": e.value * 2}))
    out: list = []
    for where, leaves in sorted(found.items()):
        out.append(where.rstrip("/").rsplit("/", 1)[-1])
        out += leaves if isinstance(leaves, list) else [x for kind in ("data", "shape") for x in (kind, *leaves[kind])]
    return out
