import pytest

import ragtide as rt


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("points") / "p")
    a = rt.from_lists([[{"points": [{"x": 1, "y": 2.0, "z": "a"}], "foo": 3, "rec": {"a": 1, "b": "t"}}]], spark=spark)
    rt.to_parquet(a, path)
    return rt.from_parquet(path, spark=spark)


def read(*arrays):
    return sorted(next(iter(rt.report_necessary_columns(*arrays).values())))


READS = {
    "field": (lambda a: a.points.x, ["points.x"]),
    "sum": (lambda a: rt.sum(a.points.x, axis=1), ["points.x"]),
    "number reads the thinnest leaf": (lambda a: rt.num(a.points), ["points.x"]),
    "filter of records, one field used": (lambda a: a.points[a.points.x > 0].y, ["points.x", "points.y"]),
    "row filter": (lambda a: a[a.foo > 1].points.y, ["foo", "points.y"]),
    "pairs, one field": (lambda a: rt.combinations(a.points, 2)["0"].y, ["points.x", "points.y"]),
    "pairs, all of one field": (lambda a: rt.cartesian([a.points.x, a.points.x]), ["points.x"]),
    "struct": (lambda a: a.rec.a, ["rec.a"]),
    "without_field": (lambda a: rt.without_field(a.rec, "b"), ["rec.a"]),
    "rows": (lambda a: rt.num(a, axis=0), []),
    "flatten": (lambda a: rt.flatten(a.points.x), ["points.x"]),
    "total": (lambda a: rt.max(a.points.x + 1), ["points.x"]),
    "mapped": (lambda a: a.points[["x", "y"]], ["points.x", "points.y"]),
    "axis 0": (lambda a: rt.sum(a.points.x, axis=0), ["points.x"]),
}


@pytest.mark.parametrize("name", READS)
def test_only_what_is_used_is_read(name, points):
    fn, columns = READS[name]
    assert read(fn(points)) == columns


def test_several_and_nested(points):
    assert read([points.points.x, {"a": points.foo}]) == ["foo", "points.x"]


def test_optimize_columns(points):
    narrow = rt.optimize_columns(points, ["foo", "points.x"])
    assert read(narrow) == ["foo", "points.x"]
    assert narrow.compute() == [{"points": [{"x": 1, "y": None, "z": None}], "foo": 3, "rec": {"a": None, "b": None}}]


def test_buffers(points):
    made = next(iter(rt.report_necessary_buffers(rt.num(points.points)).values()))
    assert made == {"data": [], "shape": ["points.x"]}
    made = next(iter(rt.report_necessary_buffers(points.points.x + 1).values()))
    assert made["data"] == ["points.x"]


def test_filter_reaches_the_scan(points):
    plan = points[points.foo > 1].points.x.to_spark()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(foo,1)" in plan


def test_no_shuffle_within_rows(points):
    made = rt.zip({"a": rt.sum(points.points.x, axis=1), "b": rt.num(rt.combinations(points.points, 2)["0"].x)}, depth_limit=1)
    assert "Exchange" not in made.to_spark()._jdf.queryExecution().executedPlan().toString()


def test_row_numbers_after_an_explode_have_few_buckets(spark):
    a = rt.from_dataframe(spark.range(5000).selectExpr("id", "array(id, 1, 2) AS l"), order_by="id")
    flat = rt.flatten(a.l)
    cuts, names = flat.frame._bucket()
    assert flat.frame.df.select(*[c.alias(n) for c, n in zip(cuts, names)]).distinct().count() == 1
    with rt.settings(bucket_bits=10):
        cuts, names = flat.frame._bucket()
        assert flat.frame.df.select(*[c.alias(n) for c, n in zip(cuts, names)]).distinct().count() == 79
    made = rt.zip({"k": rt.local_index(flat, axis=0), "v": flat}).to_spark().orderBy("k").collect()
    assert [r["k"] for r in made] == list(range(15_000)) and [r["v"] for r in made[:7]] == [0, 1, 2, 1, 1, 2, 2]


def test_many_first_rows_are_not_sorted_by_one_task(spark):
    a = rt.from_dataframe(spark.range(30_000).selectExpr("30000 - id AS k"), order_by="k")
    many = a[:20_000].to_spark()
    assert "TakeOrdered" not in many._jdf.queryExecution().executedPlan().toString()
    assert many.count() == 20_000 and many.agg({"k": "max"}).first()[0] == 20_000
    assert a[:3].to_spark().collect() == [(1,), (2,), (3,)]
