import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import ragtide as rt


@pytest.fixture(scope="module")
def a(spark):
    return rt.from_lists([[{"x": [1, 2, 3], "y": 1.5}, {"x": [], "y": 2.5}], [{"x": [4, None], "y": None}, {"x": None, "y": 0.5}]], spark=spark)


@pytest.fixture(scope="module")
def deep(spark):
    return rt.from_lists([[[[1, 2], [3]], []], [[[], [None, 5]], None]], spark=spark)


CASES = {
    "fields": (lambda a: a.x, [[1, 2, 3], [], [4, None], None]),
    "broadcast": (lambda a: a.x + a.y, [[2.5, 3.5, 4.5], [], [None, None], None]),
    "inner filter": (lambda a: a.x[a.x > 1], [[2, 3], [], [4], None]),
    "row filter": (lambda a: a[a.y > 1].y, [1.5, 2.5]),
    "gather": (lambda a: a.x[rt.argsort(a.x, ascending=False)], [[3, 2, 1], [], [4, None], None]),
    "sum": (lambda a: rt.sum(a.x, axis=1), [6, 0, 4, None]),
    "sum of all": (lambda a: rt.sum(a.x), 10),
    "sum across": (lambda a: rt.sum(a.x, axis=0), [5, 2, 3]),
    "sum keepdims": (lambda a: rt.sum(a.x, axis=1, keepdims=True), [[6], [0], [4], [None]]),
    "sum masked": (lambda a: rt.sum(a.x, axis=1, mask_identity=True), [6, None, 4, None]),
    "sum of all keepdims": (lambda a: rt.sum(a.x, keepdims=True), [[10]]),
    "max": (lambda a: rt.max(a.x, axis=1), [3, None, 4, None]),
    "max initial": (lambda a: rt.max(a.x, axis=1, initial=3), [3, 3, 4, None]),
    "min unmasked": (lambda a: rt.min(a.y), 0.5),
    "argmax": (lambda a: rt.argmax(a.x, axis=1), [2, None, 0, None]),
    "argmax unmasked": (lambda a: rt.argmax(a.x, axis=1, mask_identity=False), [2, -1, 0, None]),
    "argmax across": (lambda a: rt.argmax(a.x, axis=0), [2, 0, 0]),
    "argmin of all": (lambda a: rt.argmin(a.x), 0),
    "count": (lambda a: rt.count(a.x, axis=1), [3, 0, 1, None]),
    "any": (lambda a: rt.any(a.x > 3, axis=1), [False, False, True, None]),
    "all": (lambda a: rt.all(a.x > 0, axis=1), [True, True, True, None]),
    "prod": (lambda a: rt.prod(a.x, axis=1), [6, 1, 4, None]),
    "weighted mean": (lambda a: rt.mean(a.x, weight=a.x, axis=1, mask_identity=True), [14 / 6, None, 4.0, None]),
    "var": (lambda a: rt.var(a.x, axis=1, mask_identity=True), [2 / 3, None, 0.0, None]),
    "linear_fit": (lambda a: rt.linear_fit(a.x, a.x * 2 + 1, axis=1)["slope"][:1], [2.0]),
    "num": (lambda a: rt.num(a.x), [3, 0, 2, None]),
    "rows": (lambda a: rt.num(a, axis=0), 4),
    "one row": (lambda a: a[1], {"x": [], "y": 2.5}),
    "last row": (lambda a: a[-1]["y"], 0.5),
    "row of lists": (lambda a: a.x[0], [1, 2, 3]),
    "slice": (lambda a: a.y[1:3], [2.5, None]),
    "stepped slice": (lambda a: a.y[::2], [1.5, None]),
    "slice from the end": (lambda a: a.y[-2:], [None, 0.5]),
    "slice to the end": (lambda a: a.y[:-1], [1.5, 2.5, None]),
    "slice of a slice": (lambda a: a.y[1:][1:], [None, 0.5]),
    "inner slice": (lambda a: a.x[:, :1], [[1], [], [4], None]),
    "ellipsis": (lambda a: a.x[..., 1:], [[2, 3], [], [None], None]),
    "tuple of field and slice": (lambda a: a["x", :, ::-1], [[3, 2, 1], [], [None, 4], None]),
    "combinations": (lambda a: rt.combinations(a.x, 2), [[(1, 2), (1, 3), (2, 3)], [], [(4, None)], None]),
    "three": (lambda a: rt.combinations(a.x, 3, replacement=True, fields=["a", "b", "c"])["b"][:1], [[1, 1, 1, 2, 2, 3, 2, 2, 3, 3]]),
    "cartesian of three": (lambda a: rt.cartesian([a.x, a.x, a.x])["1"][2:3], [[4, 4, None, None, 4, 4, None, None]]),
    "nested cartesian": (lambda a: rt.cartesian([a.x, a.x], nested=True)["0"][2:3], [[[4, 4], [None, None]]]),
    "argcartesian": (lambda a: rt.argcartesian([a.x, a.x])[2:3], [[(0, 0), (0, 1), (1, 0), (1, 1)]]),
    "argcombinations": (lambda a: rt.argcombinations(a.x, 2)[:1], [[(0, 1), (0, 2), (1, 2)]]),
    "flatten": (lambda a: rt.flatten(a.x), [1, 2, 3, 4, None]),
    "flatten all": (lambda a: rt.flatten(a.x, axis=None), [1, 2, 3, 4]),
    "firsts": (lambda a: rt.firsts(a.x), [1, None, 4, None]),
    "singletons": (lambda a: rt.singletons(a.y), [[1.5], [2.5], [], [0.5]]),
    "pad": (lambda a: rt.pad_none(a.x, 2), [[1, 2, 3], [None, None], [4, None], None]),
    "clip": (lambda a: rt.pad_none(a.x, 2, clip=True), [[1, 2], [None, None], [4, None], None]),
    "argsort": (lambda a: rt.argsort(a.x), [[0, 1, 2], [], [0, 1], None]),
    "where": (lambda a: rt.where(a.x > 1, a.x, -1), [[-1, 2, 3], [], [4, None], None]),
    "mask": (lambda a: a.x.mask[a.x > 1], [[None, 2, 3], [], [4, None], None]),
    "fill_none": (lambda a: rt.fill_none(a.x, 0), [[1, 2, 3], [], [4, 0], None]),
    "drop_none": (lambda a: rt.drop_none(a.x), [[1, 2, 3], [], [4]]),
    "is_none": (lambda a: rt.is_none(a.x), [False, False, False, True]),
    "zip": (lambda a: rt.zip({"p": a.x, "q": a.y})[:2], [[{"p": 1, "q": 1.5}, {"p": 2, "q": 1.5}, {"p": 3, "q": 1.5}], []]),
    "tuples": (lambda a: rt.zip([a.x, a.y], depth_limit=1)[:1], [([1, 2, 3], 1.5)]),
    "option outside": (lambda a: rt.zip({"p": a.y, "q": a.y * 2}, optiontype_outside_record=True)[2:], [None, {"p": 0.5, "q": 1.0}]),
    "nested field": (lambda a: rt.with_field(rt.zip({"r": a}, depth_limit=1), a.y, ["r", "z"])["r", "z"], [1.5, 2.5, None, 0.5]),
    "without_field": (lambda a: rt.without_field(a, "x")[:1], [{"y": 1.5}]),
    "append": (lambda a: rt.concatenate([a.y, a.y])[3:6], [0.5, 1.5, 2.5]),
    "join lists": (lambda a: rt.concatenate([a.x, a.x], axis=1)[2:3], [[4, None, 4, None]]),
    "repartition": (lambda a: a.y.repartition(rows_per_partition=3).partitions[1], [0.5]),
    "one_to_n": (lambda a: a.y.repartition(one_to_n=2).partitions[1:3], [2.5, None]),
    "n_to_one": (lambda a: a.y.repartition(n_to_one=2), [1.5, 2.5, None, 0.5]),
    "divisions cut": (lambda a: a.y.repartition(divisions=(0, 1, 3)), [1.5, 2.5, None]),
    "sample": (lambda a: rt.sample(a.y, factor=2), [1.5, None]),
    "numpy": (lambda a: np.sqrt(a.y * a.y), [1.5, 2.5, None, 0.5]),
    "division by zero": (lambda a: a.y / 0, [np.inf, np.inf, None, np.inf]),
    "scalar": (lambda a: a.x - rt.max(a.x), [[-3, -2, -1], [], [0, None], None]),
    "scalar arithmetic": (lambda a: (rt.max(a.x) - 1) * 2 // 4, 1),
    "ptp": (lambda a: rt.ptp(a.x, axis=1), [2, None, 0, None]),
    "values_astype": (lambda a: rt.values_astype(a.x * 100, "int8"), [[100, -56, 44], [], [-112, None], None]),
    "full_like": (lambda a: rt.full_like(a.x, 7), [[7, 7, 7], [], [7, None], None]),
    "isclose": (lambda a: rt.isclose(a.y, a.y * (1 + 1e-9)), [True, True, None, True]),
    "run_lengths": (lambda a: rt.run_lengths(a.x // 2), [[1, 2], [], [1, 1], None]),
    "enforce_type": (lambda a: rt.enforce_type(a, "struct<y:string,z:int>")[:1], [{"y": "1.5", "z": None}]),
    "map_partitions": (lambda a: rt.map_partitions(lambda v: pc.list_value_length(v), a.x, output_divisions=1) + a.y, [4.5, 2.5, None, None]),
    "map_partitions, other rows": (lambda a: rt.map_partitions(lambda v: [len(v)], a.y), [2, 2]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name, a):
    fn, expected = CASES[name]
    got = fn(a).compute()
    if name == "map_partitions, other rows":
        assert sum(got) == 4
    else:
        assert got == pytest.approx(expected, nan_ok=True) if isinstance(expected, list) and all(isinstance(x, float) for x in expected) else got == expected


DEEP = {
    "sum of innermost": (lambda d: rt.sum(d, axis=2), [[3, 3], [], [0, 5], None]),
    "sum of middle": (lambda d: rt.sum(d, axis=1), [[4, 2], [], [0, 5], None]),
    "sum across": (lambda d: rt.sum(d, axis=0), [[1, 2], [3, 5]]),
    "max of middle": (lambda d: rt.max(d, axis=1), [[3, 2], [], [None, 5], None]),
    "flatten": (lambda d: rt.flatten(d, axis=2), [[1, 2, 3], [], [None, 5], None]),
    "ravel": (lambda d: rt.ravel(d), [1, 2, 3, None, 5]),
    "num": (lambda d: rt.num(d, axis=2), [[2, 1], [], [0, 2], None]),
    "local_index": (lambda d: rt.local_index(d, axis=1), [[0, 1], [], [0, 1], None]),
    "plus": (lambda d: d + 1, [[[2, 3], [4]], [], [[], [None, 6]], None]),
    "mixed depth": (lambda d: d + rt.num(d, axis=2), [[[3, 4], [4]], [], [[], [None, 7]], None]),
    "inner filter": (lambda d: d[d > 1], [[[2], [3]], [], [[], [5]], None]),
    "middle filter": (lambda d: d[rt.num(d, axis=2) > 1], [[[1, 2]], [], [[None, 5]], None]),
    "index": (lambda d: d[:, :, :1], [[[1], [3]], [], [[], [None]], None]),
    "combinations": (lambda d: rt.combinations(d, 2, axis=2), [[[(1, 2)], []], [], [[], [(None, 5)]], None]),
    "pad": (lambda d: rt.pad_none(d, 1, axis=2), [[[1, 2], [3]], [], [[None], [None, 5]], None]),
    "drop": (lambda d: rt.drop_none(d, axis=2), [[[1, 2], [3]], [], [[], [5]], None]),
}


@pytest.mark.parametrize("name", DEEP)
def test_deep(name, deep):
    fn, expected = DEEP[name]
    assert fn(deep).compute() == expected


def test_axis_none_keeps_partial_nulls_out(spark):
    n = rt.from_lists([[None, 2.0, float("nan")]], spark=spark)
    assert rt.count(n).compute() == 2
    assert np.isnan(rt.max(n).compute())
    assert (n == n).compute() == [None, True, False]
    assert (n != n).compute() == [None, False, True]
    assert rt.nan_to_num(n, nan=-1.0).compute() == [None, 2.0, -1.0]


def test_empty_array(spark):
    e = rt.from_rows([], schema="struct<x:array<bigint>>", spark=spark)
    assert e.compute() == []
    assert rt.sum(e.x).compute() == 0
    assert rt.max(e.x).compute() is None
    assert rt.sum(e.x, axis=0).compute() == []
    assert rt.num(e, axis=0).compute() == 0
    assert rt.flatten(e.x).compute() == []


def test_unflatten_and_run_lengths(spark):
    flat = rt.from_lists([[1, 1, 2], [2, 2, 3]], spark=spark)
    assert rt.unflatten(flat, 2).compute() == [[1, 1], [2, 2], [2, 3]]
    assert rt.unflatten(flat, rt.from_lists([[1, 0], [5]], spark=spark)).compute() == [[1], [], [1, 2, 2, 2, 3]]
    assert rt.run_lengths(flat).compute() == [2, 3, 1]
    with pytest.raises(Exception, match="counts don't sum up"):
        rt.unflatten(flat, rt.from_lists([[1, 4]], spark=spark)).compute()


def test_small_buckets_number_rows(spark):
    with rt.settings(bucket_bits=1):
        a = rt.from_dataframe(spark.range(50).selectExpr("id", "id * 3 AS v"), order_by="v")
        kept = a[a.id % 7 == 0]
        assert rt.local_index(kept, axis=0).compute() == list(range(8))
        assert kept.id[3:5].compute() == [21, 28]


def test_lazy_values_are_not_concrete(a):
    for fn in (bool, int, float, complex):
        with pytest.raises(rt.ConcretizationTypeError):
            fn(a.y)
        with pytest.raises(rt.ConcretizationTypeError):
            fn(rt.max(a.y))
    with pytest.raises(NotImplementedError):
        iter(a)
    with pytest.raises(NotImplementedError):
        np.asarray(a)
    with pytest.raises(TypeError):
        a.y + np.array([1.0, 2.0])


def test_errors(a, spark):
    with pytest.raises(ValueError):
        a[::-1]
    with pytest.raises(NotImplementedError):
        a.x[[0, 1]]
    with pytest.raises(KeyError):
        a["nothing"]
    with pytest.raises(AttributeError):
        _ = a.nothing
    with pytest.raises(TypeError):
        rt.sum(a, axis=1)
    with pytest.raises(TypeError):
        rt.fill_none([1], 0)
    with pytest.raises(ValueError):
        rt.sample(a)
    with pytest.raises(ValueError):
        a.repartition()
    with pytest.raises(NotImplementedError):
        np.add.reduce(a.y)
    with pytest.raises(Exception, match="different lengths"):
        (a.x + a.x[:, :1]).compute()
    with pytest.raises(Exception, match="beyond the end"):
        a.x[:, 2].compute()


def test_divisions_and_compatibility(spark):
    one, two = rt.from_lists([[1, 2], [3]], spark=spark), rt.from_lists([[1], [2, 3]], spark=spark)
    assert one.divisions == (0, 2, 3) and len(one) == 3 and one.npartitions == 2
    assert rt.partition_compatibility(one, two) == rt.PartitionCompatibility.NO
    with pytest.raises(rt.IncompatiblePartitions):
        one + two
    three = rt.from_lists([[10, 20], [30]], spark=spark)
    assert rt.partition_compatibility(one, three) == rt.PartitionCompatibility.YES
    assert (one + three).compute() == [11, 22, 33]
    three.clear_divisions()
    assert rt.partition_compatibility(one, three) == rt.PartitionCompatibility.MAYBE
    assert not rt.compatible_partitions(one, three, how_strict=rt.PartitionCompatibility.YES)
    with pytest.raises(TypeError):
        len(three)
    three.eager_compute_divisions()
    assert three.divisions == (0, 2, 3)
    assert rt.normalize_single_outer_inner_index((0, 2, 3), -1) == (1, 0)


def test_rows_of_unequal_number_are_refused_when_run(spark):
    one = rt.from_dataframe(spark.range(3), order_by="id").id
    two = rt.from_dataframe(spark.range(4), order_by="id").id
    with pytest.raises(Exception, match="lengths differ"):
        (one + two).compute()


def test_set_and_delete_fields(a):
    b = rt.copy(a)
    b["z"] = b.y * 2
    b["one"] = 1
    del b["x"]
    assert b.fields == ["y", "z", "one"] and a.fields == ["x", "y"]
    assert b[:1].compute() == [{"y": 1.5, "z": 3.0, "one": 1}]
    with pytest.raises(TypeError):
        b["z"] = "text"


def test_behaviors(a):
    @rt.register("reading")
    class Reading:
        @property
        def twice(self):
            return self.y * 2

        def plus(self, n):
            return self.y + n

        @rt.lazy_property
        def kind(self):
            return "eager"

        @kind.lazy
        def kind(self):
            return self.y * 0

    named = rt.with_name(a, "reading")
    assert named.twice.compute() == [3.0, 5.0, None, 1.0]
    assert named.plus(1).compute() == [2.5, 3.5, None, 1.5]
    assert named.kind.compute() == [0.0, 0.0, None, 0.0]
    assert named[named.y > 2].twice.compute() == [5.0]
    assert named[0].twice.compute() == 3.0
    assert "twice" in dir(named)


def test_parameters_and_types(a):
    p = rt.with_parameter(a, "unit", "m")
    assert p.parameters == {"unit": "m"} and rt.without_parameters(p).parameters == {}
    assert rt.with_attrs(a, {"note": 1}).attrs == {"note": 1}
    assert a.ndim == 1 and a.x.ndim == 2
    assert rt.type(a.x).simpleString() == "array<bigint>"
    assert rt.fields(a) == ["x", "y"] and rt.backend(a) == "spark"
    assert rt.str.to_categorical(rt.values_astype(a.y, "string")).parameters == {"categorical": True}


def test_regular(spark):
    r = rt.to_regular(rt.from_lists([[[1, 2], [3, 4]]], spark=spark))
    assert r.compute() == [[1, 2], [3, 4]] and rt.from_regular(r).parameters == {}
    with pytest.raises(Exception, match="different sizes"):
        rt.to_regular(rt.from_lists([[[1, 2], [3]]], spark=spark)).compute()


def test_enforce_type_checks_missing(spark):
    v = rt.from_lists([[{"a": 1}, {"a": None}]], spark=spark)
    from pyspark.sql import types as T

    with pytest.raises(Exception, match="missing where the type allows none"):
        rt.enforce_type(v, T.StructType([T.StructField("a", T.LongType(), False)])).compute()
    with pytest.raises(TypeError):
        rt.enforce_type(v, "struct<a:array<int>>")


def test_mergebool(spark):
    t, n = rt.from_lists([[True, False]], spark=spark), rt.from_lists([[5, 6]], spark=spark)
    assert rt.concatenate([t, n]).compute() == [1, 0, 5, 6]
    with pytest.raises(TypeError):
        rt.concatenate([t, n], mergebool=False)


def test_broadcast_arrays(a):
    y, x = rt.broadcast_arrays(a.y, a.x)
    assert y.compute() == [[1.5, 1.5, 1.5], [], [None, None], None] and x.compute() == a.x.compute()


def test_unflatten_inner(spark):
    v = rt.from_lists([[[1, 2, 3, 4], []]], spark=spark)
    assert rt.unflatten(v, 2, axis=1).compute() == [[[1, 2], [3, 4]], []]
    c = rt.from_lists([[[1, 0, 3], []]], spark=spark)
    assert rt.unflatten(v, c, axis=1).compute() == [[[1], [], [2, 3, 4]], []]


def test_whole_products_are_exact_and_wrap_at_64_bits(spark, monkeypatch):
    from ragtide.operators import reducers

    monkeypatch.setattr(reducers, "_HELD", 2)
    low = lambda values: int(np.multiply.reduce(np.array([v for v in values if v is not None], "int64"), dtype="int64"))
    # 39 threes fit 63 bits, but not the 53 of a double; the other values overflow within rows, at places and in all.
    rng = np.random.default_rng(7)
    odd = [[int(v) * 2 + 1 for v in rng.integers(-(2**61), 2**61, n)] for n in (5, 0, 3, 7, 1, 6)]
    for rows in ([[3]] * 39, [[2]] * 75, [[-2]] * 63, [[5, None], [None], [-7, 2, None]], odd, [*odd, [None], None]):
        a = rt.from_lists([rows[::2], rows[1::2]], spark=spark)
        rows = [*rows[::2], *rows[1::2]]
        assert rt.prod(a).compute() == low([v for r in rows for v in r or []])
        assert rt.prod(a, axis=1).compute() == [None if r is None else low(r) for r in rows]
        longest = max(len(r or []) for r in rows)
        assert rt.prod(a, axis=0).compute() == [low([r[i] for r in rows if r and len(r) > i]) for i in range(longest)]
    deep = rt.from_lists([[[odd[0], odd[2]]], [[odd[3]], [odd[5], [], odd[4]]]], spark=spark)
    assert rt.prod(deep, axis=0).compute()[1][0] == odd[2][0]
    assert rt.prod(deep, axis=0).compute()[0][:1] == [low([odd[0][0], odd[3][0], odd[5][0]])]
    nothing = rt.from_dataframe(spark.createDataFrame([], "x int")).x
    assert rt.prod(nothing).compute() == 1 and rt.prod(nothing, mask_identity=True).compute() is None
    assert rt.prod(rt.from_lists([[1.5, 2.0]], spark=spark)).compute() == 3.0


def _explained(array, capsys):
    array.to_spark().explain()
    return capsys.readouterr().out


def test_dealing_takes_no_sample_to_the_driver_and_numbers_rows_once(spark, capsys):
    a = rt.from_dataframe(spark.range(100).withColumnRenamed("id", "k"), order_by="k").k
    plan = _explained(rt.sample(a.repartition(rows_per_partition=10), factor=7), capsys)
    assert "rangepartitioning" not in plan.lower() and plan.count("Window [") <= 2
    plan = _explained(a.repartition(n_to_one=2), capsys)
    assert "rangepartitioning" not in plan.lower()


def test_many_partitions_share_one_of_sparks(spark, tmp_path, monkeypatch):
    from ragtide.operators import rows

    monkeypatch.setattr(rows, "MANY", 3)  # the tests' shuffles have 4
    a = rt.from_dataframe(spark.range(47).withColumnRenamed("id", "k"), order_by="k").k
    many = a.repartition(rows_per_partition=5)
    assert many.npartitions == 10 and many.divisions == (*range(0, 47, 5), 47)
    assert many.frame.df.rdd.getNumPartitions() == 4
    assert many.compute() == list(range(47))
    assert [many.partitions[i].compute() for i in (0, 9)] == [[0, 1, 2, 3, 4], [45, 46]]
    assert rt.sample(many, factor=3).compute() == [k for k in range(47) if k % 5 % 3 == 0]
    # Functions over partitions and files get one partition each, also after rows were taken out or joined on.
    first = lambda v: [v[0].as_py(), len(v)]
    assert rt.map_partitions(first, many, meta="bigint").compute() == [x for i in range(10) for x in (5 * i, 2 if i == 9 else 5)]
    assert sorted(rt.map_partitions(lambda v: [len(v)], rt.sample(many, factor=3), meta="bigint").compute()) == [1] + [2] * 9
    assert len(rt.map_partitions(lambda v: [len(v)], many.partitions[2:9], meta="bigint").compute()) == 7
    assert len(rt.map_partitions(lambda v: [len(v)], rt.concatenate([many, many]), meta="bigint").compute()) == 20
    assert rt.map_partitions(lambda v: v, many, meta="bigint", output_divisions=1).partitions[9].compute() == [45, 46]
    rt.to_parquet(many, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("*.parquet"))
    assert [pq.read_table(f).column(0).to_pylist() for f in files] == [list(range(i, min(i + 5, 47))) for i in range(0, 47, 5)]
    rt.to_parquet(rt.sample(many, factor=3), str(tmp_path / "some"))
    assert [pq.read_table(f).column(0).to_pylist() for f in sorted((tmp_path / "some").glob("*.parquet"))] == [[k for k in (i, i + 3) if k < 47] for i in range(0, 47, 5)]
    cut = a.repartition(divisions=[3, 10, 12, 20, 21, 40, 45])
    assert cut.divisions == (0, 7, 9, 17, 18, 37, 42) and cut.compute() == list(range(3, 45))
    assert [cut[1:3].compute(), cut.partitions[3].compute()] == [[4, 5], [20]]
    assert rt.sample(cut, factor=4).compute() == [k for b, e in zip((3, 10, 12, 20, 21, 40), (10, 12, 20, 21, 40, 45)) for k in range(b, e, 4)]
    assert rt.sample(many.repartition(n_to_one=2), factor=4).compute() == [k for b in range(0, 47, 10) for k in range(b, min(b + 10, 47), 4)]


def test_a_thousand_partitions_and_more(spark):
    a = rt.from_dataframe(spark.range(2100).withColumnRenamed("id", "k"), order_by="k").k
    ones = a.repartition(rows_per_partition=1)
    assert ones.npartitions == 2100 and ones.frame.df.rdd.getNumPartitions() == 1000
    assert rt.sample(ones, factor=2).compute() == list(range(2100)) and ones.partitions[2099].compute() == [2099]
    # Two rows each, and none in the last ones.
    assert rt.sample(a.repartition(npartitions=1500), factor=2).compute() == list(range(0, 2100, 2))
    with pytest.raises(ValueError):
        a.repartition(divisions=[0, *range(2, 1100)])
